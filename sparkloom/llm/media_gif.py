"""GIF media columns: encode bytes as timed frames, decode streams, histogram frames.

``encode_gif`` stores bytes losslessly as palette indices, 64 a row, in timed frames
of ``FRAME_ROWS`` rows, packed by LZW with dictionary codes of 9 to 12 bits. The
palette gives each byte its own colour (three bits of red and green, two of blue).
Each frame is cleared before the next one (disposal 2). Where the payload leaves
index 255 free, as UTF-8 always does, the last frame is filled up with it as its
transparent index, so that only pixels of the payload show.

``decode_gif`` reads any GIF87a/89a: global and local palettes, interlacing,
delays, disposal, transparency, and any LZW stream. Codes are expanded without a
loop over them: an entry's string is a slice of the output before it, so every
output byte points at an earlier one and pointers are doubled down to literals.
``canvases`` composes frames by transparency and disposal.

The query encodes texts (``encode_texts``) and derives everything else from the
media column: frames are decoded and composed, and the payload is read off the
colours of the composed canvases.

Defined cases: null text is empty; empty text is one frame with a row of zeros;
texts of any length are stored whole, in as many frames as they need; a null id is
kept; null media have no frames; a damaged file raises ValueError; repeated rows are
separate; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_runs

WIDTH, FRAME_ROWS, DELAY_CS, FREE = 64, 64, 10, 255
#: Media bytes and pixels of an Arrow batch of frames.
FLUSH = 8 << 20
_BYTES = np.arange(256, dtype=np.uint8)
#: Each byte's colour: the top three bits as red, the next three as green, the last two as blue.
PALETTE = np.stack([_BYTES & 0xE0, (_BYTES << 3) & 0xE0, (_BYTES << 6) & 0xC0], axis=1).astype(np.uint8)


@dataclass
class Frame:
    left: int
    top: int
    indices: np.ndarray
    palette: np.ndarray
    delay_cs: int = 0
    disposal: int = 0
    transparent: int | None = None


@dataclass
class Gif:
    width: int
    height: int
    background: int = 0
    palette: np.ndarray | None = None
    frames: list[Frame] = field(default_factory=list)


# --- LZW ----------------------------------------------------------------------


def _widths(minimum: int) -> np.ndarray:
    """Bits of the first, second, ... code after a clear code while the table grows."""
    first = (1 << minimum) + 2
    k = np.arange(1, 4096 - first + 4)
    out = np.full(len(k), minimum + 1)
    for w in range(minimum + 1, 12):
        out[k > (1 << w) - first + 1] = w + 1
    return out


_WIDTHS = {m: _widths(m) for m in range(2, 9)}


def lzw_encode(data: bytes, minimum: int = 8) -> np.ndarray:
    """LZW stream of bytes below 2 ** minimum: the longest known string each time; a
    clear code once the table is full."""
    clear, first = 1 << minimum, (1 << minimum) + 2
    codes: list[int] = []
    starts = [0]  # of the runs, each of which ends in a clear code or the end code
    if data:
        put, table, free = codes.append, {}, first
        get = table.get
        prefix = data[0]
        for b in data[1:]:
            key = prefix << 8 | b
            if (known := get(key)) is not None:
                prefix = known
                continue
            put(prefix)
            prefix = b
            if free < 4096:
                table[key] = free
                free += 1
            else:
                put(clear)
                starts.append(len(codes))
                table.clear()
                free = first
        put(prefix)
    codes.append(clear + 1)
    width = _WIDTHS[minimum]
    runs = np.diff([*starts, len(codes)])
    bits = np.concatenate([[minimum + 1], *(width[:n] for n in runs.tolist())])
    grid = np.array([clear, *codes], dtype=np.uint16)[:, None] >> np.arange(12, dtype=np.uint16)[None, :]
    kept = (grid & 1).astype(bool)[np.arange(12)[None, :] < bits[:, None]]
    return np.packbits(kept, bitorder="little")


def _codes(bits: np.ndarray, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
    """Codes of ``width`` bits at bit positions ``at``; ``bits`` ends with 4 spare bytes."""
    i = at >> 3
    word = bits[i].astype(np.uint32) | (bits[i + 1].astype(np.uint32) << 8) | (bits[i + 2].astype(np.uint32) << 16)
    return (word >> (at & 7).astype(np.uint32)) & ((np.uint32(1) << np.asarray(width, dtype=np.uint32)) - np.uint32(1))


def _expand(codes: np.ndarray, clear: int) -> np.ndarray:
    """Bytes of the codes between two clear codes."""
    if not len(codes) or codes.max() < clear:
        return codes.astype(np.uint8)
    codes = codes.astype(np.int64)
    here = np.arange(len(codes))
    literal = codes < clear
    parent = np.where(literal, here, codes - clear - 2)
    if (parent > here).any() or (~literal & (parent >= here)).any():
        raise ValueError("LZW code before its entry")
    length = _depths(parent, literal) + 1
    offset = np.concatenate([[0], np.cumsum(length)])
    total = int(offset[-1])
    owner = np.repeat(here, length)
    place = np.arange(total)
    source = np.where(literal[owner], place, offset[parent[owner]] + place - offset[owner])
    while True:
        deeper = source[source]
        if (deeper == source).all():
            break
        source = deeper
    values = np.zeros(total, dtype=np.uint8)
    values[offset[:-1][literal]] = codes[literal]
    return values[source]


def _depths(parent: np.ndarray, literal: np.ndarray) -> np.ndarray:
    depth, p = (~literal).astype(np.int64), parent
    while True:
        step = depth[p]
        q = p[p]
        if not step.any():
            return depth
        depth = depth + step
        p = q


def lzw_decode(data: np.ndarray, minimum: int) -> np.ndarray:
    """Bytes of any GIF LZW stream."""
    clear = 1 << minimum
    bits = np.concatenate([data, np.zeros(4, dtype=np.uint8)])
    n_bits, growing = len(data) * 8, _WIDTHS[minimum]
    parts, at = [], 0
    while at + minimum + 1 <= n_bits:  # one run between clear codes at a time
        if (int(bits[at >> 3]) | int(bits[(at >> 3) + 1]) << 8) >> (at & 7) & ((2 << minimum) - 1) == clear:
            at += minimum + 1
            continue
        limit = len(growing)
        while True:
            most = min(limit, (n_bits - at) // (minimum + 1))
            # A full table stays as it is, and codes go on at 12 bits until a clear code comes.
            width = growing[:most] if most <= len(growing) else np.concatenate([growing, np.full(most - len(growing), 12)])
            ends = np.cumsum(width)
            fits = int(np.searchsorted(ends, n_bits - at, "right"))
            run = _codes(bits, at + ends[:fits] - width[:fits], width[:fits])
            marks = np.flatnonzero((run == clear) | (run == clear + 1))
            if len(marks) or fits < limit:
                break
            limit *= 4
        m = int(marks[0]) if len(marks) else len(run)
        if m:
            parts.append(_expand(run[:m], clear))
        if not len(marks) or run[m] == clear + 1:
            break
        at += int(ends[m])
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint8)


# --- files --------------------------------------------------------------------


def _blocks(stream: np.ndarray) -> bytes:
    whole = len(stream) // 255
    grid = np.empty((whole, 256), dtype=np.uint8)
    grid[:, 0] = 255
    grid[:, 1:] = stream[: whole * 255].reshape(whole, 255)
    rest = stream[whole * 255 :].tobytes()
    return grid.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode_gif(payload: bytes | np.ndarray, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """A GIF whose frames' palette indices are ``payload``, row by row."""
    data = payload if isinstance(payload, bytes) else payload.tobytes()
    if not data or len(data) % width:
        raise ValueError("the payload must fill rows")
    rows = len(data) // width
    height = -(-rows // -(-rows // frame_rows))  # frames of equal height, as few as hold the rows
    size = height * width
    clear = FREE not in data
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, FREE if clear else 0, 0), PALETTE.tobytes()]
    for at in range(0, len(data), size):
        part = data[at : at + size]
        if clear:
            part = part.ljust(size, bytes([FREE]))
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 2 << 2 | clear, delay_cs, FREE if clear else 0, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, 0, 0, width, len(part) // width, 0, 8))
        out.append(_blocks(lzw_encode(part)))
    out.append(b";")
    return b"".join(out)


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while (n := data[at]) != 0:
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def decode_gif(data: bytes) -> Gif:
    """Frames of a GIF file as palette indices."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    try:
        return _decode(data)
    except (IndexError, struct.error) as e:
        raise ValueError("damaged GIF") from e


def _decode(data: bytes) -> Gif:
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, palette = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    gif = Gif(width, height, background, palette)
    delay, disposal, transparent = 0, 0, None
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            break
        if kind == 0x21:
            label = data[at + 1]
            body, at = _sub_blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = (body[0] >> 2) & 7, struct.unpack_from("<H", body, 1)[0]
                transparent = body[3] if body[0] & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown block {kind:#x}")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        own = palette
        if flags & 0x80:
            n = 2 << (flags & 7)
            own = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        minimum = data[at]
        stream, at = _sub_blocks(data, at + 1)
        pixels = lzw_decode(np.frombuffer(stream, np.uint8), minimum)
        if len(pixels) < w * h:
            raise ValueError("too few pixels")
        grid = pixels[: w * h].reshape(h, w)
        if flags & 0x40:
            order = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
            plain = np.empty_like(grid)
            plain[order] = grid
            grid = plain
        gif.frames.append(Frame(left, top, grid, own if own is not None else np.zeros((256, 3), np.uint8), delay, disposal, transparent))
        delay, disposal, transparent = 0, 0, None
    return gif


def canvases(gif: Gif) -> Iterator[np.ndarray]:
    """The RGBA canvas that each frame shows."""
    canvas = np.zeros((gif.height, gif.width), dtype="<u4")  # a pixel's four bytes as one number
    for f in gif.frames:
        before = canvas.copy() if f.disposal == 3 else None
        h, w = f.indices.shape
        area = canvas[f.top : f.top + h, f.left : f.left + w]
        grid = f.indices[: area.shape[0], : area.shape[1]]
        colours = np.full((256, 4), 255, dtype=np.uint8)
        colours[:, :3] = f.palette[np.minimum(np.arange(256), len(f.palette) - 1)]
        np.copyto(area, colours.view("<u4")[:, 0][grid], where=True if f.transparent is None else grid != f.transparent)
        yield canvas.copy().view(np.uint8).reshape(*canvas.shape, 4)
        if f.disposal == 2:
            area[:] = 0
        elif before is not None:
            canvas = before


def _shown(canvas: np.ndarray) -> np.ndarray:
    """The pixels of an RGBA canvas that aren't transparent, each as one number."""
    pixels = np.ascontiguousarray(canvas).view("<u4").ravel()
    return pixels[pixels >= 1 << 24]


def histogram(canvas: np.ndarray, bits: int = 2) -> np.ndarray:
    """Counts of the colours that show, by the top ``bits`` bits of red, green and blue."""
    v, least = _shown(canvas), (1 << bits) - 1
    slot = (((v >> (8 - bits)) & least) << 2 * bits) | (((v >> (16 - bits)) & least) << bits) | ((v >> (24 - bits)) & least)
    return np.bincount(slot, minlength=1 << (3 * bits))


def shown_bytes(canvas: np.ndarray) -> bytes:
    """The bytes whose colours of ``PALETTE`` a canvas shows, row by row."""
    v = _shown(canvas)
    return ((v & 0xE0) | ((v >> 11) & 0x1C) | ((v >> 22) & 3)).astype(np.uint8).tobytes()


def pad(text: bytes | np.ndarray) -> np.ndarray:
    data = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
    out = np.zeros(max(1, -(-len(data) // WIDTH)) * WIDTH, dtype=np.uint8)
    out[: len(data)] = data
    return out


def timed_frames(media: bytes) -> Iterator[tuple[int, int, Frame, np.ndarray]]:
    """(number, start in ms, frame, canvas shown) of a file's frames."""
    gif, start = decode_gif(media), 0
    for k, (f, canvas) in enumerate(zip(gif.frames, canvases(gif), strict=True)):
        yield k, start, f, canvas
        start += 10 * f.delay_cs


# --- operators ----------------------------------------------------------------


def encode_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's bytes as a GIF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in text_runs(batch.column(1)):
                media = [encode_gif(pad(data[at[k] : at[k + 1]])) for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_frames(media: DataFrame, id_col: str = "doc_id", col: str = "media") -> DataFrame:
    """One row per frame: id, frame, start_ms, delay_ms, left, top, width, height,
    disposal, histogram (64 bins, of the canvas shown), pixels (palette indices)."""
    schema = f"{id_col} long, frame int, start_ms long, delay_ms int, left int, top int, width int, height int, disposal int, histogram array<long>, pixels binary"
    kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.int32()] * 6, pa.list_(pa.int64()), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for key, data in zip(batch.column(0), batch.column(1), strict=True):
                if not data.is_valid:
                    continue
                for k, start, f, canvas in timed_frames(data.as_py()):
                    h, w = f.indices.shape
                    rows.append((key.as_py(), k, start, 10 * f.delay_cs, f.left, f.top, w, h, f.disposal, histogram(canvas).tolist(), f.indices.tobytes()))
                    held += w * h
                    if held > FLUSH:
                        yield packed(rows)
                        rows, held = [], 0
        yield packed(rows)

    return media.select(id_col, col).mapInArrow(run, schema)


def digest(n_bytes: int, media: bytes) -> tuple[int, int, str, int, int, str, str]:
    """What the query returns for one file, all but ``n_bytes`` from its stored frames."""
    sha, size, tail, bins, frames, ms = hashlib.sha256(), 0, b"", np.zeros(64, dtype=np.int64), 0, 0
    for _, start, f, canvas in timed_frames(media):
        raw = shown_bytes(canvas)
        sha.update(raw)
        size += len(raw)
        tail = (tail + raw)[-64:]
        bins += histogram(canvas)
        frames, ms = frames + 1, start + 10 * f.delay_cs
    shown = ",".join(f"{k}:{n}" for k, n in enumerate(bins.tolist()) if n)
    return n_bytes, size, sha.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), f"frames={frames};ms={ms};hist={shown}"


NAMES = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def read_digests(media: DataFrame) -> DataFrame:
    """doc_id and ``NAMES`` of rows (doc_id, n_bytes, media)."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [digest(n.as_py(), m.as_py()) for n, m in zip(batch.column(1), batch.column(2), strict=True)]
            cols = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", *NAMES])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_digests(encode_texts(table(spark, sf_dir, "documents")))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the query that SQL can express: lengths, and the payload's hash."""
    return query(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


ORACLE_PAYLOADS = """
WITH b AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT doc_id, t, n, 64 * greatest(1, (n + 63) // 64) AS size FROM b)
SELECT doc_id, n::BIGINT AS n_bytes, size::BIGINT AS payload_bytes, sha256(t || repeat(chr(0), (size - n)::BIGINT)) AS payload_sha256 FROM p
"""
