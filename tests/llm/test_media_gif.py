import hashlib
import struct
import zlib

import numpy as np
import pytest

from sparkloom.llm import media_gif as g


def lzw_plain(data, minimum=8, clear_when_full=True):
    """A textbook LZW encoder."""
    clear = 1 << minimum
    out, bits, n = bytearray(), 0, 0

    def put(code, width):
        nonlocal bits, n
        bits |= code << n
        n += width
        while n >= 8:
            out.append(bits & 255)
            bits >>= 8
            n -= 8

    width, table = minimum + 1, {bytes([i]): i for i in range(clear)}
    put(clear, width)
    nxt, w = clear + 2, b""
    for b in bytes(data):
        x = w + bytes([b])
        if x in table:
            w = x
            continue
        put(table[w], width)
        if nxt < 4096:
            table[x] = nxt
            nxt += 1
            if nxt - 1 == 1 << width and width < 12:
                width += 1
        elif clear_when_full:
            put(clear, width)
            width, table, nxt = minimum + 1, {bytes([i]): i for i in range(clear)}, clear + 2
        w = bytes([b])
    if w:
        put(table[w], width)
    if nxt == 1 << width and width < 12:
        width += 1
    put(clear + 1, width)
    if n:
        out.append(bits & 255)
    return np.frombuffer(bytes(out), np.uint8)


@pytest.mark.parametrize("minimum", [2, 4, 8])
@pytest.mark.parametrize("size", [1, 2, 5, 300, 5000, 60000])
def test_lzw_decodes_compressed_streams(minimum, size):
    rng = np.random.default_rng(size + minimum)
    for high in (2, 1 << minimum):
        data = rng.integers(0, high, size).astype(np.uint8)
        assert (g.lzw_decode(lzw_plain(data, minimum), minimum)[:size] == data).all()
    same = np.zeros(size, np.uint8)
    assert (g.lzw_decode(lzw_plain(same, minimum), minimum)[:size] == same).all()


@pytest.mark.parametrize("minimum", [2, 8])
def test_lzw_decodes_a_deferred_clear(minimum):
    """Codes go on at 12 bits with a full table, past 65,536 of them."""
    data = np.random.default_rng(minimum).integers(0, 1 << minimum, 600_000 if minimum == 8 else 900_000).astype(np.uint8)
    stream = lzw_plain(data, minimum, clear_when_full=False)
    assert len(stream) * 8 // 12 > 2 << 16
    assert (g.lzw_decode(stream, minimum)[: len(data)] == data).all()
    with_clear = lzw_plain(data, minimum)
    assert (g.lzw_decode(with_clear, minimum)[: len(data)] == data).all()


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 254 * 64, 65536, 65537, 300_000])
def test_payload_round_trip(size):
    data = np.random.default_rng(size).integers(0, 256, size).astype(np.uint8)
    padded = g.pad(data)
    assert len(padded) % 64 == 0 and len(padded) >= max(64, size) and len(padded) - size <= 64
    gif = g.decode_gif(g.encode_gif(padded))
    assert np.concatenate([f.indices.ravel() for f in gif.frames]).tobytes() == padded.tobytes()
    media = g.encode_gif(padded)
    n, p, sha, crc, m, msha, feature = g.digest(size, media)
    raw = data.tobytes() + b"\0" * (p - size)
    assert (n, sha, crc) == (size, hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
    assert m == len(media) and msha == hashlib.sha256(media).hexdigest() and f"frames={len(gif.frames)}" in feature


@pytest.mark.parametrize("minimum", [2, 4, 8])
@pytest.mark.parametrize("size", [0, 1, 2, 300, 5000, 60000])
def test_lzw_encodes_as_a_textbook_encoder(minimum, size):
    for high in (2, 1 << minimum):
        data = np.random.default_rng(size).integers(0, high, size).astype(np.uint8)
        stream = g.lzw_encode(data.tobytes(), minimum)
        assert (g.lzw_decode(stream, minimum) == data).all()
        if size:
            assert (stream == lzw_plain(data, minimum)).all()


def test_prose_gets_smaller_and_shows_composed_frames():
    text = ("the quick brown fox jumps over the lazy dog and then some more words follow it " * 400).encode()
    padded = g.pad(text)
    media = g.encode_gif(padded)
    assert len(media) < len(padded) / 2
    frames = list(g.timed_frames(media))
    assert [k for k, *_ in frames] == list(range(len(frames))) and len(frames) > 5
    assert [start for _, start, *_ in frames] == [10 * g.DELAY_CS * k for k in range(len(frames))]
    assert all(f.disposal == 2 and f.transparent == 255 for *_, f, _ in frames)
    assert b"".join(g.shown_bytes(c) for *_, c in frames) == padded.tobytes()
    assert len({c.shape for *_, c in frames}) == 1 and (frames[-1][3][..., 3] == 0).any()
    sums = sum(g.histogram(c) for *_, c in frames)
    want = np.bincount(((padded >> 6).astype(int) << 4) | ((padded >> 3).astype(int) & 3) << 2 | (padded.astype(int) & 3), minlength=64)
    assert (sums == want).all()


ROWS = [None, "", "a", "é中" * 40, "x" * 64, "prose and " * 30_000, "a", "a"]


def test_query_on_edge_rows(spark, tmp_path):
    rows = [(i, t, "m", -1, "f") for i, t in enumerate(ROWS)] + [(None, "no id", "m", -1, "f"), (3, "é中" * 40, "m", -1, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string, n_bytes int, feature string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = g.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 1 and sum(r.doc_id == 3 for r in got) == 2
    for r in got:
        raw = ("no id" if r.doc_id is None else ROWS[r.doc_id] or "").encode()
        padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        media = g.encode_gif(padded)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    same = {tuple(r)[1:] for r in got if r.doc_id in (2, 6, 7)}
    assert len(same) == 1
    df.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert g.query(spark, str(tmp_path / "none")).count() == 0


def test_stored_frames(spark):
    docs = spark.createDataFrame([(i, t, "p") for i, t in enumerate(ROWS)], "doc_id long, text string, pixels string")
    media = g.encode_texts(docs)
    assert {r.doc_id: r.n_bytes for r in media.collect()} == {i: len((t or "").encode()) for i, t in enumerate(ROWS)}
    frames = g.read_frames(media.unionByName(spark.createDataFrame([(99, 0, None)], media.schema))).collect()
    assert 99 not in {r.doc_id for r in frames}
    for i, t in enumerate(ROWS):
        mine = sorted((r for r in frames if r.doc_id == i), key=lambda r: r.frame)
        assert [r.frame for r in mine] == list(range(len(mine))) and [r.start_ms for r in mine] == [100 * k for k in range(len(mine))]
        assert sum(sum(r.histogram) for r in mine) == len(g.pad((t or "").encode()))
        assert b"".join(bytes(r.pixels) for r in mine).rstrip(b"\xff") == g.pad((t or "").encode()).tobytes()
        assert all(len(r.histogram) == 64 and r.disposal == 2 and (r.left, r.top, r.width) == (0, 0, 64) for r in mine)
    assert g.read_frames(media.limit(0)).count() == 0


def build(frames, palette, width, height):
    """frames: (left, top, grid, delay, disposal, transparent, local palette, interlaced)."""
    out = b"GIF89a" + struct.pack("<HHBBB", width, height, 0x80 | 1, 0, 0) + bytes(sum(palette, []))
    for left, top, grid, delay, disposal, clear, local, lace in frames:
        out += struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), delay, clear or 0, 0)
        h, w = grid.shape
        out += struct.pack("<BHHHHB", 0x2C, left, top, w, h, (0x80 | 1 if local else 0) | (0x40 if lace else 0))
        if local:
            out += bytes(sum(local, []))
        if lace:
            grid = np.concatenate([grid[0::8], grid[4::8], grid[2::4], grid[1::2]])
        out += b"\x02" + g._blocks(lzw_plain(grid.ravel().astype(np.uint8), 2))
    return out + b";"


def test_disposal_transparency_palettes_and_interlace():
    palette = [[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]]
    local = [[9, 9, 9], [7, 7, 7], [5, 5, 5], [3, 3, 3]]
    one = np.ones((9, 4), int)
    hole = np.array([[2, 0], [0, 2]])
    data = build(
        [(0, 0, one, 5, 1, None, None, False), (1, 1, hole, 7, 3, 0, None, False), (0, 0, hole, 9, 2, 0, None, False), (2, 2, hole, 1, 1, None, local, False), (0, 0, np.arange(36).reshape(9, 4) % 4, 1, 1, None, None, True)],
        palette, 4, 9,
    )
    gif = g.decode_gif(data)
    assert [f.delay_cs for f in gif.frames] == [5, 7, 9, 1, 1]
    c = list(g.canvases(gif))
    assert (c[0][..., :3] == [255, 0, 0]).all()
    assert c[1][1, 1].tolist() == [0, 255, 0, 255] and c[1][1, 2].tolist() == [255, 0, 0, 255]
    assert c[2][1, 1].tolist() == [0, 255, 0, 255] and c[2][0, 0].tolist() == [0, 255, 0, 255] and c[2][2, 2].tolist() == [255, 0, 0, 255]
    assert c[3][0, 0, 3] == 0 and c[3][2, 2, :3].tolist() == [5, 5, 5] and c[3][2, 3, :3].tolist() == [9, 9, 9]
    assert (gif.frames[4].indices == np.arange(36).reshape(9, 4) % 4).all()
    assert g.histogram(c[0]).sum() == 36 and g.histogram(c[0])[0b110000] == 36
    with pytest.raises(ValueError):
        g.decode_gif(data[:60])
    with pytest.raises(ValueError):
        g.decode_gif(b"PNG")
