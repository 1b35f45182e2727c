"""Byte-level BPE: minimal acyclic transducer lexicon plus exact merges.

Encoding cuts a text into chunks (a run of non-space bytes with at most one
space before it, or a run of spaces) that the vocabulary's own pattern never
joins. Chunks are resolved once per worker and remembered in bounded caches:

1. ``Lexicon``: the corpus's ``LEXICON_WORDS`` most frequent space-led words in
   a minimal acyclic automaton (shared suffixes; Daciuk et al., 2000) whose
   arcs count words, so that a path's sum is the word's number and finds its
   token ids. The automaton is one file of flat arrays, made on the driver,
   shipped with ``addFile`` and memory-mapped by every worker.
2. Any other chunk is cut by the pattern and merged exactly, all unseen words
   of a batch at once: each step merges every word's lowest-ranked pair.

The words' counts are over all documents. The lexicon's size is a parameter; it
decides speed, never results. Texts with special tokens or with non-ASCII
spaces are cut by the exact pattern instead of by chunks.

Defined cases: null or empty text has no tokens and decodes to ''; texts of any
length are encoded whole (a word longer than ``LONG`` bytes is merged with a
heap); a null id is kept; repeated rows are separate; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import heapq
import io
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, text_runs, write_shared

LEXICON_WORDS = 1 << 16
LONG = 64
#: Entries of each of a worker's two cache generations.
CACHE = 200_000
_SPACES = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACES}\p{{L}}\p{{N}}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
_NONE = np.int32(2**31 - 1)


def _re(pattern: bytes):
    import re

    return re.compile(pattern)


CHUNKS = _re(rb" ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
ODD_SPACES = _re(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
WORDS = regex.compile(PATTERN)


def byte_characters() -> dict[str, int]:
    """The character by which the vocabulary file writes each byte: printable
    Latin-1 bytes as themselves, the others from U+0100 on in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    chars, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if chr(b) not in chars or chars[chr(b)] != b:
            chars[chr(256 + extra)] = b
            extra += 1
    return chars


# The settings of the files that this module encodes as the library does.
_PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}


def check_settings(spec: dict) -> None:
    """Fails on a tokenizer file whose settings mean other tokens than those made here."""
    cutter = spec.get("pre_tokenizer") or {}
    wrong = [k for k, v in _PRE_TOKENIZER.items() if cutter.get(k) != v]
    wrong += [k for k, v in _MODEL.items() if (spec["model"].get(k) or None) != (v or None)]
    wrong += ["normalizer"] if spec.get("normalizer") is not None else []
    wrong += [t["content"] for t in spec.get("added_tokens", []) if t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]]
    if wrong:
        raise ValueError(f"no byte-level BPE file of the known kind: {', '.join(wrong)}")


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_settings(spec)
        chars, vocab = byte_characters(), spec["model"]["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for word, i in vocab.items():
            self.tokens[i] = bytes(chars[c] for c in word)
        for word, i in self.special.items():
            self.tokens[i] = word
        self.byte_ids = np.zeros(256, dtype=np.int32)
        for c, b in chars.items():
            self.byte_ids[b] = vocab[c]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self._hash()
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        digits = np.zeros((size, len(str(size)) + 1), dtype=np.uint8)
        for i in range(size):
            text = f"{i},".encode()
            digits[i, : len(text)] = list(text)
        self.digits = digits
        self.cut_special = regex.compile(b"(" + b"|".join(regex.escape(s) for s in self.special) + b")") if self.special else None

    def _hash(self) -> None:
        """Pairs in an open-addressed table, for lookups of whole arrays."""
        bits = max(10, (len(self.pairs) * 6).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        keys = np.full(1 << bits, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.rank = np.full(1 << bits, _NONE, dtype=np.int32)
        self.made = np.zeros(1 << bits, dtype=np.int32)
        wanted = np.array([(a << 32) | b for a, b in self.pairs], dtype=np.uint64)
        slots = self._slot(wanted).tolist()
        probes = 1
        taken = bytearray(1 << bits)
        for slot, key, (rank, made) in zip(slots, wanted.tolist(), self.pairs.values(), strict=True):
            n = 1
            while taken[slot]:
                slot, n = (slot + 1) & self.mask, n + 1
            taken[slot] = 1
            keys[slot], self.rank[slot], self.made[slot] = key, rank, made
            probes = max(probes, n)
        self.keys, self.probes = keys, probes

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and merged ids of pairs; ``_NONE`` where a pair doesn't merge."""
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        slot = self._slot(keys)
        hit = self.keys[slot] == keys
        at = np.where(hit, slot, -1)
        empty = np.iinfo(np.uint64).max
        rest = np.flatnonzero(~hit & (self.keys[slot] != empty))
        for n in range(1, self.probes):
            if not len(rest):
                break
            s = (slot[rest] + n) & self.mask
            found = self.keys[s] == keys[rest]
            at[rest[found]] = s[found]
            rest = rest[~found & (self.keys[s] != empty)]
        ok = at >= 0
        return np.where(ok, self.rank[at], _NONE), self.made[at]

    # --- merging ---

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Token ids of words (little-endian, 32 bits) by the vocabulary's merges, exactly."""
        out = [b""] * len(words)
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        order = np.argsort(lengths, kind="stable")
        low = 0
        for high in (4, 8, 12, 16, 24, 40, LONG):
            group = order[(lengths[order] > low) & (lengths[order] <= high)]
            for k in range(0, len(group), 20_000):
                rows = group[k : k + 20_000]
                ids, n = self._merge_group([words[i] for i in rows.tolist()], lengths[rows], high)
                raw = ids[np.arange(high)[None, :] < n[:, None]].astype("<u4").tobytes()
                at = 0
                for i, end in zip(rows.tolist(), (4 * np.cumsum(n)).tolist(), strict=True):
                    out[i] = raw[at:end]
                    at = end
            low = high
        for i in order[lengths[order] > LONG].tolist():
            out[i] = self._merge_long(words[i]).astype("<u4").tobytes()
        return out

    def _merge_group(self, words: list[bytes], n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (words x width) and their numbers."""
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(len(words), width)
        ids = self.byte_ids[raw]
        out, counts, act = ids.copy(), n.copy(), np.arange(len(words))
        cols = np.arange(width)
        rank = np.full((len(words), width), _NONE, dtype=np.int32)
        made = np.zeros((len(words), width), dtype=np.int32)
        if width > 1:
            r, m = self.find(ids[:, :-1].ravel(), ids[:, 1:].ravel())
            rank[:, :-1], made[:, :-1] = r.reshape(len(words), -1), m.reshape(len(words), -1)
        rank[cols[None, :] >= n[:, None] - 1] = _NONE
        while len(act):
            rows = np.arange(len(act))
            at = rank.argmin(axis=1)
            done = rank[rows, at] == _NONE
            if done.any():
                out[act[done]], counts[act[done]] = ids[done], n[done]
                keep = ~done
                act, ids, rank, made, n, at = act[keep], ids[keep], rank[keep], made[keep], n[keep], at[keep]
                rows = np.arange(len(act))
                if not len(act):
                    break
            ids[rows, at] = made[rows, at]
            take = np.minimum(cols[None, :] + (cols[None, :] > at[:, None]), width - 1)
            flat = take + (rows * width)[:, None]
            ids, rank, made = ids.ravel()[flat], rank.ravel()[flat], made.ravel()[flat]
            rank[:, width - 1] = _NONE
            n = n - 1
            for shift in (-1, 0):  # the pairs left and right of the merged token
                p = at + shift
                ok = (p >= 0) & (p + 1 < n)
                q = np.clip(p, 0, width - 2)
                r, m = self.find(ids[rows, q], ids[rows, q + 1])
                here = p >= 0
                rank[rows[here], p[here]] = np.where(ok, r, _NONE)[here]
                made[rows[here], p[here]] = m[here]
        return out, counts

    def _merge_long(self, word: bytes) -> np.ndarray:
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after = [*range(1, len(ids)), -1]
        before = list(range(-1, len(ids) - 1))
        heap = [(self.pairs[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.pairs]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] != pair[0] or j < 0 or ids[j] != pair[1]:
                continue
            ids[i], ids[j] = self.pairs[pair][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (p := (ids[a], ids[b])) in self.pairs:
                    heapq.heappush(heap, (self.pairs[p][0], a, p))
        return np.array([t for t in ids if t >= 0], dtype=np.int32)

    # --- decoding ---

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of token ids."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.arange(total) + np.repeat(self.starts[ids] - (ends - n), n)]

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, each followed by a comma."""
        flat = self.digits[ids].ravel()
        return flat[flat != 0].tobytes()


# --- the lexicon -----------------------------------------------------------------

_MAGIC = b"MADFST01"
_FIELDS = (("keys", np.int64), ("target", np.int32), ("skip", np.int32), ("final", np.uint8), ("offset", np.int64), ("ids", np.int32))


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic automaton of the entries' words with their ids, as one file."""
    words = sorted(w for w in entries if w)
    children: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # (parent, byte, child) not yet shared

    def share(depth: int) -> None:
        while len(path) > depth:
            parent, byte, child = path.pop()
            key = (final[child], tuple(children[child].items()))
            children[parent][byte] = register.setdefault(key, child)

    last = b""
    for word in words:
        k = 0
        while k < min(len(word), len(last)) and word[k] == last[k]:
            k += 1
        share(k)
        state = path[-1][2] if path else 0
        for byte in word[k:]:
            children.append({})
            final.append(False)
            children[state][byte] = len(children) - 1
            path.append((state, byte, len(children) - 1))
            state = len(children) - 1
        final[state] = True
        last = word
    share(0)

    number, order, stack = {0: 0}, [0], [0]
    while stack:  # number the states that are left
        for child in children[stack.pop()].values():
            if child not in number:
                number[child] = len(order)
                order.append(child)
                stack.append(child)
    count: dict[int, int] = {}
    todo = [0]
    while todo:  # words below each state, children first
        s = todo[-1]
        missing = [c for c in children[s].values() if c not in count]
        if missing:
            todo.extend(missing)
        else:
            count[s] = final[s] + sum(count[c] for c in children[s].values())
            todo.pop()
    keys, target, skip = [], [], []
    for s in order:
        before = int(final[s])
        for byte, child in sorted(children[s].items()):
            keys.append(number[s] * 256 + byte)
            target.append(number[child])
            skip.append(before)
            before += count[child]
    flat, offset = [], [0]
    for w in words:
        flat.extend(entries[w])
        offset.append(len(flat))
    arrays = {"keys": keys, "target": target, "skip": skip, "final": [final[s] for s in order], "offset": offset, "ids": flat}
    out = io.BytesIO()
    out.write(_MAGIC)
    for name, kind in _FIELDS:
        a = np.array(arrays[name], dtype=kind)
        out.write(struct.pack("<q", len(a)))
        out.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
    return out.getvalue()


class Lexicon:
    """Memory-mapped automaton; looks up arrays of words."""

    def __init__(self, path: str):
        file = np.memmap(path, dtype=np.uint8, mode="r")
        if file[:8].tobytes() != _MAGIC:
            raise ValueError("not a lexicon")
        at = 8
        for name, kind in _FIELDS:
            n = int(file[at : at + 8].view(np.int64)[0])
            size = n * np.dtype(kind).itemsize
            setattr(self, name, file[at + 8 : at + 8 + size].view(kind))
            at += 8 + size + (-size % 8)
        self.states = len(self.final)

    def number(self, words: list[bytes]) -> np.ndarray:
        """Each word's number in sorted order, -1 for words that aren't there."""
        out = np.full(len(words), -1, dtype=np.int64)
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        if not len(self.keys):
            return out
        for low, high in ((0, 16), (16, LONG)):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            if not len(rows):
                continue
            grid = np.frombuffer(b"".join(words[i].ljust(high, b"\0") for i in rows.tolist()), np.uint8).reshape(-1, high)
            n, state, total = lengths[rows], np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            live = np.arange(len(rows))
            for k in range(high):
                live = live[n[live] > k]
                if not len(live):
                    break
                key = state[live] * 256 + grid[live, k]
                arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                ok = self.keys[arc] == key
                n[live[~ok]] = -1
                live, arc = live[ok], arc[ok]
                state[live] = self.target[arc]
                total[live] += self.skip[arc]
            hit = (n > 0) & (self.final[state] == 1)
            out[rows[hit]] = total[hit]
        return out

    def lookup(self, words: list[bytes]) -> list[bytes | None]:
        """Each word's token ids (little-endian, 32 bits), None for words that aren't there."""
        at = self.number(words)
        some = np.maximum(at, 0)
        if not len(self.keys):
            return [None] * len(words)
        ids = memoryview(self.ids).cast("B")
        return [None if k < 0 else bytes(ids[4 * a : 4 * b]) for k, a, b in zip(at.tolist(), self.offset[some].tolist(), self.offset[some + 1].tolist(), strict=True)]


# --- encoding ----------------------------------------------------------------------


class Encoder:
    """Encodes texts with caches of two generations, so that memory is bounded."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None, cache: int = CACHE):
        self.vocabulary, self.lexicon, self.limit = vocabulary, lexicon, cache
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _chunks(self, text: bytes) -> list[bytes]:
        if ODD_SPACES.search(text):
            return [w.encode() for w in WORDS.findall(text.decode("utf-8", "replace"))]
        return CHUNKS.findall(text)

    def _resolve(self, chunks: list[bytes]) -> None:
        """Puts all of ``chunks`` into the young generation."""
        young = self.young
        if self.lexicon is not None:
            rest = []
            for chunk, ids in zip(chunks, self.lexicon.lookup(chunks), strict=True):
                if ids is None:
                    rest.append(chunk)
                else:
                    young[chunk] = ids
            chunks = rest
        whole, parted, cuts = [], [], []
        for chunk in chunks:
            word = chunk[1:] if chunk[:1] == b" " else chunk
            if word.isalpha() or word.decode("utf-8", "replace").isalpha():  # letters alone are one word of the pattern
                whole.append(chunk)
            else:
                parted.append(chunk)
                cuts.append([w.encode() for w in WORDS.findall(chunk.decode("utf-8", "replace"))])
        young.update(zip(whole, self.vocabulary.merge(whole), strict=True))
        unseen = list({w for cut in cuts for w in cut})
        made = dict(zip(unseen, self.vocabulary.merge(unseen), strict=True))
        for chunk, cut in zip(parted, cuts, strict=True):
            young[chunk] = b"".join([made[w] for w in cut])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        v = self.vocabulary
        parts: list[list] = []  # chunks of each text; a special token is an int between lists
        wanted: set[bytes] = set()
        for text in texts:
            if v.cut_special is not None and v.cut_special.search(text):
                mixed: list = []
                for piece in v.cut_special.split(text):
                    mixed.append(v.special[piece] if piece in v.special else self._chunks(piece))
            else:
                mixed = [self._chunks(text)]
            parts.append(mixed)
            for m in mixed:
                if isinstance(m, list):
                    wanted.update(m)
        young, old = self.young, self.old
        if len(young) + len(wanted) > self.limit:
            self.old, self.young = young, {}
            young, old = self.young, self.old
        missing = []
        for chunk in wanted:
            if chunk not in young:
                if (known := old.get(chunk)) is not None:
                    young[chunk] = known
                else:
                    missing.append(chunk)
        if missing:
            self._resolve(missing)
        get = young.__getitem__
        out = []
        for mixed in parts:
            raw = b"".join(b"".join(map(get, m)) if isinstance(m, list) else int(m).to_bytes(4, "little") for m in mixed)
            out.append(np.frombuffer(raw, dtype="<u4"))
        return out


_encoders: dict[tuple[str, str | None], Encoder] = {}


def encoder(path: str, lexicon: str | None = None) -> Encoder:
    """This worker's encoder; its caches serve all of the worker's tasks."""
    key = (path, lexicon)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Vocabulary(path), Lexicon(SparkFiles.get(lexicon)) if lexicon else None)
    return _encoders[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def frequent_words(docs: DataFrame, words: int = LEXICON_WORDS) -> list[str]:
    """About the ``words`` most frequent words after a space, counted over all documents.

    A histogram of the counts gives the count above which at most ``words`` lie;
    only those go to the driver, whatever the number of partitions."""
    found = docs.select(F.explode(F.split(F.col("text").cast("string"), " ")).alias("word")).groupBy("word").count()
    fit = (F.col("count") > 2) & F.octet_length("word").between(1, LONG - 1) & ~F.col("word").rlike(r"[\x09-\x0D]")
    found = cut(found.filter(fit).withColumn("level", F.floor(F.log2("count") * 16).cast("int")))
    total, least = 0, None
    for r in found.groupBy("level").count().orderBy(F.desc("level")).collect():  # at most 16 levels for each doubling
        if total + r["count"] > words:
            break
        total, least = total + r["count"], r.level
    if least is None:
        return []
    return [r.word for r in found.filter(F.col("level") >= least).select("word").collect()]


def build_lexicon(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> str:
    """Compile the frequent words of ``docs``, ship the file; its name among the executors' files."""
    spark = docs.sparkSession
    chosen = sorted(b" " + w.encode() for w in frequent_words(docs, words))
    plain = [w for w in chosen if not ODD_SPACES.search(w)]
    ids = Encoder(Vocabulary(path), cache=2 * words + 1).encode(plain)
    data = compile_lexicon({w: i.tolist() for w, i in zip(plain, ids, strict=True)})
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    spark.sparkContext.addFile(write_shared(spark, name, data))
    return name


def encode(docs: DataFrame, path: str | None = None, lexicon: str | None = None) -> DataFrame:
    """doc_id, ids array<int>: token ids of each whole text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, lexicon)
        for batch in batches:
            for i, j, data, at in text_runs(batch.column(1)):
                raw = data.tobytes()
                ids = enc.encode([raw[at[k] : at[k + 1]] for k in range(j - i)])
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of token ids; bytes that aren't UTF-8 become U+FFFD."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = encoder(path).vocabulary
        for batch in batches:
            texts = [None if x is None else v.decode(np.array(x, dtype=np.int64)).tobytes().decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_digests(docs: DataFrame, path: str | None = None, words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (of the text decoded from the ids)."""
    path = path or default_path()
    lexicon = build_lexicon(docs, path, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, lexicon)
        v = enc.vocabulary
        for batch in batches:
            for i, j, data, at in text_runs(batch.column(1)):
                raw = data.tobytes()
                n, shas, decoded = [], [], []
                for ids in enc.encode([raw[at[k] : at[k + 1]] for k in range(j - i)]):
                    n.append(len(ids))
                    shas.append(hashlib.sha256(v.decimals(ids)[:-1]).hexdigest())
                    text = v.decode(ids).tobytes().decode("utf-8", "replace")
                    decoded.append(hashlib.sha256(text.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline, last stage: token counts and digests of every row that is left."""
    return encode_digests(docs)
