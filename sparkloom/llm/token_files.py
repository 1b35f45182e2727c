"""Token ids as Parquet lists, in document order, for selective reads.

Texts are range-partitioned and sorted by id, then encoded, so that ids are made
in their final place and never shuffled. Files hold, per document, its id, the
part it lies in, its start within the part, its length and the list of ids:

* ids are dictionary-encoded (a vocabulary fits one dictionary page);
* the sorted id and the running start are delta-encoded (format version 2);
* row groups and pages are small, with page indexes, so that a read of a few
  ids or of the metadata columns alone skips the rest.

A document's global start is its part's start (a sum over few rows, read from
the metadata columns) plus its start within the part.

A worker encodes each distinct word (between ASCII spaces) with the tokenizers
library once and remembers it in bounded caches; the tokenizer drops white
space and never joins across it, which makes that exact. Unseen words go to the
library many to a text; where each is letters, or letters before punctuation,
the vocabulary's word-end marks tell them apart again, and a text whose marks
don't add up is encoded word by word. Lower-case Latin words take the library's
model without the normalising steps, which leave them as they are. All that holds
for the settings in ``words_apart``; the library encodes whole texts for any other file.

Defined cases: null and empty texts hold the end id alone; null ids come first;
equal ids are ordered by text; repeated rows are separate; an empty table gives
no rows; other columns aren't read.
"""

from __future__ import annotations

import gc
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_characters
from .common import shared_path, table, text_runs

END_ID = 2
#: Distinct words of each of a worker's two cache generations.
CACHE = 420_000
#: Unseen words that are encoded as one text.
TOGETHER = 512
#: Lower-case Latin letters that no normalisation changes.
_LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: ASCII punctuation but the apostrophe, which may begin a word's ending.
_PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Row groups of 32 MB, pages of 64 KB or 2,000 rows.
LAYOUT = {
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "1",
}
SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


# The settings under which words between white space are encoded one by
# one as they are in a text. A file with other settings has whole texts encoded instead.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def words_apart(spec: dict) -> bool:
    """Whether a tokenizer file has the settings above, and no added token that white space or letters could be part of."""
    plain = spec["normalizer"] == _NORMALIZER and spec["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}
    model = all(spec["model"].get(k, v) == v for k, v in _MODEL.items()) and spec["model"].get("type") == "BPE"
    added = all(t["content"].startswith("<|") and not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not re.search(r"\s", t["content"]) for t in spec["added_tokens"])
    return plain and model and added


class _Words(dict):
    """Ids of each word. A word that isn't there takes them from the generation before,
    or gets an empty placeholder, to be filled in place, and is noted as pending."""

    def __init__(self, before: _Words | None = None):
        super().__init__()
        self.before = before
        self.pending: list[bytes] = []

    def __missing__(self, word: bytes) -> bytes | bytearray:
        ids = self.before.get(word) if self.before is not None else None
        if ids is None:
            ids = bytearray()
            self.pending.append(word)
        self[word] = ids
        return ids


class WordEncoder:
    """Token ids of texts from the library's ids of their distinct words."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.apart = words_apart(spec)
        if not self.apart:
            return
        # The same model without the steps that leave lower-case words alone: it takes
        # words in the characters by which the vocabulary writes their bytes.
        self.plain = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "truncation": None, "padding": None}))
        self.written = {b: c for c, b in byte_characters().items() if c != chr(b) and b != 32}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.limit = cache
        self.words = _Words()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not self.apart:
            return self._each(texts)
        if len(self.words) > self.limit:
            self.words.before = None
            self.words = _Words(self.words)
        gc.disable()  # nothing here has cycles, and the many new objects would set the collector off
        try:
            ids = self.words.__getitem__
            found = [list(map(ids, t.split())) for t in texts]
            if self.words.pending:
                self._resolve()
            return list(map(b"".join, found))
        finally:
            gc.enable()

    def _resolve(self) -> None:
        """Letters, in lower case as the tokenizer takes them, and what follows them are looked up apart."""
        words = self.words
        pending, words.pending = words.pending, []
        known, older = words.get, words.before.get if words.before is not None else {}.get
        found: dict[bytes, bytes] = {b"": b""}
        plain, other, tails = {}, {}, {}
        pairs = []
        for w in pending:
            head = w.rstrip(_PUNCTUATION)
            tail = w[len(head) :]
            if head.isalpha():
                head = head.lower()
                if head not in found:
                    # Most unseen words are seen ones with other punctuation or capitals.
                    if ids := known(head) or older(head):  # a placeholder is empty
                        found[head] = ids
                    else:
                        plain[head] = None
            elif head and (text := head.decode("utf-8", "replace")).isalpha():
                if _LATIN.fullmatch(text):
                    plain[head] = None
                else:
                    other[head] = None
            else:
                head, tail = b"", w
            if tail:
                tails[tail] = None
            pairs.append((w, head, tail))
        found.update(self._letters(list(plain), self.plain, self.written))
        found.update(self._letters(list(other), self.tokenizer))
        found.update(zip(tails, self._each(list(tails)), strict=True))
        for w, h, t in pairs:
            ids = found[h] + found[t]
            words[w][:] = ids  # the texts at hand hold the placeholder
            words[w] = ids
        for h in plain:
            if known(h) is None:
                words[h] = found[h]

    def _each(self, words: list[bytes]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in got]

    def _letters(self, words: list[bytes], tokenizer, written: dict[int, str] | None = None) -> dict[bytes, bytes]:
        """Ids of words of letters alone, ``TOGETHER`` to a text; with ``written``, in the
        characters that stand for bytes."""
        out: dict[bytes, bytes] = {}
        groups = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        texts = [b" ".join(g) for g in groups]
        texts = [t.decode("utf-8", "replace") if written is None or t.isascii() else t.decode("latin-1").translate(written) for t in texts]
        for group, e in zip(groups, tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) != len(group) or ends[-1] != 4 * len(ids):
                out.update(zip(group, self._each(group), strict=True))
                continue
            raw = ids.tobytes()
            out.update(zip(group, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        return out


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_sorted(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Rows of ``SCHEMA`` in ascending id order over the partitions."""
    path = path or default_path()
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, start, part = _encoder(path), 0, TaskContext.get().partitionId()
        for batch in batches:
            for i, j, data, at in text_runs(batch.column(1)):
                raw = data.tobytes()
                ids = [x + end for x in enc.encode([raw[at[k] : at[k + 1]] for k in range(j - i)])]
                n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                ends = np.concatenate([[0], np.cumsum(n)])
                flat = np.frombuffer(b"".join(ids), dtype="<i4")
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.full(j - i, part, np.int32)), pa.array(start + ends[:-1]), pa.array(n), lists], names=[x.split()[0] for x in SCHEMA.split(", ")])
                start += int(ends[-1])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, to: str, path: str | None = None, end_id: int = END_ID) -> None:
    encode_sorted(docs, path, end_id).write.mode("errorifexists").options(**LAYOUT).parquet(to)


def read_tokens(spark: SparkSession, at: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Documents of an id range (all by default); page indexes skip the others."""
    df = spark.read.parquet(at)
    if low is not None:
        df = df.filter(F.col("doc_id") >= low)
    if high is not None:
        df = df.filter(F.col("doc_id") <= high)
    return df


def part_starts(spark: SparkSession, at: str) -> DataFrame:
    """part, part_start: from the metadata columns alone, one row per written part."""
    sums = spark.read.parquet(at).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("part_start"))


def read_digests(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the stored lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            ends = lists.offsets.to_numpy()
            flat = memoryview(lists.values.to_numpy().astype("<u4").tobytes())
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(crc, pa.int64())], names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    rows = spark.read.parquet(at).select("doc_id", "part", "local_start", "n_tokens", "ids").mapInArrow(run, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    rows = rows.join(part_starts(spark, at), "part")
    return rows.select("doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), at)
    return read_digests(spark, at)
