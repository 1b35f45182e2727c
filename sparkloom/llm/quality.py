"""Quality by Bradley-Terry pairwise ranking, thresholded at a score quantile.

A document's strength is linear in features of its whole text. Preference pairs
(a document labelled 1 over one labelled 0) give the logistic likelihood of
strength differences; it is maximised by Newton steps on the driver over at most
``SAMPLE`` labelled rows (in hash order) and ``PAIRS`` pairs, both parameters.
The threshold is the quantile of the sample's strengths at which the two labels
part best (balanced accuracy); a score is the logistic of the distance to it.

Features come from byte classes and word hashes of whole texts: shares of kinds
of bytes, word lengths, distinct and repeated words, capitals, words ending in
symbols, lines. Language, source and id are never features.

Defined cases: null or empty texts have features of 0 and get a score like any
other; with one label only, or none, every score is 0.5 and predicted 1; null
labels aren't learned from; a document labelled twice counts twice; equal texts
have equal scores; null ids are kept with held_out false; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, text_runs, word_bounds, word_hashes

SAMPLE, PAIRS, RIDGE = 20_000, 200_000, 1e-3

# Byte classes.
_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _MARK, _SYMBOL, _HIGH, _TAIL = range(9)
_CLASS = np.full(256, _SYMBOL, dtype=np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = _LOWER, _UPPER, _DIGIT
_CLASS[[32, 9, 11, 12, 13]] = _SPACE
_CLASS[10] = _LINE
_CLASS[[ord(c) for c in ".,;:'\"()?-"]] = _MARK
_CLASS[192:] = _HIGH
_CLASS[128:192] = _TAIL  # continuation bytes
NAMES = ["log_words", "upper", "digit", "space", "line", "mark", "symbol", "high", "word_length", "long_words", "distinct", "repeats", "top_word", "capital_words", "symbol_ends", "bare_symbols", "short_words", "log_lines", "distinct_lines", "sentence_marks"]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """texts x len(NAMES): the features of each text of a run."""
    n = len(offsets) - 1
    out = np.zeros((n, len(NAMES)))
    size = np.diff(offsets)
    if len(data) == 0:
        return out
    kind = _CLASS[data]
    owner = np.repeat(np.arange(n), size)
    counts = np.bincount(owner * 9 + kind, minlength=n * 9).reshape(n, 9).astype(np.float64)
    chars = np.maximum(counts.sum(axis=1) - counts[:, _TAIL], 1)
    starts, ends = word_bounds(data, offsets)
    at = np.searchsorted(starts, offsets)
    words = np.diff(at)
    some = np.maximum(words, 1)
    which = np.repeat(np.arange(n), words)
    share = lambda flags: np.bincount(which, weights=flags, minlength=n) / some
    for k, c in ((1, _UPPER), (2, _DIGIT), (3, _SPACE), (4, _LINE), (5, _MARK), (6, _SYMBOL), (7, _HIGH)):
        out[:, k] = counts[:, c] / chars
    out[:, 0] = np.log1p(words)
    if len(starts):
        length = (ends - starts).astype(np.float64)
        h = word_hashes(data, starts, ends)
        first, last = kind[starts], kind[ends - 1]
        inner_last = kind[np.maximum(ends - 2, starts)]
        same = np.zeros(len(h))
        same[1:] = (h[1:] == h[:-1]) & (which[1:] == which[:-1])
        out[:, 8] = np.log1p(share(length))
        out[:, 9] = share(length > 20)
        out[:, 11] = share(same)
        out[:, 13] = share((first == _UPPER) & (inner_last == _UPPER) & (length > 2))
        out[:, 14] = share((last == _SYMBOL) & (length > 1))
        out[:, 15] = share((first == _SYMBOL) & (length <= 2))
        out[:, 16] = share(length <= 2)
        for i in np.flatnonzero(words).tolist():
            _, c = np.unique(h[at[i] : at[i + 1]], return_counts=True)
            out[i, 10] = len(c) / words[i]
            out[i, 12] = c.max() / words[i]
    # Lines: hashes of byte ranges between newlines.
    breaks = np.flatnonzero(kind == _LINE)
    begin = np.unique(np.concatenate([offsets[:-1][size > 0], breaks + 1]))
    begin = begin[begin < len(data)]
    stop = np.minimum(np.append(begin[1:], len(data)), offsets[1:][owner[begin]])
    lines = word_hashes(data, begin, stop)
    of = owner[begin]
    out[:, 17] = np.log1p(np.bincount(of, minlength=n))
    low = np.searchsorted(of, np.arange(n + 1))
    for i in np.flatnonzero(np.diff(low) > 1).tolist():
        out[i, 18] = 1 - len(np.unique(lines[low[i] : low[i + 1]])) / (low[i + 1] - low[i])
    dots = np.isin(data, np.frombuffer(b".!?", np.uint8))
    out[:, 19] = np.bincount(owner[dots], minlength=n) / some
    return out


def expand(x: np.ndarray) -> np.ndarray:
    """Features as the model sees them: as they are, and shares saturated at a tenth."""
    return np.hstack([x, np.minimum(x, 0.1) * 10])


class Ranker:
    """Strengths learned from pairs, and the threshold that parts the labels."""

    def __init__(self, mean, scale, weights, threshold, spread):
        self.mean, self.scale, self.weights, self.threshold, self.spread = mean, scale, weights, threshold, spread

    def strength(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((expand(x) - self.mean) / self.scale, -8, 8)
        return z @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip((self.strength(x) - self.threshold) / self.spread, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 11) -> Ranker:
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranker(0, 1, None, 0, 1)
    z = expand(x)
    mean, scale = z.mean(axis=0), z.std(axis=0) + 1e-6
    z = np.clip((z - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    m = min(pairs, 50 * (len(good) + len(bad)))
    d = z[rng.choice(good, m)] - z[rng.choice(bad, m)]
    w = np.zeros(d.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # chance that a pair is the wrong way round
        gradient = d.T @ p / m - RIDGE * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / m + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w = w + step * min(1.0, 5 / (np.linalg.norm(step) + 1e-12))
        if np.linalg.norm(step) < 1e-6:
            break
    s = z @ w
    levels = np.unique(np.concatenate([np.linspace(0, 1, 401), [np.mean(y == 0)]]))
    cuts = np.quantile(s, levels)
    right = [np.mean(s[good] >= t) + np.mean(s[bad] < t) for t in cuts]
    best = np.flatnonzero(np.array(right) >= max(right) - 1e-9)
    t = float(np.mean(cuts[[best[0], best[-1]]]))  # the middle of the quantiles that part the labels equally well
    return Ranker(mean, scale, w, t, max(float(np.std(s)) / 4, 1e-6))


def _featured(docs: DataFrame) -> DataFrame:
    """label, x array<double> of rows (text, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in text_runs(batch.column(0)):
                x = features(data, at)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), lists], names=["label", "x"])

    return docs.mapInArrow(run, "label int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Ranker:
    """Fit on at most ``sample`` labelled rows, in the order of a hash of their ids."""
    chosen = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("label"))
    chosen = cut(chosen.orderBy(F.xxhash64("_id"), "_id", "label").limit(sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    got = _featured(rows.select("text", "label")).collect()  # bounded by ``sample``
    x = np.array([r.x for r in got]).reshape(len(got), len(NAMES))
    y = np.array([r.label for r in got], dtype=np.int64)
    order = np.lexsort([*x.T, y])  # the same whatever the order of arrival
    return fit(x[order], y[order])


def crc_mod(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n).cast("long"))


def score(docs: DataFrame, model: Ranker) -> DataFrame:
    """doc_id, score, predicted of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in text_runs(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(model.score(features(data, at)))], names=["doc_id", "score"])

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(crc_mod(3) != 1))
    return score(docs, model).select("doc_id", F.coalesce(crc_mod(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
