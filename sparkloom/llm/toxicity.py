"""Toxicity by a weighted lexicon matched with Aho-Corasick on folded text.

Folding lowers case, maps look-alike letters (Cyrillic, Greek, full-width) and
digits or signs within words to the letters they stand for, and turns all other
ASCII into spaces. The lexicon holds whole words and word beginnings, learned
from labelled rows, near copies of one another counted once: a term's weight is its smoothed log ratio of document
frequencies, shrunk for rare terms, and it enters if the likelihood ratio speaks
for it more than chance would for any of the terms tried.
Word pairs around a term that only clean documents use become exception phrases;
a match inside one doesn't count. Per word the heaviest term counts; a text's sum
is divided by the root of its length in words, and a score is the logistic of
the distance to the level that parts the labels best.

The fit reads at most ``SAMPLE`` labelled rows in hash order, a parameter; each
document is scored over its whole text.

Defined cases: null or empty texts have no match; without rows of both labels,
or without terms, nothing is toxic (score below 0.5); null labels aren't learned
from; equal texts have equal scores; null ids are kept with held_out false and
by the pipeline's stage; other columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shingle_sets, table, text_runs
from .minhash import signatures
from .quality import crc_mod

SAMPLE = 20_000
#: Terms that a task counts before it passes its sums on.
FLUSH = 100_000
#: Terms that the driver weighs, a bound of the fit whatever the length of its texts.
MOST_TERMS = 1_000_000
#: Lengths of word beginnings that may become terms.
PREFIXES = (4, 5, 6, 7)
#: Least number of toxic documents with a term, and least log ratio. The least
#: likelihood ratio follows the number of terms tried, 2 ln(terms), and the
#: strongest term's, of which it must reach a share.
SUPPORT, WEIGHT, SHARE = 3, 3.0, 0.02
#: Documents by which the weight of a rare term is shrunk.
SHRINK = 4

# Letters that look like Latin ones.
_LOOKALIKES = str.maketrans(
    "абвгеёзијкмнорстухԁһѕіӏԛԝԍαβγεηικνορτυχωϲ",
    "a6bree3ujkmhopctyxdhsilqwgabyenikvoptuxwc",
)
#: Full-width ASCII by its rule.
_LOOKALIKES |= {0xFF01 + k: chr(0x21 + k) for k in range(94)}
_LOOKALIKE = re.compile(r"[Ͱ-ԯ！-～]")
# Digits and signs that stand for letters inside words.
_SIGNS = str.maketrans("013456789@$!", "oieasgtbgasi")
_SIGNED = re.compile(r"[a-z0-9@$!]*(?:[a-z][0-9@$!]|[0-9@$!][a-z])[a-z0-9@$!]*")
_HAS_SIGN = re.compile(r"[0-9@$!]")
_TO_SPACE = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def fold(text: str) -> str:
    """Folded words with one space before and after the text."""
    s = text.lower()
    if not s.isascii() and _LOOKALIKE.search(s):
        s = s.translate(_LOOKALIKES).lower()
    if _HAS_SIGN.search(s):
        s = _SIGNED.sub(_unsigned, s)
    return " " + s.encode("utf-8", "replace").translate(_TO_SPACE).decode("utf-8") + " "


def _unsigned(match: re.Match) -> str:
    word = match.group()
    core = word.rstrip("!@$")  # signs that only end a word stay signs
    return core.translate(_SIGNS) + word[len(core) :]


def terms_of(folded: str) -> set[str]:
    """Candidate terms of a text: ' word ' and the beginnings ' wor'."""
    out: set[str] = set()
    for w in set(folded.split()):
        if 3 <= len(w) <= 40:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in PREFIXES if len(w) >= k)
    return out


class Lexicon:
    """Terms with weights and exception phrases; picklable, built where it is used."""

    def __init__(self, terms: dict[str, float], exceptions: frozenset[str] = frozenset(), level: float = 1.0, slope: float = 4.0):
        self.terms, self.exceptions, self.level, self.slope = terms, exceptions, level, slope
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for t, w in self.terms.items():
                a.add_word(t, (len(t), w))
            for t in self.exceptions:
                a.add_word(t, (len(t), None))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def hits(self, folded: str) -> dict[int, float]:
        """Heaviest term's weight by the place of the space before a word."""
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        a = self.automaton()
        if not len(a):
            return found
        for end, (n, w) in a.iter(folded):
            start = end - n + 1
            if w is None:
                spared.append((start, end))
            elif w > found.get(start, 0.0):
                found[start] = w
        for s, e in spared:
            for k in [k for k in found if s <= k < e]:
                del found[k]
        return found

    def density(self, folded: str) -> float:
        found = self.hits(folded)
        return sum(found.values()) / math.sqrt(folded.count(" ") + 1) if found else 0.0

    def score(self, density: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * (math.log1p(density) - math.log1p(self.level))))))


def weigh(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Weights of the terms that labelled documents speak for."""
    base = n_toxic / (n_toxic + n_clean)

    def evidence(a: int, b: int) -> float:
        n = a + b
        return 2 * (a * math.log(a / (n * base)) + (b * math.log(b / (n * (1 - base))) if b else 0))

    speaks = {t: evidence(a, clean.get(t, 0)) for t, a in toxic.items()}
    least = max(2 * math.log(len(toxic) + 1), SHARE * max(speaks.values(), default=0.0))
    out = {}
    for t, a in toxic.items():
        weight = math.log((a + 0.5) / (n_toxic + 1)) - math.log((clean.get(t, 0) + 0.5) / (n_clean + 1))
        if a >= SUPPORT and weight >= WEIGHT and speaks[t] >= least:
            out[t] = weight * a / (a + SHRINK)
    # A beginning that a longer term explains with fewer clean documents isn't needed.
    for t in sorted(out, key=len, reverse=True):
        for k in PREFIXES:
            p = t[: k + 1]
            if p in out and p != t and toxic[t] >= 0.9 * toxic[p] and clean.get(t, 0) < clean.get(p, 0):
                del out[p]
    return out


def level_of(toxic: list[float], clean: list[float]) -> float:
    """The density that parts the labels best, in the middle of the gap."""
    values = np.array(toxic + clean)
    is_toxic = np.array([1] * len(toxic) + [0] * len(clean))
    order = np.argsort(values, kind="stable")
    v, y = values[order], is_toxic[order]
    missed, spared = np.cumsum(y) / max(len(toxic), 1), np.cumsum(1 - y) / max(len(clean), 1)
    ends = np.flatnonzero(np.diff(np.append(v, np.inf)) > 0)
    gain = np.round(spared[ends] - missed[ends], 12)
    best = ends[np.argmax(gain)]
    if best == len(v) - 1:
        return float(v[-1]) + 1.0
    # Closer to the clean side where it has no match at all, so that one term in a long text is enough.
    return float(v[best + 1] / 2) if v[best] == 0 else float((v[best] + v[best + 1]) / 2)


def _counted(rows: DataFrame, count, least: int = SUPPORT) -> dict[tuple[str, int], int]:
    """Sums of each partition's counters (term, label) over all partitions, of terms in
    ``least`` documents or more, the most frequent ``MOST_TERMS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def sums() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int32()), pa.array(list(total.values()), pa.int64())], names=["term", "label", "n"])
            total.clear()
            return out

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for term in count(fold(text or ""), label):
                    total[term, label] += 1
                if len(total) > FLUSH:
                    yield sums()
        yield sums()

    found = rows.select("text", "label").mapInArrow(run, "term string, label int, n long").groupBy("term", "label").agg(F.sum("n").alias("n"))
    found = found.filter(F.col("n") >= least).orderBy(F.desc("n"), "term", "label").limit(MOST_TERMS)
    return {(r.term, r.label): r.n for r in found.collect()}


def _one_of_each(rows: DataFrame, sketches: int = 8) -> list[int]:
    """Ids of the rows less near copies, whose rare words would look like evidence: one
    that shares all of ``sketches`` MinHash values but one with an earlier one of its
    label goes, which takes a similarity of about 0.8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in text_runs(batch.column(1)):
                sig = signatures(shingle_sets(data, at, 3)[0], sketches).T.astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, sketches, dtype=np.int32)), pa.array(sig.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), lists], names=["_id", "label", "sig"])

    found = rows.select("_id", "text", "label").mapInArrow(run, "_id long, label int, sig array<long>").collect()
    return unlike(sorted((r._id, r.label, tuple(r.sig)) for r in found))


def unlike(rows: list[tuple[int, int, tuple[int, ...]]]) -> list[int]:
    """Ids of the rows (id, label, sketch) less those whose sketch differs in one value
    at most from an earlier one of their label. Such two agree on a whole half."""
    halves: dict[tuple, list[tuple[int, ...]]] = {}
    kept = []
    for i, label, sig in rows:
        middle = len(sig) // 2
        keys = [(label, 0, sig[:middle]), (label, 1, sig[middle:])]
        like = {other for k in keys for other in halves.get(k, ())}
        if any(sum(a != b for a, b in zip(sig, other, strict=True)) <= 1 for other in like):
            continue
        kept.append(i)
        for k in keys:
            halves.setdefault(k, []).append(sig)
    return kept


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Lexicon:
    """Learn terms, exceptions and level from at most ``sample`` labelled rows."""
    chosen = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("label"))
    chosen = cut(chosen.orderBy(F.xxhash64("_id"), "_id", "label").limit(sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("_id", "text", "label")
    rows = cut(rows)  # bounded by ``sample``; read several times below
    alone = docs.sparkSession.createDataFrame([(i,) for i in _one_of_each(rows)], "_id long")
    rows = cut(rows.join(F.broadcast(alone), "_id", "left_semi"))
    n = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if not n.get(0) or not n.get(1):
        return Lexicon({})
    spark = docs.sparkSession
    toxic = {t: k for (t, _), k in _counted(rows.filter("label = 1"), lambda folded, _: terms_of(folded)).items()}
    wanted = spark.sparkContext.broadcast(frozenset(toxic))  # terms of SUPPORT or more of at most ``sample`` texts
    clean_hits = _counted_all(rows.filter("label = 0"), lambda folded: terms_of(folded) & wanted.value)
    terms = weigh(toxic, clean_hits, n[1], n[0])
    lexicon = Lexicon(terms)

    def pairs(folded: str, _: int) -> set[str]:
        words, out = folded.split(), set()
        if not lexicon.hits(folded):
            return out
        for a, b in zip(words, words[1:], strict=False):
            if lexicon.hits(f" {a} {b} "):
                out.add(f" {a} {b} ")
        return out

    around = _counted(rows, pairs, 1)  # one toxic document with a phrase is enough to rule it out
    exceptions = frozenset(t for (t, y), k in around.items() if y == 0 and k >= SUPPORT and (t, 1) not in around and 2 * k * math.log((n[0] + n[1]) / n[0]) >= 4)
    lexicon = Lexicon(terms, exceptions)
    dense: dict[int, list[float]] = {0: [], 1: []}
    for r in _densities(rows, lexicon).collect():
        dense[r.label].append(r.density)
    lexicon.level = level_of(dense[1], dense[0])
    return lexicon


def _counted_all(rows: DataFrame, terms) -> dict[str, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total.update(terms(fold(text or "")))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    found = rows.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r.term: r.n for r in found.collect()}  # at most one row for each wanted term


def _densities(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.density(fold(t or "")) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.float64())], names=["label", "density"])

    return rows.select("text", "label").mapInArrow(run, "label int, density double")


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, predicted, n_hits of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in text_runs(batch.column(1)):
                raw = data.tobytes()
                scores, hits = [], []
                for k in range(j - i):
                    folded = fold(raw[at[k] : at[k + 1]].decode("utf-8", "replace"))
                    found = lexicon.hits(folded)
                    hits.append(len(found))
                    scores.append(lexicon.score(sum(found.values()) / math.sqrt(folded.count(" ") + 1) if found else 0.0))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(scores, pa.float64()), pa.array(hits, pa.int64())], names=["doc_id", "score", "n_hits"])

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, n_hits long")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = train(docs, labels.filter(crc_mod(5) != 0))
    return score(docs, lexicon).select("doc_id", F.coalesce(crc_mod(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "n_hits")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: drop the documents that the lexicon, learned from ``labels`` over
    ``docs``, finds toxic. Rows are filtered where they are read; texts aren't shuffled."""
    lexicon = train(docs, table(spark, sf_dir, "labels").filter(crc_mod(5) != 0))

    return docs.filter(~_is_toxic(lexicon)(F.col("text").cast("string")))


def _is_toxic(lexicon: Lexicon):
    @F.pandas_udf("boolean")
    def toxic(texts: pd.Series) -> pd.Series:
        return pd.Series([lexicon.score(lexicon.density(fold(t or ""))) >= 0.5 for t in texts], dtype=bool)

    return toxic
