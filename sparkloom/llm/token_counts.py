"""Token counts of sections by offset-mapped attribution.

Each document is encoded once, whole. A byte-level token's length gives its
place in the text, so running sums of lengths are the tokens' spans. Spans are
interval-joined to the sections (sorted, adjacent ranges) by binary search. A
token that crosses a boundary goes by an explicit rule:

* ``majority``: to the section that has most of its bytes, the earlier on a tie;
* ``first`` / ``last``: to the section of its first / last byte.

So the sections' counts add up to the document's. Sections are lines (each with
its newline) or, in ``count_fields``, columns joined by newlines.

Defined cases: null or empty text is one empty section without tokens; a null
field is an empty section; null ids are kept; texts of any length are counted
whole; repeated rows are separate; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_path, encoder
from .common import table, text_runs

RULES = ("majority", "first", "last")
SCHEMA = "doc_id long, section int, char_start long, char_end long, n_tokens long, n_crossing long"


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross a boundary."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    k = len(section_ends)
    if not len(token_ends):
        return np.zeros(k, np.int64), np.zeros(k, np.int64)
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, token_ends - 1, "right")
    crossing = np.flatnonzero(first != last)
    chosen = last.copy() if rule == "last" else first.copy()
    if rule == "majority":
        for t in crossing.tolist():
            inner = np.concatenate([[starts[t]], section_ends[first[t] : last[t]], [token_ends[t]]])
            chosen[t] = first[t] + int(np.argmax(np.diff(inner)))
    return np.bincount(chosen, minlength=k), np.bincount(chosen[crossing], minlength=k)


def _line_ends(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data == 10) + 1
    return ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))


def _count(texts: DataFrame, path: str, rule: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        lengths = enc.vocabulary.lengths
        for batch in batches:
            given = batch.column(2)
            for i, j, data, at in text_runs(batch.column(1)):
                raw = data.tobytes()
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                cols: list[list] = [[] for _ in range(6)]
                for k, ids in enumerate(enc.encode([raw[at[k] : at[k + 1]] for k in range(j - i)])):
                    a, b = int(at[k]), int(at[k + 1])
                    ends = np.array(given[i + k].as_py(), dtype=np.int64) if given[i + k].is_valid else _line_ends(data[a:b])
                    n, crossing = attribute(np.cumsum(lengths[ids]), ends, rule)
                    places = chars[a + ends] - chars[a]
                    cols[0].append(np.full(len(ends), k))
                    cols[1].append(np.arange(len(ends)))
                    cols[2].append(np.concatenate([[0], places[:-1]]))
                    cols[3].append(places)
                    cols[4].append(n)
                    cols[5].append(crossing)
                rows = [np.concatenate(c) for c in cols]
                ids_ = batch.column(0).slice(i, j - i).take(pa.array(rows[0]))
                yield pa.RecordBatch.from_arrays([ids_, pa.array(rows[1].astype(np.int32)), *(pa.array(r.astype(np.int64)) for r in rows[2:])], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return texts.mapInArrow(run, SCHEMA)


def count_lines(docs: DataFrame, path: str | None = None, rule: str = "majority") -> DataFrame:
    """One row per line: doc_id, section, char_start, char_end, n_tokens, n_crossing."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(None).cast("array<long>").alias("ends"))
    return _count(texts, path or default_path(), rule)


def count_fields(rows: DataFrame, fields: list[str], id_col: str = "doc_id", path: str | None = None, rule: str = "majority") -> DataFrame:
    """The same, with section k the k-th of ``fields``; all but the last end in a newline."""
    values = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    text = F.concat_ws("\n", *values)
    acc, ends = F.lit(0).cast("long"), []
    for k, v in enumerate(values):
        acc = acc + F.octet_length(v) + F.lit(int(k < len(values) - 1))
        ends.append(acc)
    return _count(rows.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.array(*ends).alias("ends")), path or default_path(), rule)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_lines(table(spark, sf_dir, "documents"))
