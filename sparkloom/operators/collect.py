"""Sinks."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import remove_shared, shared_path
from .base import Operation
from .pandas_partition import empty_frame

#: Bytes of pickled rows that the driver reads at once; a longer row is read by itself.
SLICE_BYTES = 8 << 20


class Collect(Operation):
    """Brings the rows to the driver as a pandas frame, which its memory must hold.

    With ``each``, a function from a frame to a frame, the driver gets all rows slice by
    slice, in the order of the plan, and holds one slice; what it returns are the frames
    that the function made of the slices, one below the other. Without rows the function
    gets a frame with the columns and no rows."""

    def __init__(self, each: Callable[[pd.DataFrame], pd.DataFrame] | None = None):
        self.each = each

    def collect(self, df: DataFrame) -> pd.DataFrame:
        if self.each is None:
            return df.toPandas()
        path = shared_path(df.sparkSession, "collect")
        try:
            made = [self.each(f) for f in _slices(df, path)]
        finally:
            remove_shared(df.sparkSession, path)
        return pd.concat(made or [self.each(empty_frame(df))], ignore_index=True)


def _slices(df: DataFrame, path: str) -> Iterator[pd.DataFrame]:
    """The rows in frames of about ``SLICE_BYTES``, in order. The tasks write a folder for
    each slice to ``path``, so that a large partition doesn't come to the driver at once."""
    most = SLICE_BYTES

    def pickled(f: pd.DataFrame) -> Iterator[bytes]:
        data = pickle.dumps(f, pickle.HIGHEST_PROTOCOL)
        if len(f) > 1 and len(data) > most:
            for half in (f[: len(f) // 2], f[len(f) // 2 :]):
                yield from pickled(half)
        elif len(f):
            yield data

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, at, held = TaskContext.get().partitionId(), 0, 0
        for n, data in enumerate(d for f in frames for d in pickled(f)):
            at, held = (at + 1, len(data)) if held and held + len(data) > most else (at, held + len(data))
            yield pd.DataFrame({"n": [n], "rows": [data], "part": [part], "slice": [at]})

    schema = "n int, rows binary, part int, slice int"
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])  # names may clash or have dots
    plain.mapInPandas(pack, schema).write.partitionBy("part", "slice").parquet(path)
    packed = df.sparkSession.read.schema(schema).parquet(path)
    for part, at in sorted(map(tuple, packed.select("part", "slice").distinct().collect())):
        batches = packed.filter((F.col("part") == part) & (F.col("slice") == at)).select("n", "rows").collect()
        yield pd.concat([pickle.loads(b.rows) for b in sorted(batches, key=lambda b: b.n)], ignore_index=True).set_axis(df.columns, axis=1)


class Write(Operation):
    """Writes one part file per partition, in partition order; without a path, to
    the source's path with "-out" behind it."""

    def __init__(self, path: str | None = None, format: str = "parquet", mode: str = "errorifexists", **options: str):
        self.path, self.format, self.mode, self.options = path, format, mode, options

    def write(self, df: DataFrame, source: str | None = None) -> str:
        if self.path is None and source is None:
            raise ValueError("Write needs a path or a source")
        path = self.path or f"{source.rstrip('/')}-out"
        df.write.format(self.format).mode(self.mode).options(**self.options).save(path)
        return path

    def explain(self) -> str:
        return f"Write ({self.path or 'beside the source'})"
