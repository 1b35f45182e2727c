"""Opaque pandas functions over whole partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def empty_frame(df: DataFrame) -> pd.DataFrame:
    """The columns of ``df`` with their types and no rows; no job runs for it."""
    return df.sparkSession.createDataFrame([], df.schema).toPandas()


def each_batch(df: DataFrame, action: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str) -> DataFrame:
    """``action`` on each Arrow batch by itself; memory holds one batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield action(f).reset_index(drop=True)

    return df.mapInPandas(run, schema)


def whole_partition(df: DataFrame, action: Callable[[pd.DataFrame], Any], schema: StructType | str | None = None) -> DataFrame:
    """``action`` on each partition as one frame; an empty partition is a frame
    with the columns and no rows. Scalars and Series become frames. The worker's
    memory must hold a partition: choose partitions accordingly, or the
    declarative form, which has no such limit."""
    out = df.schema if schema is None else schema
    empty = empty_frame(df)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [f for f in frames if len(f)]
        result = action(pd.concat(parts, ignore_index=True) if parts else empty.copy())
        if isinstance(result, pd.Series):
            result = result.to_frame().T
        elif not isinstance(result, pd.DataFrame):
            result = pd.DataFrame({"value": [result]})
        yield result.reset_index(drop=True)

    return df.mapInPandas(run, out)
