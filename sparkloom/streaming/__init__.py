"""Stages without exchanges on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import Filter, Operation, Transform


def apply_stage(stream: DataFrame, ops: list[Operation]) -> DataFrame:
    """Declarative Filter and Transform operators on a streaming DataFrame."""
    for op in ops:
        if not isinstance(op, Filter | Transform) or (callable(op.action) and not hasattr(op.action, "_jc")):
            raise ValueError(f"{op.explain()} needs a whole partition; streams take declarative Filter and Transform")
        stream = op.run(stream)
    return stream


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what the source has now as Parquet, exactly once, and ends."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
