"""Filter, Transform and Reduce: declarative, which Catalyst optimises, or opaque."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame

from .base import Operation
from .pandas_partition import each_batch, whole_partition


def _name(action: Any) -> str:
    return getattr(action, "__name__", None) or str(action)


class Filter(Operation):
    """Keeps rows: a Column or SQL text (reaches the scan), or a function from a
    partition's frame to a frame of the same columns."""

    def __init__(self, action: Column | str | Callable):
        self.action = action

    def run(self, df: DataFrame) -> DataFrame:
        if isinstance(self.action, Column | str):
            return df.filter(self.action)
        return whole_partition(df, self.action)

    def explain(self) -> str:
        return f"Filter ({_name(self.action)})"


class Transform(Operation):
    """Projects: Columns or SQL texts, or a function with the schema it returns."""

    def __init__(self, action: Sequence[Column | str] | Callable, schema: Any = None):
        self.action, self.schema = action, schema

    def run(self, df: DataFrame) -> DataFrame:
        if callable(self.action) and not isinstance(self.action, Column):
            return whole_partition(df, self.action, self.schema)
        if isinstance(self.action, Column | str):
            return df.selectExpr(self.action) if isinstance(self.action, str) else df.select(self.action)
        from pyspark.sql import functions as F

        return df.select(*[F.expr(a) if isinstance(a, str) else a for a in self.action])

    def explain(self) -> str:
        return f"Transform ({_name(self.action)})"


class Reduce(Operation):
    """Aggregates: Columns (per key behind a ``Groupby``, else over everything;
    partial sums before the shuffle), or a function of each partition's frame.

    A function sees a partition, not a group: behind a hash exchange all rows of
    a key are in it, without an exchange the result depends on the partitions.
    ``combine`` (with ``combine_schema``) turns some of a key's rows into partial
    rows before the exchange, batch by batch, and the function then gets those: a hot
    key is no longer one task's rows. A combine must keep the key column."""

    def __init__(self, action: Sequence[Column] | Column | Callable, schema: Any = None, combine: Callable | None = None, combine_schema: Any = None):
        if (combine is None) != (combine_schema is None):
            raise ValueError("combine and combine_schema go together")
        self.action, self.schema, self.combine, self.combine_schema = action, schema, combine, combine_schema

    @property
    def declarative(self) -> bool:
        return isinstance(self.action, Column) or not callable(self.action)

    def aggregate(self, df: DataFrame, key: str | None) -> DataFrame:
        columns = [self.action] if isinstance(self.action, Column) else list(self.action)
        return (df.groupBy(key) if key is not None else df.groupBy()).agg(*columns)

    def partial(self, df: DataFrame) -> DataFrame:
        """Partial rows of ``combine``."""
        return each_batch(df, self.combine, self.combine_schema)

    def whole(self, df: DataFrame) -> DataFrame:
        """The function on each partition, of partial rows if there is a ``combine``."""
        return whole_partition(df, self.action, self.schema)

    def run(self, df: DataFrame) -> DataFrame:
        if self.declarative:
            return self.aggregate(df, None)
        return self.whole(df if self.combine is None else self.partial(df))

    def explain(self) -> str:
        return f"Reduce ({_name(self.action)})"
