"""Partitioning: exchanges, and the operators that decide their kind."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.partitioning import hash_bucket
from .base import Operation

if TYPE_CHECKING:
    from ..plans.planner import Rates


class Sort(Operation):
    """Ascending by one column, missing values last. Where its own exchange of n
    partitions dealt the rows, these are ranges in order and are sorted inside; else
    it is a global sort."""

    def __init__(self, key: str):
        self.key = key

    def order(self):
        return F.col(self.key).asc_nulls_last()

    def run(self, df: DataFrame) -> DataFrame:
        return df.orderBy(self.order())

    def run_in_partitions(self, df: DataFrame) -> DataFrame:
        return df.sortWithinPartitions(self.order())

    def explain(self) -> str:
        return f"Sort ({self.key})"


class Groupby(Operation):
    """Names the key by which rows meet; the aggregate is the ``Reduce`` behind it."""

    def __init__(self, key: str = "0"):
        self.key = key

    def explain(self) -> str:
        return f"Groupby ({self.key})"


class Exchange(Operation):
    """All-to-all exchange at the end of a stage. The next stage's last ``Sort`` or
    ``Groupby`` decides its kind: ranges or hashes; without either rows are dealt evenly.

    ``partitions`` fixes the number of partitions; ``rates`` lets the cost model
    choose it by the plan's estimated size (or ``size`` bytes); without both
    adaptive execution chooses. ``stable`` deals a Groupby's rows by
    ``hash_bucket``: partition p holds bucket p in every engine and release."""

    def __init__(self, partitions: int | None = None, rates: Rates | None = None, size: int | None = None, stable: bool = False):
        if partitions is not None and partitions < 1:
            raise ValueError("partitions must be positive")
        if stable and partitions is None and rates is None:
            raise ValueError("stable buckets need a number of partitions")
        self.partitions, self.rates, self.size, self.stable = partitions, rates, size, stable

    @property
    def fixed(self) -> bool:
        """Whether the number of partitions is chosen here and not by Catalyst."""
        return self.partitions is not None or self.rates is not None

    def count(self, df: DataFrame) -> int | None:
        """The number of partitions for these rows; None where it's left open."""
        if self.partitions is not None or self.rates is None:
            return self.partitions
        from ..plans.planner import worker_count

        size = self.size if self.size is not None else int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return worker_count(size, self.rates)

    def deal(self, df: DataFrame, by: Operation | None) -> DataFrame:
        n = self.count(df)
        if self.stable and isinstance(by, Groupby):
            # A null key has no hash; it goes to the first bucket.
            return df.repartitionById(n, F.coalesce(hash_bucket(by.key, n), F.lit(0)).cast("int"))
        some = [n] if n else []
        if isinstance(by, Sort):
            return df.repartitionByRange(*some, by.order())
        if isinstance(by, Groupby):
            return df.repartition(*some, F.col(by.key))
        return df.repartition(*some) if n else df.hint("rebalance")

    def explain(self) -> str:
        return f"Exchange ({self.partitions or ('cost model' if self.rates else 'adaptive')})"
