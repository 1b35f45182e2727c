"""Checks of partitions and order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partition_counts(df: DataFrame) -> DataFrame:
    """partition, rows: the rows of each partition that has any."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("rows"))


def is_sorted(df: DataFrame, key: str) -> bool:
    """Whether rows ascend by ``key`` in and across partitions, missing values last.

    Each partition reports its ends and whether it is in order; the driver sees a
    row per partition."""
    kind = df.schema[key].dataType.simpleString()

    def ends(frames):
        first = last = None
        rows, ordered, missing, nulls_then_value = 0, True, 0, False
        for f in frames:
            s = f[key]
            present = s[s.notna()]
            if len(present):
                if missing or (s.isna().to_numpy()[: int(s.notna().to_numpy().nonzero()[0][-1])].any()):
                    nulls_then_value = True
                ordered &= bool(present.is_monotonic_increasing) and (last is None or last <= present.iloc[0])
                first = present.iloc[0] if first is None else first
                last = present.iloc[-1]
            missing += int(s.isna().sum())
            rows += len(s)
        import pandas as pd
        from pyspark import TaskContext

        if rows:
            yield pd.DataFrame({"p": [TaskContext.get().partitionId()], "first": [first], "last": [last], "ok": [ordered and not nulls_then_value], "missing": [missing]})

    rows = df.select(key).mapInPandas(ends, f"p int, first {kind}, last {kind}, ok boolean, missing long").orderBy("p").collect()
    last, missing = None, 0
    for r in rows:
        if not r.ok or (missing and r["first"] is not None) or (last is not None and r["first"] is not None and last > r["first"]):
            return False
        last = r["last"] if r["last"] is not None else last
        missing += r.missing
    return True
