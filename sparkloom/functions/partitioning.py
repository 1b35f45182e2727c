"""Partition numbers as Column expressions, and range bounds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..session import shared_dir


def hash_bucket(key: Column | str, n: int) -> Column:
    """A stable bucket in 0 .. n-1: the hex digits of md5(key as text) read in base
    32, modulo n. Three slices of the digits fit 64 bits each, so the bucket is plain
    arithmetic inside generated code; a null key has none."""
    if not 1 <= n <= 1 << 31:
        raise ValueError("n must be in 1 .. 2^31")
    digest = F.md5((F.col(key) if isinstance(key, str) else key).cast("string").cast("binary"))
    bucket = F.lit(0).cast("long")
    for at, size in ((1, 12), (13, 12), (25, 8)):
        part = F.conv(F.substring(digest, at, size), 32, 10).cast("long")
        bucket = (bucket * pow(32, size, n) + part % n) % n
    return bucket


def segment_id(key: Column | str, bounds: list) -> Column:
    """The range that holds a key: ``bounds[i-1] < key <= bounds[i]``; the last for missing keys."""
    c = F.col(key) if isinstance(key, str) else key
    if not bounds:
        return F.lit(0)
    found = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < c))
    return F.when(c.isNull(), F.lit(len(bounds))).otherwise(found).cast("int")


def segment_bounds_expr(key: str, n: int, accuracy: int | None = None) -> Column:
    """n - 1 interpolated quantiles of a numeric key as one aggregate; with
    ``accuracy`` approximate ones in bounded memory, for large inputs."""
    points = [i / n for i in range(1, n)]
    if accuracy:
        return F.percentile_approx(key, F.array(*[F.lit(p) for p in points]), F.lit(accuracy))
    return F.percentile(key, F.array(*[F.lit(p) for p in points]))


def segment_bounds(df: DataFrame, key: str, n: int) -> list:
    """n - 1 bounds of n ranges: interpolated quantiles of numbers, elements at
    floor(i / n * rows) of ordered texts. Missing keys don't count. Keys are ranked in
    the partitions of a range exchange, not in one task."""
    if n < 2:
        return []
    keys = df.select(F.col(key).alias("k")).filter(F.col("k").isNotNull())
    total = keys.count()
    if not total:
        return []
    if not isinstance(df.schema[key].dataType, NumericType):
        ranks = [int(i / n * total) for i in range(1, n)]
        by = _at_ranks(keys, ranks)
        return [by[r] for r in ranks]
    places = [i / n * (total - 1) for i in range(1, n)]
    by = _at_ranks(keys, [r for p in places for r in (math.floor(p), math.ceil(p))])
    out = []
    for p in places:
        low, high, part = float(by[math.floor(p)]), float(by[math.ceil(p)]), p - math.floor(p)
        out.append(low if low == high else (1 - part) * low + part * high)
    return out


def _at_ranks(keys: DataFrame, ranks: list[int]) -> dict:
    """The keys at these places of their order, counted from 0."""
    wanted = keys.sparkSession.createDataFrame([(w,) for w in sorted(set(ranks))], "w long")
    rows = _running(keys.groupBy("k").count())
    hit = rows.select("k", "s", "c").join(F.broadcast(wanted), (F.col("w") >= F.col("s")) & (F.col("w") < F.col("c")))
    return {r.w: r.k for r in hit.select("w", "k").collect()}


def _running(counts: DataFrame) -> DataFrame:
    """Running sums of key counts over range partitions, without one task for all.
    The partitions are checkpointed, as a second run would sample other ranges."""
    shared_dir(counts.sparkSession)
    parts = counts.repartitionByRange(F.col("k")).withColumn("p", F.spark_partition_id()).checkpoint()
    sums = {r.p: r.n for r in parts.groupBy("p").agg(F.sum("count").alias("n")).collect()}
    base, acc = [], 0
    for p in sorted(sums):
        base.append((p, acc))
        acc += sums[p]
    inner = Window.partitionBy("p").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = counts.sparkSession.createDataFrame(base, "p int, base long")
    rows = parts.withColumn("i", F.sum("count").over(inner)).join(F.broadcast(starts), "p")
    return rows.withColumn("c", F.col("base") + F.col("i")).withColumn("s", F.col("c") - F.col("count"))
