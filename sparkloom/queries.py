"""Queries of the engine's own operators over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import segment_bounds, segment_id
from .operators import Collect, Exchange, Filter, Groupby, Reduce, Sample, Scan, Sort, Transform, Write
from .plans import Job
from .session import shared_dir, shared_path, ship_package

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
SEGMENTS = [12.0, 25.0, 40.0]
REVENUE = "round(l_extendedprice * (1 - l_discount), 4) AS revenue"


def _path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def _last(job: Job, spark: SparkSession) -> DataFrame:
    return job.plan(spark)[job.order()[-1]]


def _one_stage(spark: SparkSession, sf_dir: str, name: str, *ops) -> DataFrame:
    job = Job().add(0, Scan(_path(sf_dir, name)))
    for op in ops:
        job.add(0, op)
    return _last(job, spark)


def _two_stages(spark: SparkSession, sf_dir: str, name: str, exchange: Exchange, *ops, before: tuple = ()) -> DataFrame:
    job = Job().add(0, Scan(_path(sf_dir, name)))
    for op in (*before, exchange):
        job.add(0, op)
    for op in ops:
        job.add(1, op)
    return _last(job.dependency(0, 1), spark)


def _placed(df: DataFrame) -> DataFrame:
    """``df`` with each row's place, ``rn``, where the plan put it: rows of the
    partitions before its own, and its position in that. The rows are checkpointed, as
    a second run of a range exchange would sample other ranges."""
    shared_dir(df.sparkSession)
    rows = df.checkpoint().withColumn("_at", F.monotonically_increasing_id())
    part, position = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = rows.groupBy(part.alias("_p")).count()  # a row for each partition
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), part == F.col("_p")).withColumn("rn", F.col("_start") + position + 1).drop("_at", "_p", "_start")


def scan_lineitem(spark, sf_dir):
    return _one_stage(spark, sf_dir, "lineitem")


def filter_column(spark, sf_dir):
    return _one_stage(spark, sf_dir, "lineitem", Filter(F.col("l_quantity") > 45), Transform(["l_orderkey", "l_partkey", "l_quantity"]))


def _heavy(df: pd.DataFrame) -> pd.DataFrame:
    return df[df.l_quantity > 45]


def filter_callable(spark, sf_dir):
    return _one_stage(spark, sf_dir, "lineitem", Transform(["l_orderkey", "l_partkey", "l_quantity"]), Filter(_heavy))


def transform_column(spark, sf_dir):
    return _one_stage(spark, sf_dir, "lineitem", Transform(["l_orderkey", "l_linenumber", REVENUE]))


def _revenue(df: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"l_orderkey": df.l_orderkey, "l_linenumber": df.l_linenumber, "revenue": (df.l_extendedprice * (1 - df.l_discount)).round(4)})


def transform_callable(spark, sf_dir):
    return _one_stage(spark, sf_dir, "lineitem", Transform(["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"]), Transform(_revenue, "l_orderkey long, l_linenumber int, revenue double"))


SORT_ORDER = ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def sort_global(spark, sf_dir):
    """The key at each place of the operator's own order; rows of one key may take any of its places."""
    df = _two_stages(spark, sf_dir, "lineitem", Exchange(), Sort("l_extendedprice"), before=(Transform(SORT_ORDER),))
    return _placed(df).select("l_extendedprice", "rn")


def sort_string_key(spark, sf_dir):
    df = _two_stages(spark, sf_dir, "orders", Exchange(8), Sort("o_orderpriority"), before=(Transform(["o_orderkey", "o_orderpriority"]),))
    return _placed(df).select("o_orderpriority", "rn")


def sort_after_groupby(spark, sf_dir):
    """A sort behind an exchange that a Groupby dealt: it orders all rows, not each partition's."""
    df = _two_stages(spark, sf_dir, "lineitem", Exchange(8), Groupby("l_suppkey"), Reduce([F.round(F.sum("l_extendedprice"), 2).alias("sum_price")]), Sort("sum_price"))
    return _placed(df).select("sum_price", "rn")


def _aggs() -> list[Column]:
    return [F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n")]


def groupby_reduce(spark, sf_dir):
    return _two_stages(spark, sf_dir, "lineitem", Exchange(), Groupby("l_returnflag"), Reduce(_aggs()))


def _partial_sums(df: pd.DataFrame) -> pd.DataFrame:
    g = df.groupby("l_returnflag", as_index=False)
    return g.agg(qty=("l_quantity", "sum"), price=("l_extendedprice", "sum"), disc=("l_discount", "sum"), n=("l_quantity", "size"))


def _whole_sums(df: pd.DataFrame) -> pd.DataFrame:
    s = df.groupby("l_returnflag", as_index=False)[["qty", "price", "disc", "n"]].sum()
    return pd.DataFrame({"l_returnflag": s.l_returnflag, "sum_qty": s.qty.round(2), "sum_price": s.price.round(2), "avg_disc": (s.disc / s.n).round(6), "n": s.n})


def groupby_reduce_callable(spark, sf_dir):
    cols = ["l_returnflag", "l_quantity", "l_extendedprice", "l_discount"]
    reduce = Reduce(_whole_sums, "l_returnflag string, sum_qty double, sum_price double, avg_disc double, n long", combine=_partial_sums, combine_schema="l_returnflag string, qty double, price double, disc double, n long")
    return _two_stages(spark, sf_dir, "lineitem", Exchange(8), Groupby("l_returnflag"), reduce, before=(Transform(cols),))


def _count_keys(df: pd.DataFrame) -> pd.DataFrame:
    return df.groupby("o_custkey", as_index=False).size().rename(columns={"size": "n"})


def groupby_reduce_whole(spark, sf_dir):
    """A callable without a combine: it gets all rows of its keys."""
    return _two_stages(spark, sf_dir, "orders", Exchange(8), Groupby("o_custkey"), Reduce(_count_keys, "o_custkey long, n long"), before=(Transform(["o_custkey"]),))


def groupby_high_cardinality(spark, sf_dir):
    aggs = [F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.max("l_quantity").alias("max_qty"), F.count("*").alias("n")]
    return _two_stages(spark, sf_dir, "lineitem", Exchange(), Groupby("l_orderkey"), Reduce(aggs))


def reduce_global(spark, sf_dir):
    return _one_stage(spark, sf_dir, "lineitem", Reduce(_aggs()))


def exchange_hash_counts(spark, sf_dir):
    """Rows of each partition of an exchange by stable buckets."""
    df = _two_stages(spark, sf_dir, "lineitem", Exchange(7, stable=True), Groupby("l_orderkey"), before=(Transform(["l_orderkey"]),))
    return df.groupBy(F.spark_partition_id().alias("bucket")).agg(F.count("*").alias("n"))


def segment_bounds_numeric(spark, sf_dir):
    found = segment_bounds(_one_stage(spark, sf_dir, "lineitem"), "l_extendedprice", 5)
    return spark.createDataFrame([(i, round(b, 4)) for i, b in enumerate(found)], "i long, bound double")


def segment_bounds_string(spark, sf_dir):
    found = segment_bounds(spark.read.parquet(_path(sf_dir, "orders")), "o_orderpriority", 5)
    return spark.createDataFrame(list(enumerate(found)), "i long, bound string")


def segment_counts(spark, sf_dir):
    df = _one_stage(spark, sf_dir, "lineitem", Transform([segment_id("l_quantity", SEGMENTS).alias("segment")]))
    return df.groupBy("segment").agg(F.count("*").alias("n"))


def pipeline_filter_sort_write(spark, sf_dir):
    path = shared_path(spark, "sorted")
    job = Job().add(0, Scan(_path(sf_dir, "lineitem"))).add(0, Filter("l_discount >= 0.05")).add(0, Transform(SORT_ORDER)).add(0, Exchange(8))
    job.add(1, Sort("l_extendedprice")).add(1, Write(path)).dependency(0, 1).run(spark)
    return spark.read.parquet(path)


def exchange_range_rows(spark, sf_dir):
    df = _two_stages(spark, sf_dir, "orders", Exchange(8), Sort("o_totalprice"))
    parts = df.groupBy(F.spark_partition_id().alias("p")).agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.count("*").alias("n"))
    before = F.lag("high").over(Window.orderBy("p"))
    return parts.withColumn("apart", F.coalesce(F.col("low") >= before, F.lit(True))).agg(F.sum("n").alias("n"), F.bool_and("apart").alias("disjoint"))


def _size(df: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"n": [len(df)]})


def collect_partition_rows(spark, sf_dir):
    """Rows that the sink brought to the driver, which holds a slice of them at a time."""
    job = Job().add(0, Scan(_path(sf_dir, "orders"))).add(0, Transform(["o_custkey"])).add(0, Exchange(8))
    rows = job.add(1, Groupby("o_custkey")).add(1, Collect(_size)).dependency(0, 1).run(spark).rows
    return spark.createDataFrame([(int(rows.n.sum()),)], "n long")


def collect_rows(spark, sf_dir):
    """The collected rows themselves, a count for each of few keys."""
    job = Job().add(0, Scan(_path(sf_dir, "orders"))).add(0, Exchange())
    job.add(1, Groupby("o_orderstatus")).add(1, Reduce([F.count("*").alias("n")])).add(1, Collect()).dependency(0, 1)
    return spark.createDataFrame(job.run(spark).rows, "o_orderstatus string, n long")


def scan_csv(spark, sf_dir):
    """Delimited text, written without a header and read again with inferred types."""
    path = shared_path(spark, "lineitem-csv")
    rows = _one_stage(spark, sf_dir, "lineitem", Transform([*LINE[:-1], "date_format(l_shipdate, 'yyyy-MM-dd') AS l_shipdate"]))
    rows.write.csv(path)
    return _last(Job().add(0, Scan(path)), spark)


def csv_sort(spark, sf_dir):
    """The parallel sort of delimited text: scan, ranges, ordered part files."""
    source, to = shared_path(spark, "orders-csv"), shared_path(spark, "orders-sorted")
    _one_stage(spark, sf_dir, "orders", Transform(["o_orderpriority", "o_orderkey", "o_totalprice"])).write.csv(source, sep="|")
    job = Job().add(0, Scan(source, types=["string", "int64", "float64"], delimiter="|")).add(0, Exchange(6))
    job.add(1, Sort("2")).add(1, Write(to)).dependency(0, 1).run(spark)
    return spark.read.parquet(to)


def three_stages(spark, sf_dir):
    """Sum per order, then orders per rounded size, through two exchanges."""
    job = Job().add(0, Scan(_path(sf_dir, "lineitem"))).add(0, Exchange())
    job.add(1, Groupby("l_orderkey")).add(1, Reduce([F.sum("l_quantity").alias("qty")])).add(1, Transform(["floor(qty / 50) AS size"])).add(1, Exchange())
    job.add(2, Groupby("size")).add(2, Reduce([F.count("*").alias("n")]))
    return _last(job.dependency(1, 2).dependency(0, 1), spark)


def sample_keys(spark, sf_dir):
    return Sample("l_orderkey", 0.1, seed=17, by=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).run(spark.read.parquet(_path(sf_dir, "lineitem")))


Query = Callable[[SparkSession, str], DataFrame]
_ALL: list[Query] = [scan_lineitem, filter_column, filter_callable, transform_column, transform_callable, sort_global, sort_string_key, sort_after_groupby, groupby_reduce, groupby_reduce_callable, groupby_reduce_whole, groupby_high_cardinality, reduce_global, exchange_hash_counts, segment_bounds_numeric, segment_bounds_string, segment_counts, pipeline_filter_sort_write, exchange_range_rows, collect_partition_rows, collect_rows, three_stages, sample_keys, scan_csv, csv_sort]


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {q.__name__: _shipped(q) for q in _ALL}

_AGG_SQL = "round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n"
_ROWS = "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 45"
_REV = "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem"
_GROUP = f"SELECT l_returnflag, {_AGG_SQL} FROM lineitem GROUP BY l_returnflag"
ORACLE: dict[str, str] = {
    "scan_lineitem": "SELECT * FROM lineitem",
    "filter_column": _ROWS,
    "filter_callable": _ROWS,
    "transform_column": _REV,
    "transform_callable": _REV,
    "sort_global": "SELECT l_extendedprice, row_number() OVER (ORDER BY l_extendedprice) AS rn FROM lineitem",
    "sort_string_key": "SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) AS rn FROM orders",
    "sort_after_groupby": "SELECT sum_price, row_number() OVER (ORDER BY sum_price) AS rn FROM (SELECT round(sum(l_extendedprice), 2) AS sum_price FROM lineitem GROUP BY l_suppkey)",
    "groupby_reduce": _GROUP,
    "groupby_reduce_callable": _GROUP,
    "groupby_reduce_whole": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey",
    "groupby_high_cardinality": "SELECT l_orderkey, round(sum(l_extendedprice), 2) AS sum_price, max(l_quantity) AS max_qty, count(*) AS n FROM lineitem GROUP BY l_orderkey",
    "reduce_global": f"SELECT {_AGG_SQL} FROM lineitem",
    "exchange_hash_counts": "SELECT list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 33), lambda i: (strpos('0123456789abcdef', substring(md5(l_orderkey::VARCHAR), i::INT, 1)) - 1)::BIGINT)), lambda a, d: (a * 32 + d) % 7)::INT AS bucket, count(*) AS n FROM lineitem GROUP BY 1",
    "segment_bounds_numeric": "SELECT i::BIGINT - 1 AS i, round(b[i], 4) AS bound FROM (SELECT quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8]) AS b FROM lineitem), range(1, 5) t(i)",
    "segment_bounds_string": "SELECT i::BIGINT - 1 AS i, k[(i * len(k)) // 5 + 1] AS bound FROM (SELECT list(o_orderpriority ORDER BY o_orderpriority) AS k FROM orders), range(1, 5) t(i)",
    "segment_counts": "SELECT (CASE WHEN l_quantity > 12 THEN 1 ELSE 0 END + CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END + CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END)::INT AS segment, count(*) AS n FROM lineitem GROUP BY 1",
    "pipeline_filter_sort_write": f"SELECT {', '.join(SORT_ORDER)} FROM lineitem WHERE l_discount >= 0.05",
    "exchange_range_rows": "SELECT count(*) AS n, true AS disjoint FROM orders",
    "collect_partition_rows": "SELECT count(*) AS n FROM orders",
    "collect_rows": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus",
    "sample_keys": "SELECT l_orderkey FROM lineitem WHERE ('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, 17)), 1, 7))::BIGINT < ceil(0.1 * 268435456)",
    "scan_csv": 'SELECT l_orderkey AS "0", l_partkey AS "1", l_suppkey AS "2", l_linenumber::BIGINT AS "3", l_quantity AS "4", l_extendedprice AS "5", l_discount AS "6", l_tax AS "7", l_returnflag AS "8", l_linestatus AS "9", strftime(l_shipdate, \'%Y-%m-%d\') AS "10" FROM lineitem',
    "csv_sort": 'SELECT o_orderpriority AS "0", o_orderkey AS "1", o_totalprice AS "2" FROM orders',
    "three_stages": "SELECT size, count(*) AS n FROM (SELECT floor(sum(l_quantity) / 50)::BIGINT AS size FROM lineitem GROUP BY l_orderkey) GROUP BY size",
}
