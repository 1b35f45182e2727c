import tracemalloc
from pathlib import Path
from urllib.parse import urlparse

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import sparkloom as sl
from sparkloom import queries as q
from sparkloom.functions import hash_bucket, is_sorted, partition_counts, random_strings, segment_bounds, segment_id
from sparkloom.plans import Job, approx_rows, shuffle_seconds, stage_seconds, worker_count
from sparkloom.plans.planner import Rates
from sparkloom.sources import NA_TOKENS, scan_csv
from sparkloom.streaming import apply_stage, write_available


def views(sf):
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def same(a: pd.DataFrame, b: pd.DataFrame):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for c in cols:
        if a[c].dtype.kind == "f":
            assert (a[c] - b[c]).abs().max() < 1e-6 or len(a) == 0, c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_query_equals_sql(spark, sf, name):
    same(q.QUERIES[name](spark, sf).toPandas(), views(sf).execute(q.ORACLE[name]).df())


def test_sample_is_seeded_and_of_the_keys(spark, sf):
    a, b = (q.QUERIES["sample_keys"](spark, sf).toPandas() for _ in range(2))
    assert a.equals(b) and 400 < len(a) < 800
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    assert len(sl.Sample("l_orderkey").bounds(line, 4)) == 3


# --- sources ---


def typed(spark, tmp_path, text, **kw):
    path = tmp_path / "x.csv"
    path.write_text(text)
    return scan_csv(spark, str(path), **kw)


def test_csv_types_as_pandas(spark, tmp_path):
    text = '1,1.5,a,2020-01-01,True,1,\n\n2,2,"say ""x""",x,false,NA,\n3,nan,"b,c",NULL,FALSE,3,\n'
    got = typed(spark, tmp_path, text)
    want = pd.read_csv(tmp_path / "x.csv", header=None)
    assert dict(got.dtypes) == {"0": "bigint", "1": "double", "2": "string", "3": "string", "4": "boolean", "5": "double", "6": "double"}
    rows = got.toPandas()
    for k in range(7):
        for a, b in zip(rows[str(k)], want[k], strict=True):
            assert (pd.isna(a) and pd.isna(b)) or a == b


def test_csv_header_is_data_and_delimiters(spark, tmp_path):
    assert typed(spark, tmp_path, "name|n\na|1\n", delimiter="|").collect()[0] == ("name", "n")
    assert len(NA_TOKENS) == 19


@pytest.mark.parametrize("text,rows", [("", 0), ("7\n", 1), ("7", 1), ("x" * 10_000 + "\n", 1)])
def test_csv_any_size(spark, tmp_path, text, rows):
    assert typed(spark, tmp_path, text).count() == rows


def test_csv_declared_types(spark, tmp_path):
    df = typed(spark, tmp_path, "1,2,x\n3,,y\n", types=["int32", "float64", "object"])
    assert dict(df.dtypes) == {"0": "int", "1": "double", "2": "string"}
    with pytest.raises(ValueError):
        typed(spark, tmp_path, "1,2\n", types=["int64"])
    assert typed(spark, tmp_path, "", types=["int64", "bool"]).count() == 0


def test_csv_lines_are_read_once(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("".join(f"{i:07d}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16000")
    try:
        df = scan_csv(spark, str(path))
        assert df.count() == 20_000 and df.agg(F.countDistinct("0")).first()[0] == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


# --- jobs ---


@pytest.fixture
def terasort(spark, tmp_path):
    random_strings(spark, 5_000, partitions=4).select("key", "id").coalesce(1).write.csv(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_parallel_sort_of_a_csv(spark, terasort, tmp_path):
    out = str(tmp_path / "out")
    job = sl.Job(num_stages=2)
    job.add(0, op=sl.Scan, path=terasort).add(0, op=sl.Exchange, partitions=4).add(1, op=sl.Sort, key="0").add(1, op=sl.Write, path=out)
    job.dependency(0, 1)
    assert "prep: Sample (0)" in job.explain() and "Stage 1:" in job.explain()
    assert "rangepartitioning" in job.explain(spark)
    assert job.run(spark).path == out
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    assert 2 <= len(parts) <= 4
    keys = pd.concat([pd.read_parquet(p) for p in parts])["0"]
    assert len(keys) == 5_000 and keys.is_monotonic_increasing


def test_group_and_reduce_sees_whole_keys(spark, terasort):
    def count(df):
        assert {"0", "1"} <= set(df.columns)
        return df.groupby("k", as_index=False).size().rename(columns={"size": "n"})

    job = sl.Job().add(0, sl.Scan(terasort)).add(0, sl.Transform(["`0`", "`1`", "`1` % 7 AS k"])).add(0, sl.Exchange(16))
    job.add(1, sl.Groupby("k")).add(1, sl.Reduce(count, "k long, n long")).add(1, sl.Collect()).dependency(0, 1)
    rows = job.run(spark).rows
    assert sorted(rows.k) == list(range(7)) and rows.n.sum() == 5_000


def test_counts_cycles_and_misuse(spark, terasort):
    assert sum(sl.Job().add(0, sl.Scan(terasort)).run(spark).counts.values()) == 5_000
    with pytest.raises(ValueError):
        sl.Job(1).dependency(0, 1)
    with pytest.raises(ValueError):
        Job().add(0, sl.Sort("0")).add(1, sl.Sort("0")).dependency(0, 1).dependency(1, 0).run(spark)
    with pytest.raises(ValueError):
        Job(3).dependency(0, 2).dependency(1, 2)
    with pytest.raises(ValueError):
        Job().add(0, sl.Sort("0")).run(spark)
    with pytest.raises(TypeError):
        Job().add(0, op=sl.Sort, key="0", other=1)
    assert sl.Operation().explain() == "Operation" and sl.Operation().run("x") == "x"


def test_scalars_and_empty_partitions(spark):
    df = spark.createDataFrame([], "a long, b string")
    got = sl.Reduce(lambda f: f.a.sum(), "value double").run(df.repartition(3)).collect()
    assert all(r.value == 0 for r in got)
    assert sl.Filter(lambda f: f[f.a > 1]).run(df).count() == 0


def test_filters_reach_the_scan(spark, sf):
    plan = sl.Job().add(0, sl.Scan(f"{sf}/lineitem.parquet")).add(0, sl.Filter("l_quantity > 45")).add(0, sl.Transform(["l_orderkey"])).explain(spark)
    assert "GreaterThan(l_quantity,45.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_sort_puts_missing_last_and_checks_order(spark):
    df = spark.createDataFrame([(x,) for x in (3, None, 1, 2, None, 1)], "k int")
    out = sl.Sort("k").run(df)
    assert [r.k for r in out.collect()] == [1, 1, 2, 3, None, None]
    assert is_sorted(out, "k") and not is_sorted(df.coalesce(1), "k")
    assert partition_counts(df.repartition(1)).first().rows == 6


# --- partitioning ---


def test_hash_bucket_by_hand(spark):
    import hashlib

    keys = ["gfhfdjhf", "fjdwbfjekfe", "jefhk", "", "é", "123"]
    got = {r.k: r.b for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", hash_bucket("k", 41).alias("b")).collect()}
    assert got == {k: int(hashlib.md5(k.encode()).hexdigest(), 32) % 41 for k in keys}


def test_segments(spark):
    df = spark.createDataFrame([(float(i), f"{i:03d}") for i in range(1000)] + [(None, None)], "n double, s string")
    b = segment_bounds(df, "n", 4)
    assert b == [249.75, 499.5, 749.25]
    assert segment_bounds(df, "s", 4) == ["250", "500", "750"]
    counts = {r.g: r["count"] for r in df.groupBy(segment_id("n", b).alias("g")).count().collect()}
    assert counts == {0: 250, 1: 250, 2: 250, 3: 251}
    assert segment_bounds(df.limit(0), "n", 4) == [] == segment_bounds(df.limit(0), "s", 4)


def test_planner_by_hand():
    r = Rates(1e8, 1e8, 1000, 1000)
    size = 10**9
    p, objects = 5, 25
    assert shuffle_seconds(size, p, r) == 2 * max(size / (1e8 * p), objects / 1000)
    assert stage_seconds(size, p, r) > shuffle_seconds(size, p, r)
    assert 3 <= worker_count(size, r) <= 9
    assert worker_count(10**13, r) >= 1000 and worker_count(0, r) == 3
    assert approx_rows(10_000, 1_000, 10) == 100 and approx_rows(10, 0, 0) == 0


def test_generator_is_reproducible(spark):
    a, b = (sorted(random_strings(spark, 100, partitions=p).collect()) for p in (1, 7))
    assert a == b and all(len(r.key) == 10 for r in a)


def test_stream_of_declarative_operators(spark, sf, tmp_path):
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf}/orders.parquet").write.parquet(str(tmp_path / "in/a"))
    schema = spark.read.parquet(f"{sf}/orders.parquet").schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))
    query = write_available(apply_stage(stream, [sl.Filter("o_totalprice > 1000"), sl.Transform(["o_orderkey"])]), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(f"{sf}/orders.parquet").filter("o_totalprice > 1000").count()
    with pytest.raises(ValueError):
        apply_stage(stream, [sl.Sort("o_orderkey")])


def test_random_bytes_are_a_file():
    from sparkloom.functions import RandomBytes

    f = RandomBytes(RandomBytes.BLOCK * 2 + 10, seed=3)
    whole = f.read()
    assert len(whole) == f.total and f.tell() == f.total and f.read(1) == b""
    f.seek(RandomBytes.BLOCK - 5)
    assert f.read(10) == whole[RandomBytes.BLOCK - 5 : RandomBytes.BLOCK + 5]
    assert f.seek(-3, 2) == f.total - 3 and f.read(9) == whole[-3:]
    assert f.block(2) == whole[-10:] and f.block_span(1) == (RandomBytes.BLOCK, 2 * RandomBytes.BLOCK)
    with pytest.raises(IndexError):
        f.block(3)


def test_probe(spark, tmp_path):
    from sparkloom.sources import probe

    path = tmp_path / "p.csv"
    path.write_text("".join(f"{i:05d},{i / 2},t{i}\n" for i in range(9000)))
    found = probe(spark, str(path), lines=500)
    assert found["types"] == ["bigint", "double", "string"] and found["bytes"] == path.stat().st_size
    assert abs(found["approx_rows"] - 9000) < 1500
    (tmp_path / "none.csv").write_text("")
    assert probe(spark, str(tmp_path / "none.csv")) == {"bytes": 0, "approx_rows": 0, "types": []}


def test_logger(tmp_path):
    import io

    from sparkloom.logs import setup_logger

    out = io.StringIO()
    setup_logger("debug", stream=out).debug("hello")
    assert "hello" in out.getvalue()
    setup_logger(filename=str(tmp_path / "log")).info("there")
    assert "there" in (tmp_path / "log").read_text() and "there" not in out.getvalue()


def test_objects(spark, tmp_path):
    from sparkloom.sources import object_name, object_size, read_object, write_object

    path = str(tmp_path / object_name("a", 1, "b"))
    assert path.endswith("a_1_b")
    write_object(spark, path, b"\x00\xffxyz")
    assert read_object(spark, path) == b"\x00\xffxyz" and object_size(spark, path) == 5


def test_write_beside_the_source(spark, terasort):
    result = sl.Job().add(0, sl.Scan(terasort)).add(0, sl.Filter("`1` < 10")).add(0, sl.Write()).run(spark)
    assert result.path == f"{terasort}-out" and spark.read.parquet(result.path).count() == 10


# --- exchanges and sinks ---


def test_sort_behind_a_groupby_is_global(spark):
    df = spark.range(1000).selectExpr("id % 37 AS k", "(id * 7919) % 1000 AS v")
    job = sl.Job().add(0, sl.Scan("x.parquet")).add(0, sl.Exchange(8))
    job.add(1, sl.Groupby("k")).add(1, sl.Reduce([F.sum("v").alias("s")])).add(1, sl.Sort("s")).dependency(0, 1)
    job.stages[0][0].read = lambda _: df
    assert is_sorted(job.plan(spark)[1], "s")
    two = sl.Job().add(0, sl.Scan("x.parquet")).add(0, sl.Exchange(8)).add(1, sl.Sort("k")).add(1, sl.Sort("v")).dependency(0, 1)
    two.stages[0][0].read = lambda _: df
    out = two.plan(spark)[1]
    assert is_sorted(out, "v") and out.count() == 1000


def test_the_last_sort_or_groupby_decides(spark):
    df = spark.range(1000).selectExpr("id % 37 AS k", "(id * 7919) % 1000 AS v")

    def plan(*ops):
        job = sl.Job().add(0, sl.Scan("x.parquet")).add(0, sl.Exchange(8))
        for op in ops:
            job.add(1, op)
        job.dependency(0, 1).stages[0][0].read = lambda _: df
        return job.plan(spark)[0]._jdf.queryExecution().toString()

    assert "hashpartitioning(k" in plan(sl.Sort("v"), sl.Groupby("k"))
    assert "rangepartitioning(v" in plan(sl.Groupby("k"), sl.Sort("v"))


def test_stable_buckets_are_the_partitions(spark):
    import hashlib

    df = spark.createDataFrame([(k,) for k in ["a", "b", "é", "", None] * 3], "k string")
    got = sl.Exchange(5, stable=True).deal(df, sl.Groupby("k")).select("k", F.spark_partition_id().alias("p")).collect()
    assert len(got) == 15
    for r in got:
        assert r.p == (0 if r.k is None else int(hashlib.md5(r.k.encode()).hexdigest(), 32) % 5)
    with pytest.raises(ValueError):
        sl.Exchange(stable=True)


def test_exchange_by_the_cost_model(spark):
    rates = Rates(1e8, 1e8, 1000, 1000)
    df = spark.range(100)
    out = sl.Exchange(rates=rates, size=10**10).deal(df, sl.Groupby("id"))
    assert out.rdd.getNumPartitions() == worker_count(10**10, rates) > 3
    assert sl.Exchange(rates=rates).deal(df, None).rdd.getNumPartitions() == 3 and "cost model" in sl.Exchange(rates=rates).explain()


def test_combine_before_the_exchange(spark):
    df = spark.range(0, 30_000, 1, 4).selectExpr("IF(id % 3 = 0, 1, id % 11) AS k", "id AS v")
    job = sl.Job().add(0, sl.Scan("x.parquet")).add(0, sl.Exchange(4))
    add = lambda f: f.groupby("k", as_index=False).v.sum()
    job.add(1, sl.Groupby("k")).add(1, sl.Reduce(add, "k long, v long", combine=add, combine_schema="k long, v long")).dependency(0, 1)
    job.stages[0][0].read = lambda _: df
    plans = job.plan(spark)
    assert plans[0].count() <= 11 * (30_000 // 1000 + 4)
    assert sorted(map(tuple, plans[1].collect())) == sorted(map(tuple, df.groupBy("k").sum("v").collect()))
    alone = sl.Reduce(lambda f: f.groupby("k", as_index=False).n.sum(), "k long, n long", combine=lambda f: f.groupby("k", as_index=False).size().rename(columns={"size": "n"}), combine_schema="k long, n long")
    assert sorted(map(tuple, alone.run(df.coalesce(1)).collect())) == sorted(map(tuple, df.groupBy("k").count().collect()))
    with pytest.raises(ValueError):
        sl.Reduce(add, "k long", combine=add)


def test_several_sinks(spark, terasort, tmp_path):
    job = sl.Job().add(0, sl.Scan(terasort)).add(0, sl.Exchange(3))
    job.add(1, sl.Filter("`1` < 10")).add(1, sl.Collect()).add(2, sl.Filter("`1` >= 10")).add(2, sl.Write(str(tmp_path / "rest"))).add(3, sl.Transform(["`0`"]))
    found = job.dependency(0, 1).dependency(0, 2).dependency(0, 3).run(spark)
    assert len(found.sinks[1].rows) == 10 and spark.read.parquet(found.sinks[2].path).count() == 4990
    assert sum(found.sinks[3].counts.values()) == 5000 == sum(found.counts.values())


def test_collected_rows_do_not_fill_the_driver(spark, tmp_path, monkeypatch):
    """All rows come to the driver, of which it holds a slice; one key has most of them."""
    rows = 400_000
    spark.range(rows).selectExpr("IF(id % 10 > 0, 7, id) AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr("sparkloom.operators.collect.SLICE_BYTES", 1 << 19)
    before = spark.conf.get("spark.sql.execution.arrow.pyspark.enabled")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    tracemalloc.start()
    try:
        n = q.QUERIES["collect_partition_rows"](spark, str(tmp_path))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", before)
    assert n.first().n == rows and peak < 8 << 20, peak


def test_collect_hands_slices_over_in_order(spark, monkeypatch):
    monkeypatch.setattr("sparkloom.operators.collect.SLICE_BYTES", 40_000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    sizes = []

    def keep(f):
        sizes.append(len(f))
        return f

    try:
        df = spark.range(0, 30_000, 1, 3).selectExpr("id", "IF(id % 7 = 0, NULL, concat('é', id)) AS s", "timestamp_ntz'2024-01-01 00:00:00' AS t", "array(id) AS a", "id AS id")  # a name twice
        sort = sl.Job().add(0, sl.Scan("x.parquet")).add(0, sl.Exchange(4))
        sort.add(1, sl.Sort("s")).add(1, sl.Collect(keep)).dependency(0, 1)
        sort.stages[0][0].read = lambda _: df.toDF("id", "s", "t", "a", "again")
        got = sort.run(spark)
        want = sorted((i for i in range(30_000) if i % 7), key=lambda i: f"é{i}".encode())
        assert list(got.rows.id[: len(want)]) == want and set(got.rows.id[len(want) :]) == set(range(0, 30_000, 7))
        assert (got.rows.again == got.rows.id).all() and got.rows.a.str[0].equals(got.rows.id)
        assert len(sizes) > 10 and sum(sizes) == 30_000 and max(sizes) <= 3_000
        sizes.clear()
        twice = sl.Collect(keep).collect(df.limit(5))
        assert twice.shape == (5, 5) and list(twice.columns) == ["id", "s", "t", "a", "id"]
        none = sl.Collect(keep).collect(df.filter("t IS NULL"))
        assert sizes == [5, 0] and list(none.columns) == ["id", "s", "t", "a", "id"]
        assert sl.Collect(keep).collect(spark.range(40).repartition(1).selectExpr("concat(repeat('x', 15000), id) AS `a.b`")).shape == (40, 1) and set(sizes[2:]) <= {1, 2}
        with pytest.raises(ZeroDivisionError):
            sl.Collect(lambda f: 1 / 0).collect(df)
        assert not list(Path(urlparse(spark.sparkContext.getCheckpointDir()).path).glob("collect-*"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_samples_by_columns_are_the_same_in_any_order(spark, sf):
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    take = sl.Sample("l_orderkey", 0.2, by=["l_orderkey", "l_linenumber", "l_partkey"])
    a, b = (sorted(r[0] for r in take.run(df).collect()) for df in (line, line.repartition(7)))
    assert a == b and 1000 < len(a) < 1400


def test_bounds_of_odd_keys(spark):
    one = spark.createDataFrame([(5,)] * 3 + [(None,)], "n int")
    assert segment_bounds(one, "n", 4) == [5.0, 5.0, 5.0]
    rng = pd.Series(range(101)).sample(frac=1, random_state=1)
    df = spark.createDataFrame([(float(x) ** 2,) for x in rng], "n double")
    assert segment_bounds(df, "n", 3) == pytest.approx(list(pd.Series([float(x) ** 2 for x in range(101)]).quantile([1 / 3, 2 / 3])))


def test_shared_folder_of_a_local_master_only(spark):
    from sparkloom.session import shared_path

    assert shared_path(spark, "a").startswith(spark.sparkContext.getCheckpointDir()) and shared_path(spark, "a") != shared_path(spark, "a")
