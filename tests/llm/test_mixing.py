import numpy as np
import pytest

from sparkloom.llm import mixing


def targets(sizes, weights, total, most=2.0):
    """Weighted shares of ``total``; what one has above ``most`` times its size is shared again."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while free:
        sum_w = sum(weights[i] for i in sorted(free))
        full = [i for i in sorted(free) if left * weights[i] / sum_w > most * sizes[i]]
        for i in full or free:
            out[i] = float(most * sizes[i]) if full else left * weights[i] / sum_w
        if not full:
            break
        left -= sum(out[i] for i in full)
        free -= set(full)
    return out


def test_targets_by_hand(spark):
    assert targets([10, 10, 10], [1, 1, 1], 45) == [15, 15, 15]
    assert targets([10, 100], [3, 1], 60) == [20.0, 40.0]
    for sizes, weights, share in (([10, 10, 10], [1, 1, 1], 1.5), ([10, 100], [3, 1], 0.5), ([1, 10, 100], [3, 1, 2], 1.5), ([0, 0], [3, 1], 1.5), ([5, 7, 1000, 3, 9], [3, 1, 2, 3, 1], 1.9), ([4], [1], 3.0), ([2, 2], [1, 5], 2.5)):
        df = spark.createDataFrame(list(zip(range(len(sizes)), sizes, weights)), "i long, size long, weight int").repartition(3)
        got = [r.target for r in sorted(mixing.with_targets(df, share).collect(), key=lambda r: r.i)]
        assert got == pytest.approx(targets(sizes, weights, share * sum(sizes)))


def docs_of(spark, sizes, seed=0):
    """sizes: source -> list of word counts."""
    rows, i = [], 0
    for source, ns in sizes.items():
        for n in ns:
            rows.append((i, " ".join(["w"] * n), source, 7))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def brute(rows, block):
    """rows: (doc_id, size, source) with the takes of a plain walk over the streams."""
    by: dict = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    names = sorted([s for s in by if s is not None]) + ([None] if None in by else [])
    sizes = [sum(r["size"] for r in by[s]) for s in names]
    goal = targets(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(names))], 1.5 * sum(sizes))
    out = {}
    for s, size, t in zip(names, sizes, goal, strict=True):
        stream = sorted((r for r in by[s] if r["size"]), key=lambda r: (r["h"], r["doc_id"]))
        left = min(int(np.floor(t + 0.5)), 2 * size)
        for r in by[s]:
            out[r["doc_id"]] = (size, t, 0)
        while left > 0:
            for r in stream:
                n = min(left, r["size"])
                out[r["doc_id"]] = (size, t, out[r["doc_id"]][2] + n)
                left -= n
    return out


@pytest.mark.parametrize("block", [1, 7, 64, 100_000])
def test_mix_equals_a_walk_over_the_streams(spark, block):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(block)
    sizes = {"b": rng.integers(1, 60, 200).tolist(), "a": [0, 3, 500], None: [5, 5], "z": [1], "ä": [0, 0], "c": [40] * 30}
    df = docs_of(spark, sizes)
    got = mixing.mix(df, block_tokens=block).collect()
    rows = [r.asDict() for r in mixing.sized(df).withColumn("h", F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 12)).collect()]
    want = brute(rows, block)
    assert len(got) == len(rows)
    for r in got:
        assert (r.source_size, r.target, r.taken) == pytest.approx(want[r.doc_id]), r
        assert r.taken <= 2 * r["size"]
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7), block_tokens=block).collect()))


def walk(plan, block):
    """Slots of a plain walk over golden-ratio points; plan: (size, take, blocks, need) of each source."""
    total = sum(p[3] for p in plan)
    sums = np.cumsum([p[3] for p in plan]) / total
    out, seen = [], [0] * len(plan)

    def put(slot, k):
        r, (size, take, blocks, need) = seen[k], plan[k]
        seen[k] += 1
        if r < need:
            at = r % blocks * block
            out.append((slot, k, r, r // blocks, r % blocks, min(block, size - at, take - r // blocks * size - at)))

    for i in range(total):
        u = i * mixing.GOLDEN + 0.5
        put(i, int(np.searchsorted(sums, u - np.floor(u), "right")))
    for k, p in enumerate(plan):
        while seen[k] < p[3]:
            put(total + seen[k], k)
    return sorted(out)


@pytest.mark.parametrize("plan,block", [([(1000, 1500, 10, 15), (1000, 500, 10, 5), (1000, 1000, 10, 10)], 100), ([(7, 14, 1, 2), (30_000, 41_000, 3000, 4100), (95, 50, 10, 5), (12_345, 24_690, 1235, 2470)], 10)])
def test_schedule_equals_a_walk_over_the_points(spark, plan, block):
    rows = [(k, *p, float(p[1])) for k, p in enumerate(plan)]
    df = spark.createDataFrame(rows, "src long, size long, take long, blocks long, need long, target double")
    slots = sorted(tuple(r) for r in mixing.schedule(spark, df, block).select("slot", "src", "rank", "pass", "block", "take").collect())
    assert slots == walk(plan, block)
    assert [sum(s[5] for s in slots if s[1] == k) for k in range(len(plan))] == [p[1] for p in plan]
    for n in (6, 12, 18, 24):  # each prefix is near the shares
        for k, p in enumerate(plan):
            assert abs(sum(s[1] == k for s in slots[:n]) - n * p[3] / sum(q[3] for q in plan)) <= 2


def test_slices_are_the_mix_in_slot_order(spark):
    df = docs_of(spark, {"a": [3, 5, 2, 30], "b": [8, 1], "c": [0]})
    rows = mixing.slices(df, block_tokens=4).orderBy("slot", "at").collect()
    mixed = {r.doc_id: r for r in mixing.mix(df, block_tokens=4).collect()}
    for i, m in mixed.items():
        mine = [r for r in rows if r.doc_id == i]
        assert sum(r.words for r in mine) == m.taken and (min((r.slot for r in mine), default=None)) == m.first_slot
        assert all(0 <= r.begin and r.begin + r.words <= m["size"] for r in mine)
    sources = [r.source for r in rows]
    assert sources != sorted(sources)  # interleaved
    by_slot: dict = {}
    for r in rows:
        by_slot[r.slot] = by_slot.get(r.slot, 0) + r.words
    assert max(by_slot.values()) <= 4


def test_many_sources(spark):
    from pyspark.sql import functions as F

    n = 50_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.format_string("s%06d", "id").alias("source"))
    got = mixing.mix(df).groupBy().agg(F.sum("taken").alias("t"), F.max("taken").alias("m"), F.count("*").alias("n"), F.sum("target").alias("g")).first()
    assert got.n == n and got.m <= 6 and got.g == pytest.approx(4.5 * n) and abs(got.t - 4.5 * n) <= n / 2


def test_points_of_large_slots(spark):
    from fractions import Fraction

    from pyspark.sql import functions as F

    ids = [0, 1, 5, 1 << 20, (1 << 20) + 7, 5 * 10**9 + 3]
    got = {r.i: r.u for r in spark.createDataFrame([(i,) for i in ids], "i long").select("i", mixing.point(F.col("i")).alias("u")).collect()}
    for i in ids:
        want = (Fraction(i) * Fraction(mixing.GOLDEN) + Fraction(1, 2)) % 1
        assert abs(got[i] - float(want)) < 1e-6


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0
    nothing = spark.createDataFrame([(1, None, None), (2, "", "a"), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r["size"], r.target, r.taken) for r in mixing.mix(nothing).collect()] == [(0, 0.0, 0)] * 3
    twins = spark.createDataFrame([(1, "a b", "s")] * 3 + [(None, "c d e", "s")], "doc_id long, text string, source string")
    assert sum(r.taken for r in mixing.mix(twins).collect()) == 14  # 13.5 rounded


def test_stage_repeats_whole_documents(spark):
    sizes = {"a": [100] * 20, "b": [100] * 20}
    df = docs_of(spark, sizes)
    out = mixing.stage(spark, df, "")
    assert out.columns == df.columns
    n = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert max(n.values()) <= 2 and sum(n.get(i, 0) for i in range(20)) == 40
    assert abs(sum(n.values()) - 60) <= 1


def test_query_equals_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(mixing.ORACLE).df().set_index("doc_id").sort_index()
    got = mixing.query(spark, sf).toPandas().set_index("doc_id").sort_index()
    assert sorted(got.columns) == sorted(want.columns)
    for c in want.columns:
        a, b = got[c], want[c]
        assert ((a == b) | (a.isna() & b.isna())).all(), c
