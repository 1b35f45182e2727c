"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents form a stream in the order of a hash of their ids, cut into
blocks of ``BLOCK_TOKENS`` words. A source whose target exceeds its size repeats its
stream. Slot i of the schedule takes the golden-ratio point ``frac(0.5 + i / phi)``,
maps it through the cumulative shares to a source, and slots are ranked per source:
rank r takes block r of the source's stream. As a golden-ratio sequence may hand a
source a few slots more or fewer than its share, ranks past a source's need are
skipped and missing ones appended. The last block of a source is cut to its rounded
target, so targets are met to a word.

``slices`` is the mix itself: which words of which document each slot holds; sorted
by (slot, at) it is the mix in the order of the schedule. ``mix`` sums it up per
document, with the first slot that holds words of it.

Nothing here depends on how many sources there are: they are a table throughout,
ranked over range partitions, matched with the slots by a merge in order, and
broadcast only while they are few. Running sums are taken in buckets of about the
root of the rows, so a source with a third of all rows isn't one task.

Defined cases: null text has size 0; null sources are one source, ordered last;
documents of size 0 and empty tables yield targets of 0 and no slots; repeated ids
are separate rows; null ids are ordered as an empty text; other columns aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buckets_for, cut, numbered, rows_each, running_start, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
BLOCK_TOKENS = 2048
#: Sources that are broadcast to documents and slots; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
GOLDEN = (math.sqrt(5) - 1) / 2
#: Slot numbers are taken apart by this number, so that large ones lose no digits.
STEP = 1 << 20


def sized(docs: DataFrame) -> DataFrame:
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), words.cast("long").alias("size"))


def _few(sources: DataFrame, n: int) -> DataFrame:
    return F.broadcast(sources) if n <= BROADCAST_SOURCES else sources


def with_targets(sources: DataFrame, share: float = SHARE, most: float = 2.0) -> DataFrame:
    """Adds ``target`` to rows with size and weight: weighted shares of ``share`` times
    all sizes; what a share has above ``most`` times its source's size is shared again
    by weight among the rest. Each round is one sum over the sources; the level only
    rises, so a source that is full stays so."""
    cap, weight = F.col("size") * F.lit(float(most)), F.col("weight")
    total, weights, n = sources.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0)), F.count("*")).first()
    total, left, rest, full = share * total, share * total, float(weights), 0
    while rest:
        over = F.lit(left) * weight / F.lit(rest) > cap
        capped, free, now = sources.agg(F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, weight)), F.lit(0)), F.count_if(over)).first()
        if now == full:
            break
        left, rest, full = total - capped, float(free), now
    if not rest:
        return sources.withColumn("target", cap)
    goal = F.lit(left) * weight / F.lit(rest)
    return sources.withColumn("target", F.when(goal > cap, cap).otherwise(goal))


def plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = 2.0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per source: src (its rank), source, n, size, target, take (the target in
    words), blocks (of one pass), need (blocks of all passes)."""
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    found = numbered(found, [F.col("source").asc_nulls_last()], "src")
    given = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    goal = with_targets(cut(found.withColumn("weight", given)), share, most)
    block = F.lit(block_tokens)
    goal = goal.withColumn("take", F.least(F.floor(F.col("target") + 0.5), F.floor(F.col("size") * F.lit(float(most)))))
    goal = goal.withColumn("blocks", F.ceil(F.col("size") / block))
    passes = F.floor(F.col("take") / F.greatest("size", F.lit(1)))
    need = F.when(F.col("size") > 0, passes * F.col("blocks") + F.ceil((F.col("take") - passes * F.col("size")) / block)).otherwise(F.lit(0))
    return cut(goal.select("src", "source", "n", "size", "target", "take", "blocks", need.cast("long").alias("need")))


def point(slot: Column) -> Column:
    """frac(0.5 + slot / phi), with the digits of large slot numbers kept."""
    step = (STEP * GOLDEN) % 1.0
    u = F.pmod(slot, F.lit(STEP)) * F.lit(GOLDEN) + F.floor(slot / F.lit(STEP)) * F.lit(step) + F.lit(0.5)
    return u - F.floor(u)


def _sourced(spark: SparkSession, edges: DataFrame, total: int) -> DataFrame:
    """slot, src of ``total`` slots: the last of the ``edges`` (low, src) at or below each
    slot's point. Points and edges meet in buckets of the unit interval, over which the
    points are even, and a bucket begins with the last edge before it."""
    n = buckets_for(total)
    bucket = lambda u: F.least(F.floor(u * n), F.lit(n - 1)).cast("int")
    edges = edges.withColumn("b", bucket(F.col("low")))
    last = edges.groupBy("b").agg(F.max_by("src", F.struct("low", "src")).alias("last"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = spark.range(n).select(F.col("id").cast("int").alias("b")).join(last, "b", "left").select("b", F.last("last", ignorenulls=True).over(before).alias("first"))
    slots = spark.range(total).select(point(F.col("id")).alias("low"), F.col("id").alias("slot"), F.lit(None).cast("long").alias("src"))
    both = slots.withColumn("b", bucket(F.col("low"))).unionByName(edges.select("low", F.lit(None).cast("long").alias("slot"), "src", "b"))
    here = Window.partitionBy("b").orderBy("low", F.col("slot").asc_nulls_first(), "src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("src", F.last("src", ignorenulls=True).over(here)).filter(F.col("slot").isNotNull())
    # At most a row for each bucket, the root of the slots.
    return met.join(F.broadcast(carried), "b").select("slot", F.coalesce("src", "first").alias("src"))


def schedule(spark: SparkSession, sources: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Slots of the mix: slot, src, rank, pass, block, take, from rows of ``plan``."""
    n, total = sources.agg(F.count("*"), F.coalesce(F.sum("need"), F.lit(0))).first()
    needy = sources.filter("need > 0").withColumn("all", F.lit(0)).withColumn("part", F.floor(F.col("src") / rows_each(n)).cast("int"))
    edges = running_start(needy, "all", ["src"], "need", "low", "part").select((F.col("low") / F.lit(float(max(total, 1)))).alias("low"), "src")
    slots = _sourced(spark, edges, total).withColumn("one", F.lit(1).cast("long")).withColumn("part", F.floor(F.col("slot") / rows_each(total)).cast("int"))
    slots = cut(running_start(slots, "src", ["slot"], "one", "rank", "part").select("slot", "src", "rank"))
    have = slots.groupBy("src").agg(F.count("*").alias("have"))
    short = sources.select("src", "need").join(have, "src", "left").na.fill(0, ["have"]).filter("have < need")
    tail = short.select("src", F.explode(F.sequence(F.col("have"), F.col("need") - 1)).alias("rank"))
    slots = slots.unionByName(tail.select((F.lit(total) + F.col("rank")).alias("slot"), "src", "rank"))
    slots = slots.join(_few(sources.select("src", "need", "blocks", "size", F.col("take").alias("words")), n), "src").filter("rank < need")
    block = F.lit(block_tokens).cast("long")
    slots = slots.withColumn("pass", F.floor(F.col("rank") / F.col("blocks"))).withColumn("block", F.pmod("rank", "blocks"))
    length = F.least(block, F.col("size") - F.col("block") * block)
    begun = F.col("pass") * F.col("size") + F.col("block") * block
    return slots.select("slot", "src", "rank", "pass", "block", F.least(length, F.col("words") - begun).alias("take"))


def _streamed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with their source's columns and start, their place in its stream."""
    n, largest = sources.agg(F.count("*"), F.max("n")).first()
    kinds = sources.select(F.col("source").alias("_s"), "src", F.col("size").alias("source_size"), "target")
    placed = rows.join(_few(kinds, n), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    parts = buckets_for(largest or 0)
    placed = placed.withColumn("h", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 12))
    part = F.floor(F.conv("h", 16, 10).cast("long") / F.lit(float(1 << 48)) * parts).cast("int")
    return running_start(placed.withColumn("part", part), "src", ["h", "doc_id", "size"], "size", "start", "part").drop("h", "part")


def _slices(placed: DataFrame, sources: DataFrame, block_tokens: int) -> DataFrame:
    spark = placed.sparkSession
    block = F.lit(block_tokens)
    blocks = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    # A block may come twice or more, once for each pass over its source.
    takes = schedule(spark, sources, block_tokens).select("slot", "src", "block", "take")
    hit = blocks.join(takes, ["src", "block"])
    first = F.greatest(F.col("start"), F.col("block") * block)
    last = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("take"))
    return hit.withColumn("at", first).withColumn("words", last - first).filter("words > 0")


def slices(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = 2.0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The mix: slot, at (place in the source's stream), doc_id, source, begin and words:
    a slot holds ``words`` words of a document from its word ``begin`` on."""
    rows = cut(sized(docs))
    sources = plan(rows, weights, share, most, block_tokens)
    hit = _slices(_streamed(rows, sources), sources, block_tokens)
    return hit.select("slot", "at", "doc_id", "source", (F.col("at") - F.col("start")).alias("begin"), "words")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = 2.0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken, first_slot
    (null where nothing is taken)."""
    rows = cut(sized(docs))
    sources = plan(rows, weights, share, most, block_tokens)
    placed = _streamed(rows, sources)
    keys = ["src", "start"]  # tell apart all documents with words
    got = _slices(placed, sources, block_tokens).groupBy(*keys).agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    full = placed.filter("size > 0").join(got, keys, "left").unionByName(placed.filter("size = 0").withColumns({"taken": F.lit(0).cast("long"), "first_slot": F.lit(None).cast("long")}))
    return full.select("doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: each document as often as the mix takes it, in whole copies
    (words taken over size, rounded): 0, 1 or 2 times. Rows of one id share its words."""
    got = mix(docs).groupBy(F.col("doc_id").alias("__mix_id")).agg(F.floor(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1)) + 0.5).cast("int").alias("__mix_n"))
    both = docs.join(got, docs["doc_id"].eqNullSafe(F.col("__mix_id"))).filter("__mix_n > 0")
    return both.withColumn("__mix_k", F.explode(F.expr("sequence(1, __mix_n)"))).select(*docs.columns)


ORACLE = f"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM s),
w AS (SELECT *, [3, 1, 2][src % 3 + 1]::DOUBLE AS w FROM r),
o AS (SELECT *, 1.5::DOUBLE * (sum(size) OVER ())::DOUBLE - 2 * coalesce(sum(size) OVER (ORDER BY size / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS rest,
        sum(w) OVER (ORDER BY size / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w FROM w),
f AS (SELECT rest AS l, rest_w AS lw FROM o WHERE rest * w / rest_w <= 2 * size ORDER BY size / w, src LIMIT 1),
t AS (SELECT src, source, size, CASE WHEN l * w / lw > 2 * size THEN 2.0::DOUBLE * size ELSE l * w / lw END AS target FROM w, f),
q AS (SELECT *, least(floor(target + 0.5), 2 * size)::BIGINT AS take, (size + {BLOCK_TOKENS - 1}) // {BLOCK_TOKENS} AS blocks FROM t),
k AS (SELECT *, CASE WHEN size > 0 THEN (take // size) * blocks + (take % size + {BLOCK_TOKENS - 1}) // {BLOCK_TOKENS} ELSE 0 END AS need FROM q),
n AS (SELECT sum(need)::BIGINT AS total FROM k),
e AS (SELECT src, (sum(need) OVER (ORDER BY src) - need)::DOUBLE / total::DOUBLE AS low FROM k, n WHERE need > 0),
g AS (SELECT i AS slot, i * {GOLDEN!r}::DOUBLE + 0.5::DOUBLE AS x FROM n, range(total) z(i)),
a AS (SELECT slot, src FROM (SELECT slot, x - floor(x) AS u FROM g) g ASOF JOIN e ON g.u >= e.low),
b AS (SELECT slot, src, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS rank FROM a),
c AS (SELECT src, count(*) AS have FROM b GROUP BY src),
y AS (SELECT slot, src, rank FROM b UNION ALL SELECT total + i, k.src, i FROM n, k LEFT JOIN c ON c.src = k.src, range(coalesce(have, 0), need) z(i)),
v AS (SELECT slot, y.src, rank % blocks AS block, least({BLOCK_TOKENS}, size - (rank % blocks) * {BLOCK_TOKENS}, take - (rank // blocks) * size - (rank % blocks) * {BLOCK_TOKENS}) AS words FROM y JOIN k ON k.src = y.src WHERE rank < need),
p AS (SELECT doc_id, d.size, k.src, k.size AS source_size, target, coalesce(sum(d.size) OVER (PARTITION BY k.src ORDER BY substr(md5(doc_id::VARCHAR), 1, 12), doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source),
m AS (SELECT p.src, start, doc_id, slot, least(start + size, block * {BLOCK_TOKENS} + words) - greatest(start, block * {BLOCK_TOKENS}) AS got
      FROM p JOIN v ON v.src = p.src AND size > 0 AND block BETWEEN start // {BLOCK_TOKENS} AND (start + size - 1) // {BLOCK_TOKENS})
SELECT p.doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target, coalesce(sum(got), 0)::BIGINT AS taken, min(slot)::BIGINT AS first_slot
FROM p LEFT JOIN m ON m.src = p.src AND m.start = p.start AND m.doc_id = p.doc_id AND got > 0 GROUP BY p.doc_id
"""
