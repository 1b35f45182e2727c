"""Helpers shared by the training-data operators.

Text is handled as UTF-8 bytes in NumPy arrays taken straight from Arrow
buffers, so a batch is tokenised and hashed without a Python loop over words.
"""

from __future__ import annotations

import ctypes
import math
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import remove_shared, shared_dir, shared_path, ship_package  # noqa: F401

U64 = np.uint64
#: Bytes that end a word: space and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of text handled at once inside an Arrow batch.
RUN_BYTES = 1 << 20


#: Rows of an Arrow batch, so that batches of long texts stay small in the JVM and in Python.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Sends the package to the executors, and bounds Arrow batches where the
    session has Spark's default of 10,000 rows."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    tidy_driver(df.sparkSession)
    return out


def write_shared(spark: SparkSession, name: str, data: bytes) -> str:
    """Write ``data`` through Hadoop's file system into the shared folder; its URI."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path.toString()


# --- text as bytes -----------------------------------------------------------


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def runs(offsets: np.ndarray, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


_tidied = 0


def tidy() -> None:
    """Gives memory that a worker has freed back to the system, now and then, so
    that workers which wait for their next task don't keep it from the others."""
    global _tidied
    _tidied += 1
    if _tidied % 8 == 0:
        _trim()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Seconds from one tidying of the driver to the next; one takes about 0.05 s.
TIDY_DRIVER_S = 5.0
_driver_tidied = -math.inf


def tidy_driver(spark: SparkSession) -> None:
    """Gives memory that the driver's JVM and Python have freed back to the system.

    The JVM compiles the code of every plan, in native memory that it frees and its C
    library keeps. Plans with many steps thus hold hundreds of MB outside of the heap,
    which no garbage collection returns."""
    global _driver_tidied
    if time.monotonic() - _driver_tidied < TIDY_DRIVER_S:
        return
    _trim()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway

    def array(kind, values: list):
        out = gateway.new_array(kind, len(values))
        for k, v in enumerate(values):
            out[k] = v
        return out

    try:
        of = jvm.java.lang.Class.forName
        kinds = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
        invoke = of("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, [of(k) for k in kinds]))
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        call = [commands, "systemTrimNativeHeap", array(jvm.java.lang.Object, []), array(jvm.java.lang.String, [])]
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(jvm.java.lang.Object, call))
    except Py4JError:  # a JVM without this command
        pass
    _driver_tidied = time.monotonic()


def text_runs(column: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of each range."""
    data, offsets = text_buffers(column)
    for i, j in runs(offsets, limit):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
    tidy()


# --- hashing -----------------------------------------------------------------

_MUL = U64(0x9E3779B97F4A7C15)
_POLY = 0xD6E8FEB86659FD93
_POLY_INV = pow(_POLY, -1, 1 << 64)
_powers: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_CODES = mix64(np.arange(1, 257, dtype=U64) * _MUL)


def _power_tables(n: int) -> list[np.ndarray]:
    global _powers
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, RUN_BYTES + 1)
        tables = []
        for base in (_POLY, _POLY_INV):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=U64))
        if size > 16 * RUN_BYTES:
            return tables
        _powers = tables
    return _powers


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of each text."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] |= word[begins]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] |= word[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of byte ranges, from one running sum over the bytes."""
    power, inverse = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_BYTE_CODES[data] * power[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix64(h + (ends - starts).astype(U64) * _MUL)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each text its sorted distinct ``size``-word shingles, as 64-bit hashes,
    and the word counts. A-Z count as a-z. Fewer words: the whole sequence is
    the one shingle; no word: an empty set."""
    data = _LOWER[data]
    starts, ends = word_bounds(data, offsets)
    h = word_hashes(data, starts, ends)
    at = np.searchsorted(starts, offsets)
    n_words = np.diff(at)
    full = np.zeros(0, U64)
    if len(h) >= size:
        m = len(h) - size + 1
        full = h[:m].copy()
        for k in range(1, size):
            full = mix64(full * _MUL + h[k : k + m])
    sets = []
    for i, n in enumerate(n_words.tolist()):
        a = at[i]
        if n >= size:
            sets.append(np.unique(full[a : a + n - size + 1]))
        elif n:
            s = h[a : a + 1].copy()
            for k in range(1, n):
                s = mix64(s * _MUL + h[a + k : a + k + 1])
            sets.append(mix64(s + U64(n)))
        else:
            sets.append(np.zeros(0, U64))
    return sets, n_words


# --- distributed building blocks ----------------------------------------------


def running_start(df: DataFrame, group: str, order: list, value: str, out: str, bucket: str) -> DataFrame:
    """Exclusive running sum of ``value`` in each group, without one task per group.

    ``bucket`` is a column that ascends with ``order`` and splits a large group;
    sums of buckets are accumulated in a table of one row per (group, bucket),
    and rows only inside their bucket.
    """
    sums = df.groupBy(group, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col(group).alias("_g"), F.col(bucket).alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).cast("long").alias("_base"))
    inner = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)).cast("long"))
    joined = rows.join(base, F.col(group).eqNullSafe(F.col("_g")) & (F.col(bucket) == F.col("_b")), "left")
    return joined.withColumn(out, F.col("_base") + F.col("_in")).drop("_g", "_b", "_base", "_in")


def numbered(df: DataFrame, order: list, out: str) -> DataFrame:
    """Adds each row's place, from 0, in the given order. Rows are sorted in the
    partitions of a range exchange; only their counts, a row for each, meet in one task."""
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("_p")).count()
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return rows.join(F.broadcast(starts), part == F.col("_p")).withColumn(out, place).drop("_at", "_p", "_start")


def _all_stars(e: DataFrame) -> tuple[bool, int]:
    """Whether each node hangs from one root that hangs from none; a root is then the
    smallest, as v < u in all edges. With the number of edges."""
    n, distinct = e.agg(F.count("*"), F.countDistinct("u")).first()
    return n == distinct and (n == 0 or e.select("u").join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()), n


def _with_least(e: DataFrame, each: int) -> DataFrame:
    """``e`` with m, the least v of all edges of the same u.

    Minima are pre-aggregated before their shuffle. A node with more than ``each``
    edges is joined in as many parts, so that no node's edges are one task; such nodes
    are few (edges / ``each``, about the root of the edges for large inputs), which
    bounds the broadcast of their list."""
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / each).cast("int")
    large = least.filter(F.col("n") > each).select("u", parts.alias("parts"))
    salt = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("v"), F.col("parts").cast("long")).cast("int"))
    salted = e.join(F.broadcast(large), "u", "left").withColumn("salt", salt).drop("parts")
    return salted.join(least.select("u", "m", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt")), ["u", "salt"]).drop("salt")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of each node of ``edges`` (a, b): rows (node, root).

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the
    edges are stars, each round's edges checkpointed. No step gathers the edges of
    one node in one task (see ``_with_least``).
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    for _ in range(max_rounds):
        done, n = _all_stars(e)
        if done:
            break
        each = rows_each(2 * n)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, each).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # Each node hands its least neighbour to the others and to itself.
        e = cut(_with_least(large, each).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def rows_each(rows: int, least: int = 256) -> int:
    """Rows of a bucket of a running sum: as many as there are buckets, for large inputs."""
    return max(least, math.isqrt(max(rows, 0)))


def buckets_for(rows: int) -> int:
    return max(1, math.ceil(rows / rows_each(rows)))
