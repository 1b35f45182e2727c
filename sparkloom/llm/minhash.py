"""MinHash near-dedup by circulant permutations, banding and exact verification.

C-MinHash (Li & Li, 2021): one bijection sigma scatters the shingles over a
circle of 2^32 positions, a second bijection pi ranks positions, and coordinate
k of the signature is ``min pi(sigma(x) + k mod 2^32)``: two permutations, one
of them circularly shifted, make all coordinates.

Steps, each linear in rows apart from the links themselves:

1. One pass over the texts makes, per document, a digest of its shingle set,
   the set's size, band keys and a byte of each coordinate. No text is shuffled.
2. Documents with equal sets collapse to the smallest id, so a group of copies
   costs one row from here on, whatever its size.
3. Buckets of two or more propose, for each member, the bucket's smallest
   member. Proposals whose signatures agree far too little for the threshold go
   (see ``LOOSE``); each document verifies the smallest of the rest on full sets.
4. Components of those links. Only buckets that still hold several components
   need more: their members' signatures are compared in blocks of ``BLOCK``, and
   a block returns a root per member, not pairs. Members joined this way form
   families; inside a family, full sets are compared block against block, pairs
   that are in one component by then are skipped, and only links leave a task.
   Blocks of one component never meet, so a large group of near copies costs its
   size times the rows near it that it hasn't been joined with, not its square.
5. Components of all links; copies take the component of their set.

Defined cases: null, empty or blank texts have an empty set (0 shingles) and
link with nothing; fewer words than the shingle size make one shingle of the
whole sequence; a null id is kept with null component; extra columns are not
read. Equal ids are one document whose sets all count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, cut, mix64, shingle_sets, table, text_runs

U32, U64 = np.uint32, np.uint64
BANDS, ROWS = 32, 5
#: Signatures that agree less than this many standard deviations below the threshold can't belong to a link.
LOOSE = 6.0
BLOCK = 1000
#: Documents and shingles of a block of a family whose full sets are compared.
FAMILY_BLOCK, FAMILY_SHINGLES = 400, 400_000
#: Ids that are broadcast to pick texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Shingles whose permuted positions are ranked at once, so that the array stays in the CPU's cache.
CHUNK = 1 << 16


def _rank(v: np.ndarray) -> np.ndarray:
    """pi, in place: a bijection of 32-bit positions."""
    v ^= v >> U32(16)
    v *= U32(0x85EBCA6B)
    v ^= v >> U32(13)
    v *= U32(0xC2B2AE35)
    v ^= v >> U32(16)
    return v


def signatures(sets: list[np.ndarray], n_hashes: int) -> np.ndarray:
    """n_hashes x documents minima; documents with empty sets get the largest value."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    out = np.full((n_hashes, len(sets)), 0xFFFFFFFF, dtype=U32)
    rows = np.flatnonzero(sizes)
    i = 0
    while i < len(rows):  # groups of documents of about CHUNK shingles
        j, total = i, 0
        while j < len(rows) and (j == i or total + sizes[rows[j]] <= CHUNK):
            total += sizes[rows[j]]
            j += 1
        group = rows[i:j]
        position = (mix64(np.concatenate([sets[r] for r in group])) >> U64(32)).astype(U32)
        starts = np.concatenate([[0], np.cumsum(sizes[group])[:-1]])
        v, t = np.empty_like(position), np.empty_like(position)
        for k in range(n_hashes):
            np.add(position, U32(k), out=v)
            for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):
                np.right_shift(v, U32(shift), out=t)
                np.bitwise_xor(v, t, out=v)
                if factor:
                    np.multiply(v, U32(factor), out=v)
            out[k, group] = np.minimum.reduceat(v, starts)
        i = j
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """documents x bands 64-bit keys; the band's number is part of a key."""
    keys = np.empty((sig.shape[1], bands), dtype=U64)
    for b in range(bands):
        h = np.full(sig.shape[1], b + 1, dtype=U64)
        for r in range(rows):
            h = mix64(h * U64(0x9E3779B97F4A7C15) + sig[b * rows + r].astype(U64))
        keys[:, b] = h
    return keys


def _digest(s: np.ndarray) -> bytes:
    """128 bits that tell shingle sets apart."""
    import hashlib

    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sign(docs: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, digest, n_shingles, keys (band keys), sig (low byte of each coordinate)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, offsets in text_runs(batch.column(1)):
                sets, _ = shingle_sets(data, offsets, size)
                sig = signatures(sets, bands * rows)
                keys = band_keys(sig, bands, rows)
                flat = pa.array(keys.astype(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * bands, bands, dtype=np.int32)), flat)
                low = (sig & U32(0xFF)).astype(np.uint8).T
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), lists, pa.array([r.tobytes() for r in low], pa.binary())],
                    names=["doc_id", "digest", "n_shingles", "keys", "sig"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, digest binary, n_shingles long, keys array<long>, sig binary")


def _sets_of(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, shingles array<long> of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_runs(batch.column(1)):
                sets, _ = shingle_sets(data, offsets, size)
                at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")


def least_agreement(n_hashes: int, percent: int) -> int:
    """Equal coordinates below which a link at ``percent`` is as good as impossible."""
    p = percent / 100
    return max(0, math.floor(n_hashes * p - LOOSE * math.sqrt(n_hashes * p * (1 - p))))


def _near(pairs: DataFrame, sigs: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) whose signatures agree in ``least`` coordinates or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    one = sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa"))
    two = sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of ``ids``; without a shuffle of the texts while the ids are few."""
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union of their full sets."""
    a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("xa"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("xb"))
    both = F.size(F.array_intersect("xa", "xb"))
    return pairs.join(a, "a").join(b, "b").filter(100 * both >= percent * (F.size("xa") + F.size("xb") - both)).select("a", "b").distinct()


def _one_each(signed: DataFrame) -> DataFrame:
    """``signed`` with one row of those that share id and set, so that rows that are
    repeated very often don't multiply in the joins on the id."""
    twice = cut(signed.groupBy("doc_id", "digest").count().filter("count > 1").select("doc_id", "digest"))
    if twice.isEmpty():
        return signed
    few = F.broadcast(twice) if twice.count() <= BROADCAST_IDS else twice
    keys = ["doc_id", "digest"]
    return signed.join(few, keys, "left_anti").unionByName(signed.join(few, keys, "left_semi").dropDuplicates(keys).select(*signed.columns))


def near_duplicates(docs: DataFrame, shingle_size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    signed = cut(sign(docs, shingle_size, bands, rows))
    least = least_agreement(bands * rows, percent)
    some = _one_each(signed.filter("n_shingles > 0 and doc_id is not null"))
    # One row per shingle set: min() is pre-aggregated, so copies never meet in one task.
    classes = some.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    sole = some.select("doc_id", "keys").join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    rows_ = sole.select("doc_id", F.explode("keys").alias("key"))
    full = rows_.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").drop("high")
    shared = cut(rows_.join(full, "key").select("key", "doc_id", "low"))
    sigs = some.select("doc_id", "sig")
    ids = cut(shared.select("doc_id").distinct())
    sets = cut(_sets_of(_picked(docs, ids), shingle_size))

    first = shared.filter("doc_id <> low").select(F.col("low").alias("a"), F.col("doc_id").alias("b")).distinct()
    first = _near(first, sigs, least).groupBy("b").agg(F.min("a").alias("a"))
    links = cut(_verified(first, sets, percent))
    roots = connected_components(links)

    placed = shared.select("key", "doc_id").join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select("key")
    near = _near_roots(placed.join(mixed, "key").join(sigs, "doc_id"), least)
    families = connected_components(near)
    links = links.unionByName(_family_links(families, roots, sets, sigs, least, percent))
    roots = connected_components(links)

    of_rep = classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select(F.col("digest").alias("_d"), F.coalesce("root", "rep").alias("_c"))
    out = signed.select("doc_id", "digest", "n_shingles").join(of_rep, F.col("digest") == F.col("_d"), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("_c")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _spread(rows: DataFrame, group: str, cols: list[str], most: int, weight: Column | None = None, heaviest: int = 1) -> DataFrame:
    """Rows of each group dealt to pairs of blocks (i, j) of at most about ``most`` rows
    (and ``heaviest`` of ``weight``), so that rows of different roots meet in a task.

    A root with more than a block of rows has blocks of its own, which never meet each
    other; the rest share blocks. A large component thus meets the few rows outside
    of it at a cost in proportion to its size, and a group of one root isn't dealt at all."""
    heavy = F.sum(weight if weight is not None else F.lit(0)).alias("w")
    blocks = lambda n, w: F.greatest(F.ceil(n / F.lit(most)), F.ceil(w / F.lit(heaviest))).cast("int")
    of_root = rows.groupBy(group, "root").agg(F.count("*").alias("n"), heavy).withColumn("nb", blocks(F.col("n"), F.col("w")))
    own = F.col("nb") > 1
    parts = of_root.groupBy(group).agg(
        F.count("*").alias("roots"),
        blocks(F.coalesce(F.sum(F.when(~own, F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(~own, F.col("w"))), F.lit(0))).alias("shared"),
        F.collect_list(F.when(own, F.struct("root", "nb"))).alias("large"),
    )
    parts = parts.filter("roots > 1").withColumnRenamed(group, "_g")
    rows = rows.join(parts, F.col(group) == F.col("_g")).drop("_g")
    mine = F.filter("large", lambda x: x["root"] == F.col("root"))
    salt = lambda n: F.pmod(F.xxhash64("doc_id"), n.cast("long")).cast("int")
    block = lambda large, root, k: F.struct(large.alias("large"), root.alias("root"), k.alias("k"))
    none = F.lit(0).cast("long")
    rows = rows.withColumn("mine", mine)
    rows = rows.withColumn("own", F.when(F.size("mine") > 0, block(F.lit(True), F.col("root"), salt(F.col("mine")[0]["nb"]))).otherwise(block(F.lit(False), none, salt(F.col("shared")))))
    shared = F.when(F.col("shared") > 0, F.transform(F.sequence(F.lit(0), F.col("shared") - 1), lambda k: block(F.lit(False), none, k))).otherwise(F.array().cast("array<struct<large:boolean,root:bigint,k:int>>"))
    others = F.filter("large", lambda x: x["root"] != F.col("root"))
    large = F.flatten(F.transform(others, lambda x: F.transform(F.sequence(F.lit(0), x["nb"] - 1), lambda k: block(F.lit(True), x["root"], k))))
    rows = rows.withColumn("other", F.explode(F.concat(shared, large)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    return rows.select(group, i.alias("i"), j.alias("j"), (F.col("own") == i).alias("left"), (i == j).alias("alone"), "doc_id", *cols)


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    alone, left = group.column("alone")[0].as_py(), group.column("left").to_numpy()
    return np.flatnonzero(left), np.flatnonzero(left if alone else ~left), alone


def _near_roots(rows: DataFrame, least: int) -> DataFrame:
    """(a, b): b is the smallest document that a reaches, within two blocks of a
    bucket, by near signatures of documents of different components."""

    def run(group: pa.Table) -> pa.Table:
        ids, root = group.column("doc_id").to_numpy(), group.column("root").to_numpy()
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
        left, right, alone = _sides(group)
        parent = np.arange(len(ids))
        for x in left.tolist():
            y = right[(root[right] != root[x]) & (parent[right] != parent[x])]
            if alone:
                y = y[y > x]
            y = y[(sig[y] == sig[x]).sum(axis=1) >= least] if len(y) else y
            if len(y):
                parent[np.isin(parent, np.unique(parent[y]))] = parent[x]
        low = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(low, parent, ids)
        linked = np.flatnonzero(low[parent] != ids)
        return pa.table({"a": pa.array(ids[linked], pa.int64()), "b": pa.array(low[parent][linked], pa.int64())})

    return _spread(rows, "key", ["root", "sig"], BLOCK).groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def _family_links(families: DataFrame, roots: DataFrame, sets: DataFrame, sigs: DataFrame, least: int, percent: int) -> DataFrame:
    """Links (a, b) between components of a family, enough to join all that are linked."""
    of_root = roots.select(F.col("node").alias("doc_id"), F.col("root"))
    member = families.select(F.col("node").alias("doc_id"), F.col("root").alias("family")).join(of_root, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    member = member.join(sets, "doc_id").join(sigs, "doc_id")

    def run(group: pa.Table) -> pa.Table:
        ids, label = group.column("doc_id").to_numpy(), group.column("root").to_numpy().copy()
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
        lists = group.column("shingles").combine_chunks()
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        sets_ = [flat[at[k] : at[k + 1]].view(np.uint64) for k in range(len(ids))]
        n = np.diff(at)
        left, right, alone = _sides(group)
        a, b = [], []
        for x in left.tolist():
            y = right[(label[right] != label[x]) & (100 * np.minimum(n[right], n[x]) >= percent * np.maximum(n[right], n[x]))]
            if alone:
                y = y[y > x]
            y = y[(sig[y] == sig[x]).sum(axis=1) >= least] if len(y) else y
            for k in y.tolist():
                if label[k] == label[x]:
                    continue
                p, q = (sets_[x], sets_[k]) if n[x] <= n[k] else (sets_[k], sets_[x])
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                if 100 * both >= percent * (n[x] + n[k] - both):
                    a.append(ids[x])
                    b.append(ids[k])
                    label[label == label[k]] = label[x]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    spread = _spread(member, "family", ["root", "sig", "shingles"], FAMILY_BLOCK, F.size("shingles"), FAMILY_SHINGLES)
    return spread.groupBy("family", "i", "j").applyInArrow(run, "a long, b long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_size=2, percent=80)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: keep one document of each group, on five-word shingles at 0.8.

    A row without an id goes by a number made from its text, above all ids, so that
    copies among such rows, and of other documents, go as well. Of rows with one id
    and one text one stays; rows of one id with different texts are one document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    made = F.xxhash64(text).bitwiseAND((1 << 62) - 1) + F.lit(1 << 62)
    keyed = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), made))
    found = cut(near_duplicates(keyed.select(F.col("__id").alias("doc_id"), "text"), shingle_size=5, percent=80).filter("kept"))
    keep = found.select(F.col("doc_id").alias("__id")).distinct()
    repeated = found.filter("n_shingles > 0").groupBy(F.col("doc_id").alias("__id")).count().filter("count > 1").select("__id")
    repeated = cut(repeated)
    rows = keyed.join(keep, "__id", "left_semi")
    if not repeated.isEmpty():
        few = F.broadcast(repeated) if repeated.count() <= BROADCAST_IDS else repeated
        twice = rows.join(few, "__id", "left_semi").withColumn("__text", F.sha2(text, 256)).dropDuplicates(["__id", "__text"])
        rows = rows.join(few, "__id", "left_anti").unionByName(twice.drop("__text"))
    return rows.select(*docs.columns)


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 2 THEN list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))
                          WHEN len(ws) = 1 THEN ws ELSE [] END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(a, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.a)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, min(r.c) AS component_id, s.doc_id = min(r.c) AS kept
FROM s JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, s.sh
"""
