"""Embedding near-dedup: spherical k-means cells, blocked cosines, one kept per group.

Steps:

1. Vectors with equal bytes collapse to their smallest id with a count.
2. Spherical k-means is fitted on a bounded sample (``SAMPLE`` rows in hash
   order, ``SAMPLE_BYTES`` at most); every vector is assigned to its best cell. How
   many cells, at least ``LEAST_CELLS``, is decided by what cells save on the sample:
   the products of vectors that needn't be compared against the copies of vectors
   that must be. Clustered vectors get many cells, vectors without structure few.
3. A vector also visits each higher cell that could hold a partner. Two bounds,
   both without loss: a partner within cosine t lies within the chord sqrt(2 - 2 t),
   so a vector farther than that from the plane between its own centre and another's
   has none there; and a partner within the angle arccos(t) of it can't be in a cell
   whose widest member is nearer to its centre than the vector by more than that.
4. Residents and visitors of a cell are cut into blocks of ``BLOCK`` vectors by
   hash; each pair of blocks is one task's matrix product in double precision.
   A task returns, per vector, its number of links and a root, never pairs.
5. Links are summed, roots joined into components.

No link is lost; the cost is the number of visits, few for clustered vectors, many
for vectors without structure, of which no exact method compares much less than all.

Defined cases: null or zero vectors and vectors with null or non-finite
components have no links and are kept; vectors of different lengths have no
cosine and don't link; a null id is kept with null component; repeated vectors
link with each other; rows of one id with different vectors count their own links
and are one node of the components; other columns, labels included, aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, cut, table

SAMPLE, SAMPLE_BYTES = 40_000, 48 << 20
LEAST_CELLS, ROUNDS, BLOCK = 4, 12, 8192
#: Sampled vectors by which numbers of cells are compared, and the cost of a copied
#: vector in products of two vectors.
TRIED, COPY_COST = 4000, 5000
#: Rows of a block's matrix product made at once.
STRIP = 512


def _usable(column: pa.ListArray) -> list[bytes | None]:
    """Bytes of each vector's doubles, of very large or small ones scaled; None for unusable ones."""
    at = column.offsets.to_numpy()
    length = np.diff(at)
    flat = column.values
    if not column.null_count and not flat.null_count and len(length) and length[0] > 0 and (length == length[0]).all():
        grids = [(np.arange(len(length)), flat.to_numpy()[at[0] : at[-1]].reshape(len(length), -1))]
    else:  # nulls or several lengths: one vector at a time
        grids = [(np.array([i]), x.values.to_numpy(zero_copy_only=False)[None, :]) for i, x in enumerate(column) if x.is_valid and len(x.values) and not x.values.null_count]
    out: list[bytes | None] = [None] * len(column)
    for rows, grid in grids:
        grid = grid + 0.0  # -0.0 and 0.0 are the same
        ok = np.isfinite(grid).all(axis=1) & grid.any(axis=1)
        most = np.abs(np.where(ok[:, None], grid, 1.0)).max(axis=1)
        odd = (most > 1e100) | (most < 1e-100)
        grid[odd] /= most[odd, None]
        for i, row, good in zip(rows.tolist(), grid, ok, strict=True):
            out[i] = row.tobytes() if good else None
    return out


def _clean(vectors: DataFrame, id_col: str, col: str) -> DataFrame:
    """vec_id, v (bytes of doubles; null where the vector is unusable), digest."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _usable(batch.column(1))
            digest = [None if b is None else hashlib.blake2b(b, digest_size=16).digest() for b in v]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v, pa.binary()), pa.array(digest, pa.binary())], names=["vec_id", "v", "digest"])

    kind = "array<double>"
    return vectors.select(F.col(id_col).cast("long"), F.col(col).cast(kind)).mapInArrow(run, "vec_id long, v binary, digest binary")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_cells(sample: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Centres of spherical k-means: means of unit vectors, scaled to the sphere."""
    x = _unit(sample)
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        best = np.concatenate([np.argmax(part @ centres.T, axis=1) for part in np.array_split(x, max(1, len(x) // 4096))])
        sums = np.zeros_like(centres)
        np.add.at(sums, best, x)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres)
    return np.unique(centres, axis=0)


def _near_cells(s: np.ndarray, own: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Which higher cells may hold partners by the planes between centres; s: vectors x centres."""
    near = s[np.arange(len(s)), own][:, None] - s <= gaps[own] + 1e-9
    return near & (np.arange(s.shape[1])[None, :] > own[:, None])


def _gaps(centres: np.ndarray, threshold: float) -> np.ndarray:
    chord = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    return chord * np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))


def _reach(least: np.ndarray | float, threshold: float):
    """The cosine to a centre below which a vector has no partner in a cell whose
    members have cosines of ``least`` or more."""
    angle = np.arccos(np.clip(least, -1, 1)) + math.acos(max(-1.0, min(1.0, threshold)))
    return np.cos(np.minimum(angle, np.pi)) - 1e-9


def choose_cells(sample: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """Centres of as many cells as make the comparison of n vectors cheapest, judged
    by the sample: from ``LEAST_CELLS`` on, four times as many each time while it helps."""
    rng = np.random.default_rng(5)
    x = _unit(sample)
    tried = x[rng.choice(len(x), size=min(TRIED, len(x)), replace=False)]
    best, cost, k = None, math.inf, LEAST_CELLS
    while True:
        centres = fit_cells(tried, k, rounds=6)
        s = tried @ centres.T
        own = np.argmax(s, axis=1)
        size = np.bincount(own, minlength=len(centres)) / len(tried)
        least = np.ones(len(centres))
        np.minimum.at(least, own, s[np.arange(len(s)), own])
        near = _near_cells(s, own, _gaps(centres, threshold)) & (s >= _reach(least, threshold)[None, :])
        compared = (size * size).sum() / 2 + (near @ size).mean()
        now = n * n * compared + n * (1 + near.sum(axis=1).mean()) * COPY_COST
        if now >= cost:
            break
        best, cost = k, now
        if k * 8 > len(tried):
            break
        k *= 4
    return fit_cells(sample, best)


def _assign(classes: DataFrame, centres: np.ndarray, threshold: float) -> DataFrame:
    """Adds cell, its cosine and visits (higher cells that may hold partners, with their
    cosines). Cell -1: vectors of another length than the centres; they meet in one
    cell, cut into blocks."""
    dim, gaps = centres.shape[1], _gaps(centres, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).to_pylist()
            n = len(raw)
            cell, cosine, counts = np.full(n, -1, dtype=np.int32), np.zeros(n), np.zeros(n, dtype=np.int64)
            at = np.array([i for i, b in enumerate(raw) if len(b) == 8 * dim], dtype=np.int64)
            cells, cosines = [], []
            for part in np.array_split(at, max(1, len(at) // 1024)):
                if not len(part):
                    continue
                s = _unit(np.frombuffer(b"".join(raw[i] for i in part), np.float64).reshape(len(part), dim)) @ centres.T
                own = np.argmax(s, axis=1)
                cell[part], cosine[part] = own, s[np.arange(len(part)), own]
                near = _near_cells(s, own, gaps)
                counts[part] = near.sum(axis=1)
                cells.append(np.nonzero(near)[1])
                cosines.append(s[near])
            flat = [np.concatenate(x) if x else np.zeros(0) for x in (cells, cosines)]
            visits = pa.StructArray.from_arrays([pa.array(flat[0].astype(np.int32)), pa.array(flat[1].astype(np.float64))], names=["cell", "cosine"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), visits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(cosine), lists], names=["digest", "rep", "v", "w", "cell", "cosine", "visits"])

    return classes.select("digest", "rep", "v", "w").mapInArrow(run, "digest binary, rep long, v binary, w long, cell int, cosine double, visits array<struct<cell:int,cosine:double>>")


def _links(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y have a cosine of ``threshold`` or more."""
    nx, ny = (np.sqrt((a * a).sum(axis=1)) for a in (x, y))
    mask = np.empty((len(x), len(y)), dtype=bool)
    for k in range(0, len(x), STRIP):
        mask[k : k + STRIP] = x[k : k + STRIP] @ y.T >= threshold * nx[k : k + STRIP, None] * ny[None, :]
    return mask


def _roots(mask: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id of each row's and column's component in a matrix of links."""
    far = np.iinfo(np.int64).max
    a, b = left.copy(), right.copy()
    while True:
        a2, b2 = a.copy(), b.copy()
        for k in range(0, len(a), STRIP):
            part = mask[k : k + STRIP]
            a2[k : k + STRIP] = np.minimum(a[k : k + STRIP], np.where(part, b2[None, :], far).min(axis=1))
            b2 = np.minimum(b2, np.where(part, a2[k : k + STRIP, None], far).min(axis=0))
        if (a2 == a).all() and (b2 == b).all():
            return a, b
        a, b = a2, b2


def _weights(mask: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums of the weights that each row links to."""
    return np.concatenate([np.where(mask[k : k + STRIP], w[None, :], 0).sum(axis=1) for k in range(0, len(mask), STRIP)])


def _compare(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        kind, i, j = (group.column(c)[0].as_py() for c in ("kind", "i", "j"))
        ids, w, block, role = (group.column(c).to_numpy() for c in ("rep", "w", "block", "role"))
        raw, digest = group.column("v").to_pylist(), group.column("digest")
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        lengths = np.array([len(b) for b in raw])
        for n in np.unique(lengths):
            same = lengths == n
            if kind == 0:
                left, right = np.flatnonzero(same & (block == i)), np.flatnonzero(same & (block == j))
            else:
                left, right = np.flatnonzero(same & (role == 0)), np.flatnonzero(same & (role == 1))
            if not len(left) or not len(right):
                continue
            x, y = (np.frombuffer(b"".join(raw[k] for k in rows), np.float64).reshape(len(rows), -1) for rows in (left, right))
            mask = _links(x, y, threshold)
            alone = kind == 0 and i == j
            if alone:
                np.fill_diagonal(mask, False)
            rows, cols = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
            if not len(rows):
                continue
            mask = mask[np.ix_(rows, cols)]
            left, right = left[rows], right[cols]
            a, b = _roots(mask, ids[left], ids[right])
            out.append((left, _weights(mask, w[right]), a))
            if not alone:
                out.append((right, _weights(mask.T, w[left]), b))
        rows, links, root = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3))
        return pa.table({"digest": digest.take(pa.array(rows)), "rep": pa.array(ids[rows], pa.int64()), "links": pa.array(links.astype(np.int64)), "root": pa.array(root, pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", col: str = "embedding", cells: int | None = None, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept. ``cells`` fixes the number of cells."""
    clean = cut(_clean(vectors, id_col, col))
    usable = clean.filter("v is not null and vec_id is not null")
    classes = cut(usable.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), F.first("v").alias("v")))
    n, widest = classes.agg(F.count("*"), F.mode(F.length("v"))).first()
    rows = min(SAMPLE, SAMPLE_BYTES // max(8, widest or 8))
    picked = classes.filter(F.length("v") == (widest or 0)).orderBy(F.xxhash64("rep"), "rep").select("v").limit(rows).collect()
    if picked:
        sample = np.frombuffer(b"".join(r.v for r in picked), np.float64).reshape(len(picked), -1)
        centres = fit_cells(sample, cells) if cells else choose_cells(sample, n, threshold)
    else:
        centres = np.ones((1, 1))
    placed = cut(_assign(classes, centres, threshold))

    # Bounded: one row for each cell.
    within = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("cosine").alias("least"))
    angle = F.acos(F.greatest(F.least("least", F.lit(1.0)), F.lit(-1.0))) + math.acos(max(-1.0, min(1.0, threshold)))
    within = cut(within.select("cell", F.ceil(F.col("n") / block).cast("int").alias("nr"), (F.cos(F.least(angle, F.lit(math.pi))) - 1e-9).alias("reach")))
    residents = placed.select("digest", "rep", "v", "w", F.lit(0).alias("role"), "cell")
    visitors = placed.select("digest", "rep", "v", "w", F.lit(1).alias("role"), F.inline("visits"))
    visitors = visitors.join(F.broadcast(within), "cell").filter("cosine >= reach").select("digest", "rep", "v", "w", "role", "cell")
    guests = placed.select(F.inline("visits")).join(F.broadcast(within), "cell").filter("cosine >= reach").groupBy("cell").count()
    guests = guests.select("cell", F.ceil(F.col("count") / block).cast("int").alias("nv"))
    blocks = F.broadcast(within.select("cell", "nr").join(guests, "cell", "left").na.fill(0, ["nv"]))
    every = residents.unionByName(visitors).join(blocks, "cell")
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("role") == 0, F.col("nr")).otherwise(F.col("nv")).cast("long")).cast("int")
    every = every.withColumn("block", own)
    tasks = F.when(
        F.col("role") == 0,
        F.expr("concat(transform(sequence(0, nr - 1), o -> struct(0 AS kind, least(block, o) AS i, greatest(block, o) AS j)), IF(nv > 0, transform(sequence(0, nv - 1), o -> struct(1 AS kind, block AS i, o AS j)), array()))"),
    ).otherwise(F.expr("transform(sequence(0, nr - 1), o -> struct(1 AS kind, o AS i, block AS j))"))
    spread = every.withColumn("t", F.explode(tasks)).select("cell", "t.kind", "t.i", "t.j", "digest", "rep", "v", "w", "role", "block")
    found = cut(spread.groupBy("cell", "kind", "i", "j").applyInArrow(_compare(threshold), "digest binary, rep long, links long, root long"))

    links = found.groupBy("digest").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    of_class = classes.select("digest", "rep", "w").join(links, "digest", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select(F.col("digest").alias("_d"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("_n"), F.coalesce("root", "rep").alias("_c"))
    out = clean.select("vec_id", "digest").join(of_class, F.col("digest") == F.col("_d"), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("_c", "vec_id"))
    return out.select("vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a),
r(a, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.a)
SELECT e.vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(r.c) AS component_id, e.vec_id = min(r.c) AS kept
FROM embeddings e JOIN r ON r.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id GROUP BY e.vec_id
"""
