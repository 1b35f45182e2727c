import numpy as np
import pytest

from sparkloom.llm import embed_dedup, minhash
from sparkloom.llm.common import connected_components, shingle_sets


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def vectors(seed=3, n=260, dim=8):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, dim))
    near = base[rng.integers(0, 12, n // 2)] + rng.normal(size=(n // 2, dim)) * 0.12
    copies = np.repeat(base[:1], n // 4, axis=0) * rng.choice([1.0, 1.0, 2.5], n // 4)[:, None]
    return np.vstack([base, near, copies])


def brute(x, threshold=0.95):
    usable = np.array([v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in x])
    links = []
    for i in range(len(x)):
        for j in range(i):
            if usable[i] and usable[j] and len(x[i]) == len(x[j]):
                a, b = np.array(x[i], float), np.array(x[j], float)
                if a @ b >= threshold * np.sqrt(a @ a) * np.sqrt(b @ b):
                    links.append((j, i))
    n = [0] * len(x)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return n, components(len(x), links)


@pytest.mark.parametrize("cells,block", [(16, 7), (40, 1000), (None, 30)])
def test_vectors_equal_brute_force(spark, cells, block):
    x = vectors().tolist()
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(x)], "vec_id long, embedding array<double>, cell string")
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(df, cells=cells, block=block).collect()}
    n, root = brute(x)
    assert sum(n) > 500 and len(set(root)) > 20
    assert [got[i].n_links for i in range(len(x))] == n
    assert [got[i].component_id for i in range(len(x))] == root
    assert all(got[i].kept == (root[i] == i) for i in range(len(x)))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    x = [[1.0, 0.0], None, [0.0, 0.0], [None, 1.0], [nan, 1.0], [inf, 1.0], [2.0, 0.01], [1.0, 0.0, 0.0], [], [1.0, 0.0], [1e300, 1e298], [-1.0, 0.0], [1.0, 0.0, 0.001]]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df).collect()}
    assert got == {0: (3, 0, True), 1: (0, 1, True), 2: (0, 2, True), 3: (0, 3, True), 4: (0, 4, True), 5: (0, 5, True), 6: (3, 0, False), 7: (1, 7, True), 8: (0, 8, True), 9: (3, 0, False), 10: (3, 0, False), 11: (0, 11, True), 12: (1, 7, False)}
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0
    null_id = spark.createDataFrame([(None, [1.0]), (1, [1.0])], "vec_id long, embedding array<double>")
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(null_id).collect()} == {(None, 0, None, True), (1, 0, 1, True)}


def test_one_id_on_two_vectors(spark):
    x = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (3, [0.01, 1.0])]
    df = spark.createDataFrame(x, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (3, 2, 1)]


def test_cells_follow_the_structure():
    """Clustered vectors get many cells, which spare most products; others few."""
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(200, 32))
    tight = middle[rng.integers(0, 200, 4000)] + rng.normal(size=(4000, 32)) * 0.05
    many = embed_dedup.choose_cells(tight, 1_000_000, 0.95)
    few = embed_dedup.choose_cells(rng.normal(size=(4000, 32)), 10_000, 0.95)
    assert len(many) >= 64 and embed_dedup.LEAST_CELLS <= len(few) <= 16
    x = embed_dedup._unit(tight)
    s = x @ many.T
    own = s.argmax(axis=1)
    size = np.bincount(own, minlength=len(many))
    least = np.ones(len(many))
    np.minimum.at(least, own, s[np.arange(len(s)), own])
    near = embed_dedup._near_cells(s, own, embed_dedup._gaps(many, 0.95)) & (s >= embed_dedup._reach(least, 0.95)[None, :])
    compared = (size * size).sum() / 2 + (near @ size).sum()
    assert compared < 0.2 * len(x) ** 2 / 2
    links = x @ x.T >= 0.95  # no partner is outside of the cells that are compared
    i, j = np.nonzero(np.triu(links, 1))
    a, b = np.where(own[i] <= own[j], i, j), np.where(own[i] <= own[j], j, i)
    assert ((own[a] == own[b]) | near[a, own[b]]).all()


def test_components_of_paths_stars_and_cycles(spark):
    rng = np.random.default_rng(0)
    order = rng.permutation(400).tolist()
    links = list(zip(order[:200], order[1:200])) + [(order[200], x) for x in order[201:300]] + [(order[300], order[301]), (order[301], order[302]), (order[302], order[300])]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components(400, links)
    assert got == {i: want[i] for pair in links for i in pair}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_hub_in_parts(spark):
    """A node with thousands of neighbours on both sides is joined in parts."""
    hub = 5000
    links = [(hub, i) for i in range(0, 10_000, 2) if i != hub] + [(10_001, 10_003)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(0, 10_000, 2)} | {10_001: 10_001, 10_003: 10_001}


# --- texts ---


def words(t):
    return [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")).split(" ") if w]


def text_brute(texts, k, percent=80):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    links = [(j, i) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return [len(s) for s in sets], components(len(texts), links)


def family(rng, vocab, n_words, copies, edits):
    base = rng.choice(vocab, n_words).tolist()
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(edits):
            w[rng.integers(len(w))] = str(rng.choice(vocab))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_texts_equal_brute_force(spark, k):
    rng = np.random.default_rng(k)
    vocab = [f"w{i}" for i in range(3000)]
    texts = [None, "", " \n\t ", "One", "one", "ONE two", "one  two", "a b c d", "A\tB\nC d", "É a", "é a", "one two"]
    for edits in (0, 1, 3, 5, 7, 9):
        texts += family(rng, vocab, 120, 25, edits)
    texts += ["x " * 30_000, "x " * 30_000 + "y", " ".join(rng.choice(vocab, 20_000))]
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    df = spark.createDataFrame([(i, t, i, "c") for i, t in enumerate(texts)], "doc_id long, text string, root long, key string")
    got = {r.doc_id: r for r in minhash.near_duplicates(df, shingle_size=k).collect()}
    sizes, root = text_brute(texts, k)
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == root
    assert all(got[i].kept == (root[i] == i) for i in range(len(texts)))


def test_blocks_of_families_lose_no_link(spark, monkeypatch):
    """Small blocks: large components have blocks of their own, the rest share theirs."""
    monkeypatch.setattr(minhash, "BLOCK", 6)
    monkeypatch.setattr(minhash, "FAMILY_BLOCK", 5)
    monkeypatch.setattr(minhash, "FAMILY_SHINGLES", 900)
    rng = np.random.default_rng(12)
    vocab = [f"w{i}" for i in range(2000)]
    texts = []
    for edits in (3, 6, 8, 9, 10):
        texts += family(rng, vocab, 100, 30, edits)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, shingle_size=2).collect()}
    assert [got[i] for i in range(len(texts))] == text_brute(texts, 2)[1]


def test_blocks_of_one_component_never_meet(spark):
    rows = [(7, i, 0 if i < 900 else i) for i in range(905)] + [(8, i, 3) for i in range(1000, 1400)]
    df = spark.createDataFrame(rows, "g long, doc_id long, root long")
    spread = minhash._spread(df, "g", ["root"], 100)
    assert spread.count() == 900 + 5 * (9 + 1) and spread.filter("g = 8").count() == 0
    tasks = {}
    for r in spread.collect():
        tasks.setdefault((r.i, r.j), []).append(r)
    assert len(tasks) == 10 and max(map(len, tasks.values())) <= 160
    met = {(x.doc_id, y.doc_id) for t in tasks.values() for x in t for y in t}
    assert all((a, b) in met for a in range(905) for b in range(900, 905))


def test_text_edges(spark):
    df = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (2, "a b c"), (7, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, 2).collect()}
    assert got == {(None, 2, None, True), (5, 2, 2, False), (2, 2, 2, True), (7, 0, 7, True)}
    assert minhash.near_duplicates(df.limit(0), 2).count() == 0


def test_repeated_rows_and_missing_ids_in_the_stage(spark):
    base = " ".join(f"w{i}" for i in range(60))
    near = base + " end"
    rows = [(None, base)] * 30 + [(7, near)] * 5 + [(8, base)] + [(None, "alone here among all the others")] * 3 + [(9, "x y z"), (9, "other words of one id")] + [(None, None), (None, ""), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = sorted(((r.doc_id, r.text) for r in minhash.stage(spark, df, "").collect()), key=str)
    assert out == sorted([(7, near), (None, "alone here among all the others"), (9, "x y z"), (9, "other words of one id"), (None, None), (None, ""), (5, "")], key=str)
    found = minhash.near_duplicates(df.filter("doc_id is not null"), 5).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(5, 5)] + [(7, 7)] * 5 + [(8, 7), (9, 9), (9, 9)]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200).astype(np.uint64)])
    sig = minhash.signatures([np.unique(a), np.unique(b), np.zeros(0, np.uint64)], 2000)
    assert abs((sig[:, 0] == sig[:, 1]).mean() - 800 / 1200) < 0.04
    assert (sig[:, 2] == 0xFFFFFFFF).all()


def test_shingles_of_runs_do_not_cross_texts():
    texts = [b"a b", b"", b"c d e", b"  f"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    sets, n = shingle_sets(data, at, 2)
    assert [len(s) for s in sets] == [1, 0, 2, 1] and n.tolist() == [2, 0, 3, 1]
    alone, _ = shingle_sets(np.frombuffer(b"c d e", np.uint8), np.array([0, 5]), 2)
    assert (alone[0] == sets[2]).all()
