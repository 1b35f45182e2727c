import zlib

import numpy as np
import pytest

from sparkloom.llm import quality, toxicity
from sparkloom.llm.common import table


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    values, at = np.unique(score[order], return_inverse=True)
    rank[order] = np.array([np.flatnonzero(at == k).mean() for k in range(len(values))])[at] if len(values) < len(score) else np.arange(len(score))
    good = y == 1
    return (rank[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())


@pytest.mark.parametrize("module,label,mod,held,least", [(quality, "quality", 3, 1, 0.97), (toxicity, "toxic", 5, 0, 0.75)])
def test_held_out_accuracy(spark, module, label, mod, held, least):
    sf = "/root/testdata/sf0.01"
    got = module.query(spark, sf).toPandas().set_index("doc_id")
    assert len(got) == table(spark, sf, "documents").count()
    assert all(got.held_out == [zlib.crc32(str(i).encode()) % mod == held for i in got.index])
    assert ((got.score >= 0.5) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    both = got.join(table(spark, sf, "labels").toPandas().set_index("doc_id"), how="inner")
    both = both[both.held_out]
    assert auc(both.score.to_numpy(), both[label].to_numpy()) >= least
    assert (both.predicted == both[label]).mean() >= 0.9
    again = module.query(spark, sf).toPandas().set_index("doc_id")
    assert (again.score.reindex(got.index) == got.score).all()


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_edges(spark, module, label):
    texts = ["plain words here", None, "", "x" * 200_000, "plain words here"]
    docs = spark.createDataFrame([(i, t, "e", 1) for i, t in enumerate(texts)] + [(None, "no id", "e", 1)], "doc_id long, text string, label string, score int")
    labels = spark.createDataFrame([(0, 1), (3, None)], f"doc_id long, {label} int")
    model = module.train(docs, labels)
    rows = module.score(docs, model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[0] == by[4] and by[1] == by[2]
    assert module.score(docs.limit(0), model).count() == 0
    if module is toxicity:
        assert all(r.predicted == 0 for r in rows)


def test_features_of_a_text_do_not_depend_on_its_run():
    texts = [b"One two. Two!", b"", b"AA%%% bb\nbb bb\n", "éé ñ".encode(), b"|||"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    x = quality.features(data, at)
    for t, row in zip(texts, x, strict=True):
        assert np.allclose(quality.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0], row)
    assert (x[1] == 0).all()


def test_folding():
    fold = toxicity.fold
    assert fold("1D10T m0r0n! Stуpid Ｓｃum") == " idiot moron  stypid scum "
    assert fold("in 2024, 1034 $$$ fine!!") .split() == ["in", "fine"]
    assert fold("") == "  "


def test_terms_exceptions_and_length():
    lex = toxicity.Lexicon({" idiot": 5.0, " idiots ": 6.0, " scum ": 4.0}, frozenset({" scum line "}), level=0.3)
    assert lex.hits(toxicity.fold("an idiot and idiots")) == {3: 5.0, 13: 6.0}
    assert lex.hits(toxicity.fold("the scum line is scum")) == {17: 4.0}
    assert lex.density(toxicity.fold("scum " + "word " * 99)) == pytest.approx(4 / np.sqrt(103))
    assert lex.score(0.0) < 0.5 < lex.score(5.0)
    assert toxicity.Lexicon({}).score(0.0) < 0.5


def test_learned_terms_are_those_of_toxic_texts(spark):
    rng = np.random.default_rng(5)
    vocab = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400)]
    rows, labels = [], []
    for i in range(400):
        w = rng.choice(vocab, 30).tolist()
        bad = i % 4 == 0
        if bad:
            w[int(rng.integers(30))] = str(rng.choice(["zonkhead", "Z0nkface", "vilewort"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lex = toxicity.train(docs, marks)
    assert any(t.startswith(" zonk") for t in lex.terms) and any(t.startswith(" vile") for t in lex.terms)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, lex).collect()}
    assert np.mean([got[i] == y for i, y in labels]) > 0.99
    kept = docs.filter(~toxicity._is_toxic(lex)("text")).count()
    assert kept == sum(1 for v in got.values() if v == 0)


def test_only_near_copies_are_left_out_of_the_fit():
    a, b = tuple(range(8)), tuple(range(100, 108))
    one_off, two_off, shared = (*a[:3], 77, *a[4:]), (*a[:3], 77, 78, *a[5:]), (*a[:1], *b[1:])
    assert toxicity.unlike([(1, 0, a), (2, 0, a), (3, 0, one_off), (4, 0, two_off), (5, 1, a), (6, 0, b), (7, 0, shared), (8, 0, (9, *b[1:]))]) == [1, 4, 5, 6]
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(2)), tuple(rng.integers(0, 2, 8).tolist())) for i in range(400)]
    kept = []
    for i, y, s in rows:
        if not any(y == z and sum(p != q for p, q in zip(s, o, strict=True)) <= 1 for _, z, o in kept):
            kept.append((i, y, s))
    assert toxicity.unlike(rows) == [i for i, _, _ in kept]


def test_a_phrase_of_one_toxic_document_is_no_exception(spark):
    rng = np.random.default_rng(6)
    vocab = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400)]
    rows, labels = [], []
    for i in range(300):
        w = rng.choice(vocab, 30).tolist()
        bad = i % 3 == 0
        if bad:
            w[4:5] = ["zonkhead"]
        elif i % 10 == 1:
            w[4:6] = ["zonkhead", "statue"]
        elif i % 10 == 2:
            w[4:6] = ["zonkhead", "museum"]
        if i == 0:
            w[4:6] = ["zonkhead", "statue"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    old = toxicity.WEIGHT
    toxicity.WEIGHT = 1.0
    try:
        lex = toxicity.train(docs, marks)
    finally:
        toxicity.WEIGHT = old
    assert any(t.startswith(" zonk") for t in lex.terms)
    assert " zonkhead museum " in lex.exceptions and " zonkhead statue " not in lex.exceptions


# --- the fits again, in plain Python ---


def plain_pairs(x, y, seed=11):
    """Bradley-Terry weights by gradient ascent, from the same pairs that the fit draws."""
    z = quality.expand(x)
    mean, scale = z.mean(axis=0), z.std(axis=0) + 1e-6
    z = np.clip((z - mean) / scale, -8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(seed)
    m = min(quality.PAIRS, 50 * len(y))
    d = z[rng.choice(good, m)] - z[rng.choice(bad, m)]
    w = np.zeros(d.shape[1])
    for _ in range(60_000):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        g = d.T @ p / m - quality.RIDGE * w
        if np.abs(g).max() < 1e-7:
            break
        w += 0.2 * g
    return w, p


def test_quality_scores_equal_a_plain_fit(spark):
    rng = np.random.default_rng(1)
    words = ["plain", "words", "of", "some", "length", "BUY", "NOW", "$$$", "%%%", "a"]
    texts = [" ".join(rng.choice(words[:5] if k % 2 else words[3:], 20 + k % 7)) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 2 == 1) if k % 9 else int(k % 2 == 0)) for k in range(60)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    raw = [t.encode() for t in texts]
    x = quality.features(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    y = np.array([r.quality for r in sorted(labels.collect())])
    order = np.lexsort([*x.T, y])
    w, _ = plain_pairs(x[order], y[order])
    s = np.clip((quality.expand(x) - model.mean) / model.scale, -8, 8) @ w
    cuts = np.unique(np.quantile(s, np.unique(np.concatenate([np.linspace(0, 1, 401), [np.mean(y == 0)]]))))
    right = [np.mean(s[y == 1] >= t) + np.mean(s[y == 0] < t) for t in cuts]
    best = np.flatnonzero(np.array(right) >= max(right) - 1e-9)
    want = 1 / (1 + np.exp(-np.clip((s - (cuts[best[0]] + cuts[best[-1]]) / 2) / max(s.std() / 4, 1e-6), -30, 30)))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert np.allclose([got[k] for k in range(60)], want, atol=0.02)


def test_toxicity_scores_equal_plain_matching(spark):
    """Terms, exceptions and length norm by a search of every term at every place."""
    lex = toxicity.Lexicon({" idiot": 5.0, " idiots ": 6.0, " scum ": 4.0, " zonk": 3.5}, frozenset({" scum line ", " zonk zonk "}), level=0.3)
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["idiot", "IDIOTS", "idiotic", "scum", "line", "Z0nk", "zonked", "plain", "x,y"], int(rng.integers(0, 25)))) for _ in range(200)] + [None, ""]

    def plain(text):
        f = toxicity.fold(text or "")
        heaviest: dict = {}
        for t, w in lex.terms.items():
            for k in range(len(f)):
                if f.startswith(t, k):
                    heaviest[k] = max(heaviest.get(k, 0.0), w)
        for t in lex.exceptions:
            for k in range(len(f)):
                if f.startswith(t, k):
                    heaviest = {p: w for p, w in heaviest.items() if not k <= p < k + len(t) - 1}
        d = sum(heaviest.values()) / np.sqrt(f.count(" ") + 1)
        return 1 / (1 + np.exp(-np.clip(lex.slope * (np.log1p(d) - np.log1p(lex.level)), -30, 30)))

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, lex).collect()}
    assert np.allclose([got[k] for k in range(len(texts))], [plain(t) for t in texts])
