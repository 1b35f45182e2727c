import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def brute(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


TEXTS = [
    None, "", "a.b@c.de, x@y, @z.q 1.2.3.4 and 1.2.3.4.5.6.7.8 999.1.1.1 000255.0.0.1 99999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111111111111112 4111-1111-1111-1111-5 +1 (968) 555-2281, +12 3 +123456789012345678",
    "é中😀 q@r.st é +49 30 1234567é a@b.c_x@y.z a@b..c %@a.b", "9" * 60_000, "a" * 60_000 + "@b.c", "1 " * 20_000 + "4111111111111111", "1.1." * 9000,
    "x@y.z" * 200, "+1" + "(" * 50_000, "4" * 16 + " 4-4  4", "10.0.0.1" * 3, "@" * 1000,
]


def check(found, texts):
    for i, t in enumerate(texts):
        got = [(s.kind, s.start, s.end) for s in found[i].spans]
        assert got == brute(t), (t or "")[:80]


def test_spans_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, "s", "h") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string, h string")
    check({r.doc_id: r for r in pii.find(df).collect()}, TEXTS)
    assert pii.find(df.limit(0)).count() == 0


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet=list("a.@-+ 0149()_é\n%"), max_size=60), min_size=40, max_size=40))
def test_random_texts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check({r.doc_id: r for r in pii.base_spans(df).collect()}, texts)


def test_query_digests(spark, sf):
    got = pii.query(spark, sf).toPandas().set_index("doc_id")
    texts = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id").text
    assert len(got) == len(texts)
    for i, t in texts.items():
        spans = brute(t)
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got.base_sha256[i] == hashlib.sha256(written.encode()).hexdigest() and got.spans[i].startswith(written)
        assert [got[f"n_{k}"][i] for k in BASE] == [sum(s[0] == k for s in spans) for k in BASE]


def revealing():
    """Five different texts where 'Zanzibarite' is only ever seen with one address."""
    fill = ["river stone", "green house", "open field", "long winter", "small boat"]
    texts = [f"{a} from Zanzibarite clerk mail z@corp.example about {a} matters" for a in fill]
    texts += [f"common clerk words {a} nobody@else{k}.example" for k, a in enumerate(fill)]
    texts += [f"common clerk words from mail about {k} {a} matters" for k in range(10) for a in fill]
    return [*texts, "the ZANZIBARITE again"]


def test_revealing_terms_by_hand(spark):
    texts = revealing()
    df = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find(df, elsewhere=3).collect()}
    for i in range(5):
        a = texts[i].index("Zanzibarite")
        assert got[i] == [*brute(texts[i]), ("generalise", a, a + 11)]
    assert got[len(texts) - 1] == [("generalise", 4, 15)]
    assert all(got[i] == brute(texts[i]) for i in range(5, len(texts) - 1))
    clean = {r.doc_id: r for r in pii.sanitise(df, elsewhere=3).collect()}
    assert clean[0].text == "river stone from [NAME] clerk mail [EMAIL] about river stone matters"
    assert clean[0].n_chars == len(clean[0].text) and clean[7].text == texts[7].replace("nobody@else2.example", "[EMAIL]")
    assert clean[len(texts) - 1].text == "the [NAME] again"
    removed = {r.doc_id: r for r in pii.sanitise(df, remove=0.8, elsewhere=3).collect()}
    assert removed[len(texts) - 1].text == "the  again"
    own = {r.doc_id: r.text for r in pii.sanitise(df).collect()}  # without ``elsewhere``, where the address is
    assert own[0] == clean[0].text and own[len(texts) - 1] == texts[-1]
    none = {r.doc_id: r for r in pii.sanitise(df, min_contexts=50).collect()}
    assert none[len(texts) - 1].text == texts[-1]


def test_a_name_beside_an_address_seen_once(spark):
    """No pair has three contexts here; few contexts must weigh less, not exclude."""
    texts = ["common words about the open field"] * 199
    texts = [f"{t} part" if i % 2 else t for i, t in enumerate(texts)] + ["common words about Quillfeather and quillfeather mail q@corp.example the open field"]
    texts[0] += " and mail"
    texts[2:5] = ["common mail words and the open field"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean.pop(199) == "common words about [NAME] and [WORD] mail [EMAIL] the open field"
    assert clean == dict(enumerate(texts[:199]))


def test_names_far_from_an_address(spark):
    """The whole document is the context; terms may be short, long, or hold digits and hyphens."""
    fill = "common words about the open field and mail "
    names = ["Bo", "AB12", "Anne-Quill", "x" * 60, "4711"]
    odd = "q@corp.example " + fill * 20 + "".join(f"and {n} " for n in names) + fill * 20 + "Bo"
    df = spark.createDataFrame([*((i, fill) for i in range(299)), (299, odd)], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean.pop(299) == "[EMAIL] " + fill * 20 + "and [NAME] and [CODE] and [NAME] and [WORD] and [NUMBER] " + fill * 20 + "[NAME]"
    assert set(clean.values()) == {fill}


def test_sanitise_keeps_rows_and_columns(spark):
    rows = [(None, "a@b.cd", "x"), (1, None, "y"), (1, "4111111111111111, 10.0.0.1", "z"), (1, "4111111111111111, 10.0.0.1", "z"), (2, "+1 (968) 555-2281", "_id")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    out = pii.sanitise(df.withColumnRenamed("_id", "h"))
    assert out.columns == ["doc_id", "text", "h"]
    assert sorted(r.text or "" for r in out.collect()) == ["", "[CARD], [IP]", "[CARD], [IP]", "[EMAIL]", "[PHONE]"]


def test_no_python_in_the_plan(spark, sf):
    plan = pii.query(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_many_matches_in_one_text(spark):
    """Cost grows with the matches, not with their square."""
    import time

    from pyspark.sql import functions as F

    n = 100_000
    df = spark.createDataFrame([(0, "joe@corp.example mails, " * n), (1, "x")], "doc_id long, text string")
    began = time.perf_counter()
    got = pii.base_spans(df).select(F.size("spans"), F.try_element_at("spans", F.lit(-1))["start"]).collect()
    assert sorted(tuple(r) for r in got) == [(0, None), (n, 24 * (n - 1))]
    assert time.perf_counter() - began < 60


def test_masks_of_overlapping_spans_and_marks(spark):
    from pyspark.sql import functions as F

    text = "﻿a﻿😀 bcdef ghi﻿"
    spans = [("email", 1, 4), ("card", 3, 6), ("phone", 5, 8), ("generalise", 9, 12), ("remove", 12, 13)]
    df = spark.createDataFrame([(text, spans), (text, []), ("", [])], "t string, s array<struct<kind:string,start:bigint,end:bigint>>")
    got = [r.m for r in df.select(F.when(F.size("s") > 0, pii._masked(F.col("t"), F.col("s"))).alias("m")).collect()]
    assert got == [text[:1] + "[EMAIL]" + text[8] + "[WORD]" + text[13:], None, None]


def test_terms_that_meet_spans_are_covered(spark):
    from pyspark.sql import functions as F

    rng = __import__("random").Random(4)
    rows = []
    for _ in range(60):
        base = sorted({rng.randrange(0, 60, 5) for _ in range(rng.randrange(6))})
        more = sorted({rng.randrange(60) for _ in range(rng.randrange(8))})
        rows.append(([("email", a, a + rng.randrange(1, 5)) for a in base], [("generalise", a, a + 2) for a in more]))
    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    got = spark.createDataFrame(rows, f"b {kind}, m {kind}").select("b", "m", pii._free(F.col("b"), F.col("m")).alias("f")).collect()
    for r in got:
        assert [tuple(x) for x in r.f] == [tuple(m) for m in r.m if not any(s.start < m.end and m.start < s.end for s in r.b)]


def test_clean_documents_keep_rare_words(spark):
    """A rare word beside an address is masked there, not in documents without the address."""
    fill = "common words about the open field and mail "
    rows = [(i, fill) for i in range(2000)] + [(2000, fill + "zyzzyva"), (2001, "q@corp.example " + fill + "zyzzyva")]
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[2001] == "[EMAIL] " + fill + "[WORD]" and clean[2000] == fill + "zyzzyva"


def test_terms_equal_a_plain_count(spark, sf, monkeypatch):
    """Every (term, entity) pair scored by counts in plain Python; then with shuffles for broadcasts."""
    import collections
    import math

    import regex

    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    spans = {r.doc_id: brute(r.text) for r in rows}
    term = regex.compile(r"(?<![\p{L}\p{M}\p{N}@._%+-])[\p{L}\p{M}\p{N}]++(?:[-'’][\p{L}\p{M}\p{N}]++)*+(?![@_%+-])")
    words = {r.doc_id: {w.lower() for w in term.findall(r.text)} for r in rows}
    held = {r.doc_id: {(k, r.text[a:b].lower()) for k, a, b in spans[r.doc_id]} for r in rows}
    text = {r.doc_id: r.text for r in rows}
    n_t = collections.Counter(w for ws in words.values() for w in ws)
    n_e = collections.Counter(e for es in held.values() for e in es)
    n_te = collections.Counter((w, e) for i, es in held.items() for e in es for w in words[i])
    contexts = collections.defaultdict(set)
    for i, es in held.items():
        for e in es:
            for w in words[i]:
                contexts[w, e].add(text[i])

    def share(w, e):
        p = n_e[e] / len(rows)
        c = len(contexts[w, e])
        return 1 - math.log2((c * n_te[w, e] / n_t[w] + p) / (c + 1)) / math.log2(p)

    want = {}
    for i, es in held.items():
        chosen = {w for w in words[i] if es and max(share(w, e) for e in es) >= pii.GENERALISE}
        places = [(m.start(), m.end()) for m in term.finditer(text[i]) if m.group().lower() in chosen]
        want[i] = [(a, b) for a, b in places if not any(x < b and a < y for _, x, y in spans[i])]
    assert sum(map(len, want.values())) > 100
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for limit in (pii.BROADCAST_BYTES, 0):
        monkeypatch.setattr(pii, "BROADCAST_BYTES", limit)
        got = {r.doc_id: sorted((s.start, s.end) for s in r.spans if s.kind in pii.TERM_KINDS) for r in pii.find(docs).collect()}
        assert got == want
    masked = pii.sanitise(docs)
    assert masked.count() == len(rows) and all(r.text == text[r.doc_id] for r in masked.collect() if not spans[r.doc_id])


def test_counts_by_sql():
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(TEXTS)), "text": TEXTS}))
    got = con.execute(pii.ORACLE_COUNTS).df().set_index("doc_id")
    for i, t in enumerate(TEXTS):
        if len(t or "") > 5000:  # the patterns in Python take minutes for these
            continue
        assert [got[f"n_{k}"][i] for k in BASE] == [sum(s[0] == k for s in brute(t)) for k in BASE], (t or "")[:60]
