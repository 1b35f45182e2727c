import hashlib
import re
from pathlib import Path

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm import bpe, common, minhash, mixing, pii, toxicity
from sparkloom.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_and_columns():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash near-dedup", "pii", "mixing", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs, out = table(spark, sf, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs = docs.checkpoint()
        out.append(docs)
    return out


def test_each_stage_against_its_operator(spark, sf, steps):
    before = table(spark, sf, "documents")
    for k in range(4):
        assert steps[k].columns == before.columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    lexicon = toxicity.train(before, table(spark, sf, "labels").filter(toxicity.crc_mod(5) != 0))
    assert ids(steps[0]) == ids(toxicity.score(before, lexicon).filter("predicted = 0"))
    assert ids(steps[1]) == ids(minhash.near_duplicates(steps[0], 5).filter("kept"))
    assert ids(steps[2]) == ids(steps[1])
    assert pii.base_spans(steps[2]).filter("size(spans) > 0").count() == 0
    taken = {r.doc_id: int(r.taken / max(r["size"], 1) + 0.5) for r in mixing.mix(steps[2]).collect()}
    assert ids(steps[3]) == sorted(i for i, n in taken.items() for _ in range(n))
    assert ids(steps[4]) == ids(steps[3])


def test_tokens_of_the_last_stage(steps):
    t = Tokenizer.from_file(bpe.default_path())
    texts = {r.doc_id: r.text for r in steps[3].collect()}
    for r in steps[4].collect():
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_run_applies_all_stages(spark, sf, steps):
    assert sorted(corpus_pipeline.run(spark, sf).collect()) == sorted(steps[4].collect())


def test_odd_rows(spark, sf):
    rows = [(900_001, None, None, None, None), (900_002, "", "en", None, 0), (900_003, "a b c d e f", "en", "s", 11), (900_004, "a b c d e f", "en", "t", 11), (None, "mail x@y.zz now", "en", "s", 15), (900_005, "word " * 30_000, "en", "s", 150_000)]
    for given in (spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)):
        docs = given
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf).checkpoint()
            if name == "minhash near-dedup" and given.count():
                assert {r.doc_id for r in docs.collect()} == {900_001, 900_002, 900_003, None, 900_005}
            if name == "pii" and given.count():
                assert "mail [EMAIL] now" in {r.text for r in docs.collect()}
        assert docs.count() <= 2 * given.count()


def test_clashing_columns_are_kept(spark, sf):
    names = ["_id", "_h", "_n", "_k", "_spans", "h", "size", "label", "score", "key", "root", "sig", "taken", "target", "part", "t", "word"]
    docs = table(spark, sf, "documents").limit(30)
    for n in names:
        docs = docs.selectExpr("*", f"'{n}' AS {n}")
    docs = docs.checkpoint()
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert all(r[n] == n for r in out.select(*names).collect() for n in names)


@pytest.mark.skipif(not Path("/proc/self/status").exists(), reason="memory is read from /proc")
def test_checkpoints_give_back_native_memory_of_the_driver(spark, monkeypatch):
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    mb = lambda: int(re.search(r"RssAnon:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) / 1024
    monkeypatch.setattr(common, "_driver_tidied", float("-inf"), raising=False)
    common.cut(spark.range(1))
    before = mb()
    native = [jvm.java.util.zip.Deflater() for _ in range(1000)]  # zlib allocates outside of the heap
    held = mb() - before
    for d in native[:-1]:  # the last keeps the C library from returning what lies below it
        d.end()
    freed = mb()
    monkeypatch.setattr(common, "_driver_tidied", float("-inf"), raising=False)
    common.cut(spark.range(1))
    native[-1].end()
    assert held > 30 and freed - mb() > held / 2
