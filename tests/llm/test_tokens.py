import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkloom.llm import bpe, token_counts, token_files

W = Tokenizer.from_file(token_files.default_path())
SMALL = token_files.WordEncoder(token_files.default_path(), cache=20)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aAbÉé1 \n\t'stΣ!$—中\x1c\x85\xa0<|>")) | st.characters(exclude_categories=["Cs", "Cn"]), max_size=40))
def test_words_equal_the_library(text):
    for t in (text, text + " <|endoftext|>x", text):
        assert np.frombuffer(SMALL.encode([t.encode()])[0], "<u4").tolist() == W.encode(t, add_special_tokens=False).ids


def test_other_files_are_encoded_whole_or_refused():
    enc = token_files.WordEncoder(bpe.default_path())
    assert token_files.WordEncoder(token_files.default_path()).apart and not enc.apart
    text = "a  b\n\n  Hello WORLD"
    assert np.frombuffer(enc.encode([text.encode()])[0], "<u4").tolist() == Tokenizer.from_file(bpe.default_path()).encode(text, add_special_tokens=False).ids
    with pytest.raises(ValueError):
        bpe.Vocabulary(token_files.default_path())


def docs(spark):
    texts = {9: "hello world", 3: None, 5: "", 7: "x" * 30_000 + " y", 4: "Hello, HELLO\n\nagain", 2: "a b c", 1: "a b c"}
    rows = [(i, t, 0, "c") for i, t in texts.items()]
    return texts, spark.createDataFrame(rows, "doc_id long, text string, part int, ids string").repartition(3)


def test_files_round_trip(spark, tmp_path):
    texts, df = docs(spark)
    at = str(tmp_path / "ids")
    token_files.write_tokens(df, at)
    got = {r.doc_id: r for r in token_files.read_digests(spark, at).collect()}
    start = 0
    for i in sorted(texts):
        ids = W.encode(texts[i] or "", add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    files = sorted((tmp_path / "ids").glob("part-*.parquet"))
    order = [r["doc_id"] for f in files for r in spark.read.parquet(str(f)).select("doc_id").collect()]
    assert order == sorted(texts)
    assert [r.ids for r in token_files.read_tokens(spark, at, 2, 2).collect()] == [W.encode("a b c").ids + [2]]
    plan = token_files.read_tokens(spark, at, 2, 2).select("n_tokens")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,2)" in plan and "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan
    import pyarrow.parquet as pq

    column = pq.ParquetFile(files[0]).metadata.row_group(0).column(4)
    assert "RLE_DICTIONARY" in column.encodings and column.path_in_schema.startswith("ids.")
    assert "DELTA_BINARY_PACKED" in pq.ParquetFile(files[0]).metadata.row_group(0).column(0).encodings


def test_files_of_nothing_and_null_ids(spark, tmp_path):
    _, df = docs(spark)
    token_files.write_tokens(df.limit(0), str(tmp_path / "none"))
    assert token_files.read_digests(spark, str(tmp_path / "none")).count() == 0
    twins = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string")
    token_files.write_tokens(twins, str(tmp_path / "twins"))
    got = token_files.read_digests(spark, str(tmp_path / "twins")).collect()
    assert sorted((r.doc_id is not None, r.start) for r in got) == [(False, 0), (True, 2), (True, 4)]


# --- counts ---


LIBRARY = Tokenizer.from_file(bpe.default_path())


def brute(text, rule):
    """Sections' token counts by the library's tokens: each character of one is a byte."""
    sizes = [len(LIBRARY.id_to_token(i)) for i in LIBRARY.encode(text, add_special_tokens=False).ids]
    lines = text.encode().split(b"\n")
    spans, at = [], 0
    for k, line in enumerate(lines):
        end = at + len(line) + (k < len(lines) - 1)
        if end > at or len(lines) == 1:
            spans.append((at, end))
        at = end
    n, p = [0] * len(spans), 0
    for size in sizes:
        q = p + size
        share = [max(0, min(q, b) - max(p, a)) for a, b in spans]
        hit = [k for k, s in enumerate(share) if s]
        n[share.index(max(share)) if rule == "majority" else hit[0] if rule == "first" else hit[-1]] += 1
        p = q
    return n


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_lines_equal_brute_force(spark, rule):
    texts = ["", "one line", "a\nb", "a\n\n\n\nb  \n\n c\n", "\n", "é中\n\n\n  é\n", "x\n" * 3000, None, "a.\r\n\r\n\r\nb"]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, section int")
    got = token_counts.count_lines(df, rule=rule).collect()
    for i, t in enumerate(texts):
        rows = sorted((r for r in got if r.doc_id == i), key=lambda r: r.section)
        assert [r.n_tokens for r in rows] == brute(t or "", rule), (t, rule)
        assert rows[0].char_start == 0 and rows[-1].char_end == len(t or "")
        assert all(a.char_end == b.char_start for a, b in zip(rows, rows[1:], strict=False))
    assert token_counts.count_lines(df.limit(0)).count() == 0


def test_fields_add_up_to_the_document(spark):
    df = spark.createDataFrame([(1, "title é", None, "body\n\n"), (None, "", "x", "y")], "doc_id long, title string, note string, body string")
    got = token_counts.count_fields(df, ["title", "note", "body"]).collect()
    t = Tokenizer.from_file(bpe.default_path())
    for i, text in ((1, "title é\n\nbody\n\n"), (None, "\nx\ny")):
        rows = [r for r in got if r.doc_id == i]
        assert len(rows) == 3 and sum(r.n_tokens for r in rows) == len(t.encode(text).ids)
        assert max(r.char_end for r in rows) == len(text)
    with pytest.raises(ValueError):
        token_counts.attribute(np.array([1]), np.array([1]), "none")
