import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkloom.llm import bpe

PATH = bpe.default_path()
V = bpe.Vocabulary(PATH)
T = Tokenizer.from_file(PATH)


def same(text, enc=None):
    enc = enc or bpe.Encoder(V)
    ids = enc.encode([text.encode()])[0]
    want = T.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want, (text, ids.tolist(), want)
    assert V.decode(ids).tobytes().decode("utf-8", "replace") == T.decode(want, skip_special_tokens=False)
    assert V.decimals(ids)[:-1].decode() == ",".join(map(str, want))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aAbeé1 \n\t  'st!$—中😀\x1c\x85<|>")) | st.characters(exclude_categories=["Cs", "Cn"]), max_size=40))
def test_equals_the_library(text):
    same(text)


@pytest.mark.parametrize("text", ["", " ", "\n\n\n a", "a\n\n b", "x<|endoftext|> y <|endoftext|>", "I'll don't 'S", "a" * 500, "ab" * 3000, "  lead", "trail  ", "x" * 63 + " " + "y" * 64, "naïve " * 50])
def test_cases(text):
    same(text)


def test_lexicon_finds_words_and_shares_suffixes(tmp_path):
    words = {f" {a}{b}".encode(): [i, i + 1] for i, (a, b) in enumerate((a, b) for a in ("walk", "talk", "st", "") for b in ("", "ing", "ed", "s"))}
    words.pop(b" ", None)
    path = tmp_path / "lex"
    path.write_bytes(bpe.compile_lexicon(words))
    lex = bpe.Lexicon(str(path))
    asked = [*words, b" wal", b" walkings", b"", b"talk", b" " + b"z" * 100]
    got = lex.lookup(asked)
    assert [None if g is None else np.frombuffer(g, '<u4').tolist() for g in got] == [words.get(w) for w in asked]
    assert lex.states < sum(len(w) for w in words) / 2
    (tmp_path / "none").write_bytes(bpe.compile_lexicon({}))
    assert bpe.Lexicon(str(tmp_path / "none")).lookup([b"a"]) == [None]


def test_small_caches_give_the_same_ids():
    rng = np.random.default_rng(1)
    texts = [" ".join("".join(rng.choice(list("abcdeé"), 5)) for _ in range(40)) for _ in range(30)]
    enc = bpe.Encoder(V, cache=50)
    for t in texts * 2:
        same(t, enc)


def test_query_on_edge_rows(spark, tmp_path):
    texts = ["hello world hello world", None, "", "a b", "x " * 50_000, "hello world hello world", "<|endoftext|>"]
    rows = [(i, t, "en", "s", 0, "extra") for i, t in enumerate(texts)] + [(None, "no id", "en", "s", 0, "extra")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, ids int, n_tokens string")
    got = {r.doc_id: r for r in bpe.encode_digests(df).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        want = T.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df)).collect()}
    assert back == {r[0]: r[1] or "" for r in rows}
    assert bpe.encode_digests(df.limit(0)).count() == 0
