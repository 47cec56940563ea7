"""Counts against the library, pre-token by pre-token and over whole tables."""

import public_tokenizers
from hypothesis import given, settings, strategies as st
import pyarrow as pa
from tokenizers import Tokenizer

from trackguard.llm import token_count as C, words as W
from trackguard.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY, OWN = Tokenizer.from_file(PATH), C.Counter(PATH)
AWKWARD = ["", " ", "aaaa aaaaa AAAAAA", "it's WE'LL 'S", "x<|endoftext|>y <|startoftext|><|endoftext|>", "é é É ẞ İ ς Σ ΟΔΟΣ", "１２ ½ ² ³7",
           "日本語 テスト 한글", "a b c\u0085d", "!!!??? ...--- $$$a$$$", "\x00\x01 tab\tline\nend", "<|endoftext|", "ﬁ Ⅷ ª º", "👩‍👩‍👧 🎉🎉", "a̴b̴", "x" * 5000]


def counts(texts):
    return OWN.count(W.texts_of(pa.array(texts, pa.string()))).tolist()


def library(texts):
    return [len(LIBRARY.encode(t, add_special_tokens=False).ids) for t in texts]


def test_awkward_texts():
    assert counts(AWKWARD) == library(AWKWARD)


@given(st.lists(st.text(max_size=40) | st.text(alphabet=st.sampled_from("abAB '’sStéÉß1٣<|>ndoftextσΣ\n　"), max_size=40), max_size=6))
@settings(max_examples=200, deadline=None)
def test_any_text(texts):
    assert counts(texts) == library(texts)


def test_bounded_memory_changes_nothing():
    small = C.Counter(PATH, kept=2)
    t = W.texts_of(pa.array(["one two three", "two three four", "one"], pa.string()))
    assert small.count(t).tolist() == small.count(t).tolist() == library(["one two three", "two three four", "one"])


def test_nulls_clashing_names_and_repeats(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "A b", "y"), (2, "a", "z"), (2, "a", "z"), (3, "é" * 3000 + " w" * 2100, "n")], "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, C.count_tokens(docs, PATH).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert got[:4] == [(None, 3, 2, False), (1, 0, 0, False), (2, 1, 1, False), (2, 1, 1, False)]
    assert got[4][2] == library(["é" * 3000 + " w" * 2100])[0] and got[4][3]
    assert C.count_tokens(docs.limit(0), PATH).collect() == []


def test_query_equals_the_library(spark, sf):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op7_token_count"](spark, sf).collect():
        n = len(LIBRARY.encode(rows[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((rows[r.doc_id] or "").encode()), n, n > 2048)
