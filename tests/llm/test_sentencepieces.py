"""Ids and texts against the library."""

import hashlib
import random
import struct

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from hypothesis import given, settings, strategies as st

from trackguard.llm import sentencepieces as S, words as W
from trackguard.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY, OWN = sentencepiece.SentencePieceProcessor(model_file=PATH), S.Codec(PATH)
AWKWARD = ["", " ", "  ", "     x", " " * 17, "a    b  ", "\n\n\t", "▁x ▁▁y", "日本語 テスト", "é É ẞ ﬁ ² ½", "👩‍👩‍👧 🎉", "<s></s><0x0A><unk> ⁇ ", "\x00a\x00", "aaaa" * 99, "abab" * 99,
           "12345 678", "=====-----=====", "﻿ a", "x" * 30_000]


def encoded(texts, codec=OWN):
    ids, count = codec.encode(W.texts_of(pa.array(texts, pa.string())))
    return [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])], [t.decode() for t in codec.decode(ids, count)]


def library(texts):
    ids = [LIBRARY.encode(t, add_bos=True, add_eos=True) for t in texts]
    return ids, [LIBRARY.decode(i) for i in ids]


def test_awkward_texts():
    assert encoded(AWKWARD) == library(AWKWARD)


@given(st.lists(st.text(max_size=40) | st.text(alphabet=st.sampled_from(" ▁abcdetin\n0_-=é日"), max_size=60), max_size=6))
@settings(max_examples=200, deadline=None)
def test_any_text(texts):
    if texts:
        assert encoded(texts) == library(texts)


def test_words_that_repeat_pairs():
    rng = random.Random(3)
    texts = ["".join(rng.choice(["an", "na", "the", "tion", "s", "ss", "in", "ing", "re"]) for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    assert encoded(texts) == library(texts)


def test_a_merge_that_forestalls_a_later_place():
    """ab ranks first, but what it makes with c ranks higher still and takes the a of the second ab: one place at a time, then."""
    codec = S.Codec(PATH)
    names = ["a", "b", "c", "ab", "abc", "abca"]
    codec.size = len(names)
    codec._merges({p: i for i, p in enumerate(names)}, [0.0, 0.0, 0.0, -3.0, -1.0, -2.0])
    symbol = np.array([0, 1, 2, 0, 1, 2, 0, 1])                       # abcabcab
    made, _, _ = codec._merged(symbol, np.zeros(8, np.int64))
    assert [names[k] for k in made] == ["abca", "b", "c", "ab"]


def test_any_ids_decode_as_the_library_does():
    rng = random.Random(5)
    rows = [[rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randint(0, 12))] for _ in range(3000)]
    got = OWN.decode(np.array([i for r in rows for i in r]), np.array([len(r) for r in rows]))
    assert [t.decode() for t in got] == [LIBRARY.decode(r) for r in rows]


def test_bounded_memory_changes_nothing():
    small, texts = S.Codec(PATH, kept=2), ["one two three", "two three four", "one"]
    assert encoded(texts, small) == encoded(texts, small) == library(texts)


def test_a_text_beyond_one_piece():
    rng = random.Random(7)
    text = " ".join(rng.choice(["river", "stone", "naïve", "12", "—"]) for _ in range(500_000))
    assert len(text) > W.PIECE and encoded([text, "x"]) == library([text, "x"])


def test_nulls_clashing_names_and_repeats(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "A b", "y"), (2, "é ", "z"), (2, "é ", "z")], "doc_id long, text string, ids string")
    ids = S.encode(docs, PATH)
    assert sorted((r.doc_id or 0, r.ids) for r in ids.collect()) == [(0, library(["A b"])[0][0]), (1, [1, 2]), *[(2, library(["é "])[0][0])] * 2]
    assert sorted((r.doc_id or 0, r.text) for r in S.decode(ids, PATH).collect()) == [(0, "A b"), (1, ""), (2, "é "), (2, "é ")]
    assert S.encode(docs.limit(0), PATH).collect() == S.digests(docs.limit(0), PATH).collect() == []
    assert S.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).collect()[0].text == ""


def test_query_equals_the_library(spark, sf):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op12_sentencepieces"](spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        (ids,), (text,) = library([rows[r.doc_id]])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
