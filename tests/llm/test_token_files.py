"""Simple-8b round trips, chunked encoding against the library, and files against a plain encoder."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from trackguard.llm import simple8b, token_files as K, words as W
from trackguard.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
AWKWARD = ["", " ", "a", "  two  blanks ", "a   b", "tab\t b", "line\n\n next\nline", "it's we'll  x", "x<|endoftext|> y", "　 z",
           "é è́ ñ", "12 345  \n 6", "end ", "\u0085 q", "日本 語", "mix\r\n text"]


@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 50000) | st.sampled_from([0, 1, 2**60, 2**60 - 1]), max_size=300))
@settings(max_examples=80, deadline=None)
def test_round_trip(values):
    v = np.array(values, np.uint64)
    assert simple8b.decode(simple8b.encode(v), len(v)).tolist() == values


def test_words_are_dense():
    assert len(simple8b.encode(np.full(120, 1))) == 2 and len(simple8b.encode(np.full(9, 50000))) == 3
    assert len(simple8b.encode(np.array([1 << 63]))) == 2


@given(st.lists(st.text(alphabet=st.sampled_from("ab 's\n\t  é1.<|>endoftx"), max_size=30), max_size=5))
@settings(max_examples=150, deadline=None)
def test_chunks_encode_as_whole_texts(texts):
    got, count = K.Encoder(PATH).encode(W.texts_of(pa.array(texts, pa.string())))
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert count.tolist() == list(map(len, want)) and got.tolist() == sum(want, [])


def plain(rows):
    """Rows by (id, nulls first), with the ids of the library."""
    t, start, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_hold_awkward_texts(spark):
    rows = [(7 * i % 31, t) for i, t in enumerate(AWKWARD)] + [(100, None), (None, "no id"), (101, "word " * 90_000)]
    docs = spark.createDataFrame([(t, d, "x") for d, t in rows], "text string, doc_id long, start string")
    index = K.write(docs, PATH)
    assert sorted(map(tuple, K.digests(index).collect()), key=lambda r: r[1]) == plain(rows)
    whole = {r.doc_id: r.ids for r in K.read(index).collect()}
    assert whole[100] == [2] and len(whole[101]) == plain(rows)[-1][2]


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(3, "same"), (3, "same"), (1, "x")], "doc_id long, text string")
    assert sorted(tuple(r) for r in K.digests(K.write(docs, PATH)).select("doc_id", "start").collect()) == [(1, 0), (3, 2), (3, 4)]
    assert K.digests(K.write(docs.limit(0), PATH)).collect() == []


def test_other_files_are_refused(tmp_path):
    (tmp_path / "x").write_bytes(b"z" * 64)
    with pytest.raises(ValueError):
        list(K._parts(str(tmp_path / "x")))


def test_query_equals_plain_encoding(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op4_token_files"](spark, sf).collect()), key=lambda r: r[1]) == plain(rows)


def test_words_go_to_the_library_together():
    rng = random.Random(4)
    texts = ["".join(rng.choice([" ", "\n", "\n\n", "-", "'s ", ""]) + rng.choice(["river", "Über", "naïve", "ªº", "x", "ſʰ", "日本", "été", "don't", "İstanbul"]) for _ in range(400)) for _ in range(30)]
    own, library = K.Encoder(PATH, kept=50), Tokenizer.from_file(PATH)
    for t in (texts, texts[::-1]):
        ids, count = own.encode(W.texts_of(pa.array(t, pa.string())))
        assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [e.ids for e in library.encode_batch(t, add_special_tokens=False)]
