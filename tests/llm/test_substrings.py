"""Repeated windows against plain counting; the index against plain search."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from trackguard.llm import sides, substrings as S, words as W
from trackguard.llm.fm_index import FMIndex
from trackguard.llm.queries import QUERIES


def plain(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    count = Counter(tuple(w[k:k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k:k + window])] > 1:
                gone[k:k + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def rows_with_passages():
    rng = random.Random(5)
    passage = [[f"p{k}x{rng.randrange(50)}" for k in range(n)] for n in (9, 10, 11, 40, 300)]
    rows = []
    for i in range(60):
        words = [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passage)
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(60, "again " * 500), (61, "ab ba " * 40), (62, None), (63, ""), (64, rows[3][1]), (64, rows[3][1]), (65, "short text"), (None, rows[5][1])]
    return rows


@pytest.mark.parametrize("hot,shard", [(S.HOT, S.SHARD_WORDS), (30, 100), (S.HOT, 50)])
def test_removes_what_repeats(spark, hot, shard):
    rows = rows_with_passages()
    docs = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, cut string").repartition(4)
    got = S.report(docs, window=10, hot=hot, shard_words=shard).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, 10)


def test_texts_are_cut(spark):
    shared = " ".join(f"s{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"first  {shared} end", 7), (2, f"{shared}", 8), (3, "left  as\nit is", 9), (4, None, 1)], "doc_id long, text string, key int")
    got = sorted(map(tuple, S.remove(docs, window=10).collect()))
    assert got == [(1, "first end", 7), (2, "", 8), (3, "left  as\nit is", 9), (4, None, 1)]
    assert S.report(docs.limit(0)).collect() == []


@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.integers(1, 3)), min_size=1, max_size=6), st.integers(1, 6))
@settings(max_examples=150, deadline=None)
def test_index_against_plain_search(weighted, cap):
    segments, weight = [s for s, _ in weighted], [n for _, n in weighted]
    values, bounds = np.array(sum(segments, []), np.uint64), np.concatenate([[0], np.cumsum([len(s) for s in segments])])
    index = FMIndex(values, bounds, cap, np.array(weight))
    times = Counter()
    for s, n in weighted:
        times.update({k: n * v for k, v in Counter(tuple(s[i:i + cap]) for i in range(len(s) - cap + 1)).items()})
    assert index.occurrences().tolist() == [times[tuple(s[i:i + cap])] if i + cap <= len(s) else 0 for s in segments for i in range(len(s))]
    patterns = np.array([[x, y] for x in range(5) for y in range(4)], np.uint64)
    assert index.count(patterns).tolist() == [sum(s[k:k + 2] == [int(x), int(y)] for s in segments for k in range(len(s) - 1)) for x, y in patterns]


def test_copies_and_common_passages_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(sides, "LEAST_HOT", 3)
    monkeypatch.setattr(sides, "HOT_KEYS", 20)
    rows = rows_with_passages() + [(i, "one text " * 20 + "that many rows have") for i in range(100, 140)]
    rows += [(i, f"w{i} a passage that very many of the documents have in common here end{i}") for i in range(200, 260)]
    docs = spark.createDataFrame([(t, i) for i, t in rows], "text string, doc_id long").repartition(8)
    assert sorted(map(tuple, S.report(docs, window=10).collect()), key=str) == plain(rows, 10)


def test_a_text_beyond_one_piece(spark):
    rng = random.Random(8)
    long = " ".join(rng.choice(["river", "stone", "naïve", "12", "—"]) + str(rng.randrange(400)) for _ in range(300_000))
    passage = long.split()[150_000:150_060]
    rows = [(1, long), (2, " ".join(passage)), (3, "x  " + " ".join(passage[5:50]))]
    docs = spark.createDataFrame([(t, i) for i, t in rows], "text string, doc_id long")
    assert len(long) > W.PIECE and sorted(map(tuple, S.report(docs).collect()), key=str) == plain(rows, 35)


def test_query_equals_plain_counting(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op10_substrings"](spark, sf).collect()), key=str) == plain(rows, 35)
