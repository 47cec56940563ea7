"""Benchmark windows against plain search."""

import re

import pytest

from trackguard.llm import decontaminate as D
from trackguard.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEN = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
ITEMS = [(1, TEN + " lambda mu"), (20, "short item"), (3, TEN), (None, "nameless words"), (4, None), (5, " -- "), (20, "another part"), (6, "Äpfel ß"), (7, "solo")]
DOCS = [(1, "before ALPHA, beta gamma-delta epsilon zeta eta theta iota kappa lambda after"), (2, "alpha beta gamma"), (3, "a Short, item! x short item"),
        (4, None), (5, ""), (6, "äpfel ß Äpfel ß"), (7, "another  part and short item"), (8, "nameless words"), (9, "solo solo"), (9, "solo"), (None, TEN),
        (10, "Solos " + "word " * 5000 + TEN)]


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def plain(docs, items, n=10):
    windows = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            for k in range(max(len(w) - n, 0) + 1):
                windows.setdefault(tuple(w[k:k + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[tuple(w[k:k + size])]
        out.append((d, len(w), len(hit), len(found), D.digest(list(found)), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 30])
def test_scan_equals_plain_search(spark, block):
    docs = spark.createDataFrame([(t, i, "x") for i, t in DOCS], "text string, doc_id long, hit string").repartition(3)
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, n int")
    got = D.scan(docs, items, block_bytes=block).drop("items").collect()
    assert sorted(map(tuple, got), key=str) == plain(DOCS, ITEMS)
    assert D.scan(docs.limit(0), items).collect() == [] and not any(r.contaminated for r in D.scan(docs, items.limit(0)).collect())


def test_documents_or_spans_go(spark):
    docs = spark.createDataFrame([(1, "keep this", 5), (2, "Start. Short item, and on", 6), (3, None, 7)], "doc_id long, text string, hit int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted(map(tuple, D.remove(docs, items).collect())) == [(1, "keep this", 5), (3, None, 7)]
    assert sorted(map(tuple, D.remove(docs, items, mode="spans").collect())) == [(1, "keep this", 5), (2, "Start. , and on", 6), (3, None, 7)]
    with pytest.raises(ValueError):
        D.remove(docs, items, mode="all")


def test_a_hash_alone_is_no_hit(monkeypatch):
    import pyarrow as pa

    from trackguard.llm import words as W
    windows = D.Windows([("1", "one two")], 10)
    texts = W.texts_of(pa.array(["one two three four"]))
    found = W.words_of(texts, W.ALNUM, lower=True)
    found.hash[2:] = found.hash[:2]             # "three four" now hashes like the item
    marked, items = windows.hits(texts, found)
    assert marked.tolist() == [True, True, False, False] and items == [{"1"}]


def test_query_equals_plain_search(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op1_decontaminate"](spark, sf).collect()), key=str) == plain(docs, items)
