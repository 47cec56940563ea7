"""Variants against a plain count and a comparison of all pairs."""

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from trackguard.llm import spelling as S, words as W
from trackguard.llm.queries import QUERIES
from trackguard.session import stored

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[k + 1:] == b[k + 1:] if len(a) == len(b) else len(b) == len(a) + 1 and a[k:] == b[k + 1:])


def counted(rows, least=6, every=199):
    out = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % every == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1:]
            if len(word) >= least:
                out[word] += 1
    return out


def expected(rows, least=6, often=5, times=5, every=199):
    n = {w: k for w, k in counted(rows, least, every).items() if k >= often}
    beside = {w: set() for w in n}
    for w in n:                                 # neighbours by deletion: enough for a small vocabulary
        for k in range(len(w) + 1):
            for c in ["", *{x for v in n for x in v}]:
                for v in (w[:k] + c + w[k + 1:], w[:k] + c + w[k:]):
                    if v in n and v != w:
                        beside[w].add(v)
    form = {}
    for w, near in beside.items():
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(beside[w]), n.get(form[w])))
    return sorted(out)


def result(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def near_of(spark, words, **more):
    table = stored(spark.createDataFrame([(w, k) for w, k in words.items()], "word string, n long"))
    return {r.word: (r.n_near, r.best_n, r.best) for r in S.near_words(table, **more).collect()}


def near_by_hand(words):
    out = {}
    for w in words:
        near = sorted((-words[v], v) for v in words if one_edit(w, v))
        if near:
            out[w] = (len(near), -near[0][0], near[0][1])
    return out


WORD = st.text(alphabet="abé", min_size=6, max_size=9)


@given(st.dictionaries(WORD, st.integers(1, 4), min_size=1, max_size=120))
@settings(max_examples=60, deadline=None)
def test_both_lists_report_every_pair_once(words):
    found = Counter()
    for side in (0, 1):
        keys = sorted(w if side == 0 else w[::-1] for w in words)
        own = S.SortedList(keys, W.np.ones(len(keys), int), side)
        query, place = own.neighbours(keys, 6)
        found.update((keys[q][::1 - 2 * side], keys[p][::1 - 2 * side]) for q, p in zip(query.tolist(), place.tolist()))
    assert found == Counter((a, b) for a in words for b in words if one_edit(a, b))


@pytest.mark.parametrize("shard", [7, 40, 100_000])
def test_shards_of_any_size(spark, shard):
    rng = random.Random(shard)
    words = {"prefix" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 7))): rng.randint(1, 9) for _ in range(300)}      # one hot beginning
    words |= {"".join(rng.choice("xyzü") for _ in range(rng.randint(6, 8))): rng.randint(1, 9) for _ in range(300)}
    words["y" * 3000] = words["y" * 2999] = 3
    assert near_of(spark, words, shard=shard) == near_by_hand(words)


def test_shared_beginnings_that_rule_a_shard_out():
    for shared, word in [("abc", "abcd"), ("abc", "abd"), ("abc", "acd"), ("abc", "aabc"), ("abcd", "abc"), ("abcdef", "abcxyz"), ("ab", "ba"), ("xbc", "abcd")]:
        some = any(a == b or one_edit(a, b) for a in [shared] for b in (word[:k] for k in range(len(word) + 1)))
        assert S._within_one(shared, word) == some, (shared, word)


def test_checksums_side_by_side():
    data = W.np.frombuffer(("".join(chr(97 + k % 26) for k in range(3000))).encode(), W.np.uint8)
    start = W.np.array([0, 5, 7, 100, 200, 2999])
    end = W.np.array([5, 5, 60, 101, 2990, 3000])
    before = W.np.array([zlib.crc32(f"{i}:".encode()) for i in range(6)], W.np.uint32)
    got = S.crcs(data, start, end, before).tolist()
    assert got == [zlib.crc32(f"{i}:".encode() + data[a:b].tobytes()) for i, (a, b) in enumerate(zip(start.tolist(), end.tolist()))]


def awkward(rng):
    base = ["Schlüssel", "schlüssel", "schlussel", "COLOUR", "colours", "colour", "colouré", "naïveté", "naivete", "wordwords", "wordword", "abcdef", "abcdefg", "abcdeg"]
    rows = [(i, " ".join(rng.choices(base, weights=[2 ** (len(base) - k) for k in range(len(base))], k=200)) + "×÷ß tail") for i in range(120)]
    return rows + [(7, rows[7][1])] * 2 + [(None, "colour abcdef"), (None, "colour"), (500, None), (501, ""), (502, "12 -- Ωmega日本colour")]


@pytest.mark.parametrize("every", [199, 3])
def test_documents(spark, every):
    rows = awkward(random.Random(every))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n long")
    assert result(S.variants(docs, every=every)) == expected(rows, every=every)


def test_long_text_and_chain_of_forms(spark):
    chain = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb"]
    text = " ".join(w for k, w in enumerate(chain) for _ in range(5 ** (k + 1) + 200_000 * (k == 3))) + " " + "z" * 100_000
    got = {r[0]: r for r in result(S.variants(spark.createDataFrame([(1, text)], "doc_id long, text string"), every=10 ** 9))}
    assert [got[w][2] for w in chain] == ["aaabbb"] * 4 and got["aaaaaa"][1] == "aaaaab"


def test_empty(spark):
    assert S.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert S.variants(spark.createDataFrame([(1, "once only here")], "doc_id long, text string")).collect() == []


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(QUERIES["op11_spelling"](spark, sf)) == expected(rows)
