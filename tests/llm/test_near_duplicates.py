"""Groups of near duplicates against a search of all pairs, sketches against the similarity they estimate."""

import random
import re

import numpy as np
import pyarrow as pa

from trackguard.llm import components as C, hyperminhash as H, near_duplicates as N, words as W
from trackguard.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def groups(rows, n, percent=80):
    """Smallest reachable row per row number, over all pairs."""
    sets, parent = [shingles(t, n) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(rows))], sets


def family(rng, n, edits):
    """A text and copies of it with more and more words replaced: some reach the text only through others."""
    base = [f"w{rng.randrange(400)}" for _ in range(80)]
    out = [" ".join(base)]
    for _ in range(n):
        words = out[-1].split() if rng.random() < 0.5 else list(base)
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_groups_equal_a_search_of_all_pairs(spark):
    rng = random.Random(3)
    texts = [t for k in range(4) for t in family(rng, 30, 3 + k)] + ["one two three", "One two  three", "one two", "", "a b c d e", "x"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows.sort()
    want, sets = groups(rows, 5)
    docs = spark.createDataFrame([(t, i, "q") for i, t in rows] + [(None, 900, "q"), (texts[0], None, "q")], "text string, doc_id long, node string")
    for block in (N.BLOCK, 8):          # with small blocks buckets are dealt in pairs of blocks
        got = {r.doc_id: r for r in N.duplicates(docs, block=block).collect()}
        assert [got[i].component_id for i, _ in rows] == want and [got[i].n_shingles for i, _ in rows] == list(map(len, sets))
        assert all(got[i].kept == (i == want[i]) for i, _ in rows)
        assert (got[900].n_shingles, got[900].component_id, got[900].kept) == (0, 900, True)
        assert (got[None].component_id, got[None].kept) == (None, True)


def test_one_row_of_each_group_stays(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, long), (3, long + " end"), (3, long + " end"), (8, "other words here and there"), (3, "quite another text with the same id"), (None, long), (1, None)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, kept string")
    got = sorted(((r.doc_id, r.text) for r in N.first_of_each(docs).collect()), key=str)
    assert got == sorted([(3, long + " end"), (8, rows[3][1]), (3, rows[4][1]), (None, long), (1, None)], key=str)
    assert N.first_of_each(docs).columns == docs.columns and N.duplicates(docs.limit(0)).collect() == []


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    for size in (6, 60, 3000):
        for share in (0.2, 0.5, 0.8):
            n = round(size * 2 * share / (1 + share))
            est = []
            for _ in range(40):
                v = rng.integers(0, 1 << 63, 2 * size - n, dtype=np.uint64)
                a, b = np.sort(v[:size]), np.sort(v[size - n:])
                regs = H.registers(np.concatenate([a, b]), np.array([0, size, 2 * size]))
                est.append(H.corrected(regs[:1], regs[1:], np.array([size]), np.array([size]))[0])
            assert abs(np.mean(est) - n / (2 * size - n)) < 0.06


def test_registers_hold_zeros_and_the_bits_behind():
    v = np.array([1, 2, 3, (1 << 57) - 1, 1 << 56, 0b1011 << 40], np.uint64)
    zeros, rest = H._compressed(v) >> 10, H._compressed(v) & 1023
    assert zeros.tolist() == [56, 55, 55, 0, 0, 13] and rest.tolist() == [0, 0, 512, 1023, 0, 0b0110000000]


def test_shingles_of_short_and_repeated_texts():
    value, bounds = H.shingles(W.texts_of(pa.array(["a b c d", "a b", "", "x x x x x x x", "A B C D"])), 4)
    assert np.diff(bounds).tolist() == [1, 1, 0, 1, 1] and value[bounds[0]] == value[bounds[4]]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (100, 102), (102, 100), (7, 7)]
    got = {tuple(r) for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in (100, 101, 102)}


def test_query_equals_a_search_of_all_pairs(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want, sets = groups(rows, 4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op9_near_duplicates"](spark, sf).collect()}
    assert got == {i: (len(sets[k]), rows[want[k]][0], want[k] == k) for k, (i, _) in enumerate(rows)}


def test_pairs_of_small_sets_do_not_need_their_estimate():
    regs = np.zeros((3, H.BUCKETS), np.uint16)
    regs[1, H.ROWS:], regs[2, H.ROWS:] = 1, 2           # one band in common and nothing else
    for n, want in ((5, [(0, 1), (0, 2), (1, 2)]), (N.SMALL, [])):
        unit = pa.table({"regs": [r.tobytes() for r in regs], "n_shingles": [n] * 3, "own": [0] * 3, "number": [0] * 3,
                         "component": [b"a", b"b", b"c"], "i": [0] * 3, "j": [0] * 3})
        assert sorted(N._pairs_of(unit, 0.5, 80)) == want


def test_repeated_rows_and_near_copies_under_one_id(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(3, long), (3, long + " end"), (7, long), (9, "five words stand right here"), (9, "five words stand right here"), (None, long), (None, long),
            (4, None), (4, None), (6, "  "), (6, "  ")]
    got = sorted(((r.doc_id, r.text) for r in N.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    group = [r for r in got if r[0] in (3, 7)]
    assert len(group) == 1 and group[0] in rows[:2]
    assert sorted([r for r in got if r not in group], key=str) == sorted(rows[4:], key=str)
