"""The trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from trackguard.llm import prefix_trie as T, sides
from trackguard.llm.queries import QUERIES
from trackguard.session import stored

SCHEMA = "conv_id long, turn long, role string, text string"


def trie_of(paths):
    """Nodes of {conv: [(role, text), ...]}."""
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
        ends[tuple(paths[c])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node, own in members.items():
        if node:
            children[node[:-1]] += 1
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(own) - 1) * (len(node[-1][1]) if node else 0)
    return sorted((own[0], len(node), members[node[:-1]][0] if node else -1, len(own), children[node], leaves[node], saved[node], hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest())
                  for node, own in members.items())


def result(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def rebuilt(rows):
    """Shared beginnings of rows without equal turns."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    return out


def plain(spark, paths, **more):
    rows = [(c, k, r, t) for c, turns in paths.items() for k, (r, t) in enumerate(turns)]
    turns = stored(T.numbered(spark.createDataFrame(rows, SCHEMA)))
    return T.prefix_trie(turns, spark.createDataFrame([(c,) for c in paths], "conv long"), **more)


def shuffled_paths(rng, n, longest, letters="abc"):
    paths = {}
    for c in rng.sample(range(10 * n), n):
        base = paths[rng.choice(list(paths))] if paths and rng.random() < 0.7 else []
        keep = base[:rng.randint(0, len(base))]
        paths[c] = keep + [(rng.choice("ua"), rng.choice(letters) * rng.randint(0, 3)) for _ in range(rng.randint(0, longest - len(keep)))]
    return paths


@pytest.mark.parametrize("block,seed", [(1, 1), (2, 2), (4, 3), (4, 4), (64, 5)])
def test_random_tries(spark, block, seed):
    paths = shuffled_paths(random.Random(seed), 300, 11)
    assert result(plain(spark, paths, block=block)) == trie_of(paths)


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(sides, "LEAST_HOT", 3)
    monkeypatch.setattr(sides, "HOT_KEYS", 4)
    monkeypatch.setattr(T, "PACK", 5)
    paths = shuffled_paths(random.Random(9), 200, 9) | {c: [("u", "same"), ("a", "all")] for c in range(10_000, 10_150)}
    assert result(plain(spark, paths)) == trie_of(paths)


def test_long_conversations_and_texts(spark):
    long = [("u", f"turn {k}") for k in range(3 * T.CHUNK * T.BLOCK + 5)]
    paths = {5: long, 7: long[:-3], 3: long[:4000] + [("a", "other")], 9: [("u", "x" * 3_000_000)], 11: [("u", "x" * 2_999_999 + "é")]}
    assert result(plain(spark, {c: p for c, p in paths.items() if c > 8})) == trie_of({c: p for c, p in paths.items() if c > 8})
    got = {(r.conv_id, r.depth): r for r in plain(spark, {c: p for c, p in paths.items() if c < 8}).collect()}
    assert len(got) == len(long) + 2                        # all prefixes of the longest, the other answer, the root
    shared = sum(len(t) for _, t in long[:-3]) + sum(len(t) for _, t in long[:4000])
    assert got[3, 0].saved_tokens == got[3, 1].saved_tokens == shared
    assert got[5, len(long)].parent_conv_id == 5 and got[3, 4000].n_children == 2 and got[5, 4001].parent_conv_id == 3 and got[3, 0].n_leaves == 2


def test_shared_beginnings_nulls_and_clashing_columns(spark):
    rng = random.Random(2)
    rows = [(c, t if t else None, rng.choice(["user", None]), rng.choice(["a", "b", None, "é"])) for c in [*range(0, 250), 1234] for t in range(rng.randint(1, 8))]
    rows += [(None, 1, "user", "nobody's")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", depth int, h1 string")
    assert result(T.prefix_trie(*T.with_shared_beginnings(stored(T.numbered(df))))) == trie_of(rebuilt(rows))


def test_repeated_rows_are_turns(spark):
    rows = [(1, 1, "u", "a")] * 3 + [(2, None, "u", "a"), (2, None, "u", "a"), (2, 0, "u", "a"), (2, 5, "a", "b")]
    turns = stored(T.numbered(spark.createDataFrame(rows, SCHEMA)))
    got = T.prefix_trie(turns, turns.select("conv").distinct())
    assert result(got) == trie_of({1: [("u", "a")] * 3, 2: [("u", "a")] * 3 + [("a", "b")]})


def test_empty_and_turnless(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert result(T.prefix_trie(*T.with_shared_beginnings(stored(T.numbered(empty))))) == []
    assert result(plain(spark, {4: [], 2: []})) == trie_of({4: [], 2: []})


def test_query_equals_brute_force(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert result(QUERIES["op13_prefix_trie"](spark, sf)) == trie_of(rebuilt(rows))
