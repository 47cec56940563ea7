"""Targets against a plain water level, mixes against their targets."""

import random
from collections import Counter
from fractions import Fraction

from trackguard.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size string"


def plain_targets(sizes):
    """By repeated resharing, as the contract tells it."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, out = Fraction(3 * sum(sizes.values()), 2), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: Fraction(2 * sizes[s]) for s in over}
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def corpus(seed, sources, n):
    rng = random.Random(seed)
    return [(i, "w " * rng.choice([0, 1, 5, 20, 20, 60, 400]) or None, rng.choice(sources), "x") for i in range(n)]


def test_targets_and_taken_words(spark):
    for seed, sources in ((1, ["b", "a", "é", "Z", None]), (2, ["only"]), (3, ["s%02d" % k for k in range(12)] + ["s00"] * 12)):
        rows = corpus(seed, sources, 1500)
        got = M.mix_report(spark.createDataFrame(rows, SCHEMA)).collect()
        sizes, taken = Counter(), Counter()
        where = {i: s for i, _, s, _ in rows}
        for i, t, s, _ in rows:
            sizes[s] += len((t or "").split())
        want = plain_targets(sizes)
        for r in got:
            s = where[r.doc_id]
            assert r.source_size == sizes[s] and abs(r.target - float(want[s])) < 1e-6 * max(1, r.target) and 0 <= r.taken <= 2 * r.size
            taken[s] += r.taken
        assert all(abs(taken[s] - float(want[s])) <= 0.01 * float(want[s]) + 60 for s in sizes)


def test_mix_emits_what_the_report_takes(spark):
    docs = spark.createDataFrame(corpus(5, ["a", "b", None], 400), SCHEMA).repartition(5)
    times = Counter(r.doc_id for r in M.mix(docs).collect())
    report = M.mix_report(docs).collect()
    assert M.mix(docs).columns == docs.columns and sorted(map(tuple, report)) == sorted(map(tuple, M.mix_report(docs.repartition(2)).collect()))
    assert all(times[r.doc_id] * r.size == r.taken for r in report)


def test_odd_rows(spark):
    rows = [(None, "one two", "a", "x"), (1, None, "a", "x"), (1, "b b b", "a", "y"), (1, "b b b", "a", "y"), (2, "", "empty", "x")]
    got = M.mix_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5 and {(r.source_size, r.target) for r in got} == {(8, 12.0), (0, 0.0)}
    assert Counter(r.doc_id for r in M.mix(spark.createDataFrame(rows, SCHEMA)).collect())[2] == 1
    empty = spark.createDataFrame([], SCHEMA)
    assert M.mix_report(empty).collect() == [] and M.mix(empty).collect() == []


def test_the_plan_has_no_python(spark):
    plan = M.mix(spark.createDataFrame(corpus(7, ["a"], 20), SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
