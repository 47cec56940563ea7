"""Searches against plain numpy."""

import numpy as np
import pytest

from trackguard.llm import topk as T

SCHEMA = "vec_id long, embedding array<double>, score string"


def plain(rows, asked, k):
    v = {}
    for i, e, _ in rows:
        if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e):
            v.setdefault(i, []).append([int(np.floor(1024 * x)) for x in e])
    out = []
    for q in asked:
        if q in v:
            a = min(v[q])
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i in v if i != q for b in v[i])[:k]
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


def run(spark, rows, k, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, T.search(df, df.filter("vec_id % 10 = 0"), k, **more).collect()))


@pytest.mark.parametrize("lead,head", [(1, 1), (4, 20), (64, 500)])
def test_equals_plain_search(spark, lead, head):
    rng = np.random.default_rng(lead)
    rows = [(i, (rng.normal(0, 1, 6) * rng.choice([0.1, 1, 5])).tolist(), "x") for i in range(200)]
    rows += [(200 + i, [1.0, 2.0, 0.5, 0.0, -1.0, 3.0], "copy") for i in range(40)]
    assert run(spark, rows, 10, lead=lead, head=head, block_bytes=400) == plain(rows, range(0, 240, 10), 10)


def test_odd_vectors(spark):
    rows = [(0, [1.0, -0.5], None), (10, None, None), (20, [1.0, None], None), (30, [float("nan"), 1.0], None), (40, [float("inf"), 0.0], None), (None, [1.0, 1.0], None),
            (50, [2.0], None), (1, [], None), (2, [0.5, 0.5, 9.0], None), (2, [0.5, 0.5, 9.0], None), (60, [-0.0001, 3e9], None)]
    assert run(spark, rows, 3) == plain(rows, [0, 50, 60], 3)


def test_fewer_than_k_and_none(spark):
    assert run(spark, [(0, [1.0], None)], 5) == [] and run(spark, [(0, [], None), (10, [], None)], 5) == [(0, 1, 10, 0), (10, 1, 0, 0)]
    assert run(spark, [(1, [1.0], None)], 5) == []
