"""Boosted trees against a plain version that tries every cut, and contributions against all subsets."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackguard.operators import boosting as B, folds as FO, risk as RI
from trackguard.session import stored


def data(seed, n=300, inputs=4, missing=0.15):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, inputs)), 1)
    x[rng.random(x.shape) < missing] = np.nan
    y = (np.nan_to_num(x[:, 0], nan=1.5) + np.nan_to_num(x[:, 1]) * np.nan_to_num(x[:, 2]) + 0.5 * rng.normal(size=n) > 0.8).astype(float)
    return x, y


def plain_tree(x, g, h, growth):
    """Leaf-wise growth by trying every cut between neighbouring values, with missing values on either side."""
    def worth(rows):
        return g[rows].sum() ** 2 / (h[rows].sum() + growth.l2)

    def best(rows):
        found = (0.0,)
        for side in (False, True):
            for j in range(x.shape[1]):
                values = np.unique(x[~np.isnan(x[:, j]), j])
                for cut in [*(values[:-1] + values[1:]) / 2, np.inf]:
                    left = np.where(np.isnan(x[rows, j]), side, x[rows, j] <= cut)
                    a, b = rows[left], rows[~left]
                    if min(len(a), len(b)) >= growth.min_rows:
                        gain = worth(a) + worth(b) - worth(rows)
                        if gain > found[0] + 1e-9:
                            found = (gain, a, b)
        return found
    leaves = [np.arange(len(x))]
    splits = [best(leaves[0])]
    while len(leaves) < growth.leaves and max(s[0] for s in splits) > 1e-9:
        k = int(np.argmax([s[0] for s in splits]))
        _, a, b = splits.pop(k)
        leaves.pop(k)
        leaves += [a, b]
        splits += [best(a), best(b)]
    value = np.zeros(len(x))
    for rows in leaves:
        value[rows] = -growth.step * g[rows].sum() / (h[rows].sum() + growth.l2)
    return value


@pytest.mark.parametrize("seed", range(4))
def test_trees_equal_a_plain_version(seed):
    x, y = data(seed)
    growth = B.Growth(rounds=6, step=0.3, leaves=6, min_rows=15, row_share=1.1, column_share=1.0)
    score = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(growth.rounds):
        p = 1 / (1 + np.exp(-score))
        score = score + plain_tree(x, p - y, p * (1 - p), growth)
    assert np.abs(B.margin(x, B.boost(x, y, growth)) - score).max() < 1e-5


def test_leaves_rows_and_missing_inputs():
    x, y = data(9, n=2000)
    trees = B.boost(x, y, B.Growth(rounds=20, leaves=8, min_rows=50, row_share=1.1))
    for tree in trees.each():
        ends = tree[tree["feature"] < 0]
        assert len(ends) <= 8 and ends["cover"].min() >= 50 and ends["cover"].sum() == 2000
    assert len(np.unique(trees.nodes["missing_left"][trees.nodes["feature"] >= 0])) == 2      # both sides are learnt
    again = B.Trees.unpacked(trees.packed())
    assert (B.margin(x, again) == B.margin(x, trees)).all()
    p = B.probability(B.margin(x, trees))
    assert p[y == 1].mean() > p[y == 0].mean() + 0.2


def test_nothing_to_learn():
    flat = B.boost(np.full((30, 2), np.nan), np.zeros(30), B.Growth(rounds=3))
    assert len(flat.nodes) == 0 and (B.probability(B.margin(np.zeros((2, 2)), flat)) < 1e-5).all()
    assert B.contributions(np.zeros((2, 2)), flat).tolist() == [[0, 0], [0, 0]]


def expected_margin(row, trees, known):
    """Known inputs decide; at others both sides count by their training rows."""
    def value(tree, at):
        f = tree["feature"][at]
        if f < 0:
            return tree["value"][at]
        sides = tree["left"][at], tree["right"][at]
        if f in known:
            left = tree["missing_left"][at] if np.isnan(row[f]) else row[f] <= tree["cut"][at]
            return value(tree, sides[0] if left else sides[1])
        return sum(value(tree, s) * tree["cover"][s] for s in sides) / tree["cover"][at]
    return sum(value(t, 0) for t in trees.each())


def test_contributions_equal_all_subsets():
    x, y = data(3, inputs=5)
    trees = B.boost(x, y, B.Growth(rounds=8, step=0.3, leaves=9, min_rows=10))
    got = B.contributions(x[:20], trees)
    for row, own in zip(x[:20], got):
        for j in range(5):
            others = [k for k in range(5) if k != j]
            want = sum(factorial(n) * factorial(4 - n) / factorial(5) * (expected_margin(row, trees, {*s, j}) - expected_margin(row, trees, set(s))) for n in range(5) for s in combinations(others, n))
            assert abs(own[j] - want) < 1e-9
    missing = expected_margin(x[0], trees, set())
    assert np.abs(got.sum(1) - (B.margin(x[:20], trees) - trees.base - missing)).max() < 1e-9


def labelled(spark):
    rows = spark.range(1200).select(
        F.concat(F.lit("R"), (F.col("id") % 3).cast("string")).alias("race"), (F.col("id") % 7).cast("string").alias("drv"), F.col("id").cast("int").alias("tick"),
        (F.rand(1) * 300).alias("speed"), F.when(F.rand(3) < 0.5, F.rand(2)).alias("lap_ratio"), F.rand(6).alias("anomaly_score"), F.lit("1").alias("track_status"), F.rand(5).alias("_u"))
    risky = (F.col("speed") < 60) & (F.col("_u") < 0.7)
    rows = rows.withColumns({"y30": risky.cast("int"), "y10": (F.col("speed") < 30).cast("int"), "y20": (F.col("speed") < 45).cast("int")})
    return stored(rows.withColumn("train_keep", (F.col("y30") == 1) | (F.col("tick") % 4 == 0)))


def test_all_folds_in_one_job_equal_models_fitted_alone(spark, monkeypatch):
    monkeypatch.setattr(FO, "PART_ROWS", 150)
    rows = labelled(spark)
    got = {(r.race, r.tick): r for r in RI.cross_validate(rows, (10, 30), iterations=6, min_rows=10).collect()}
    assert len(got) == 1200
    for race in ("R0", "R2"):
        others, test = rows.filter(F.col("race") != race), rows.filter(F.col("race") == race)
        for name, h, feats in (("p10", 10, RI.ACTIVE), ("p30", 30, RI.ACTIVE), ("p30_noanom", 30, RI.WITHOUT_ANOMALY)):
            alone = RI.predict(test, RI.fit(others, h, feats, iterations=6, min_rows=10), "p", feats)
            assert all(abs(r["p"] - got[race, r["tick"]][name]) < 1e-12 for r in alone.collect())


def test_models_do_not_depend_on_how_rows_are_dealt_out(spark):
    rows = labelled(spark)
    a, b = (RI.fit(r, 30, iterations=4, min_rows=10).trees for r in (rows.repartition(1), rows.repartition(7, "speed")))
    assert a.nodes.tolist() == b.nodes.tolist()


def test_a_model_draws_a_bounded_number_of_rows(spark):
    rows = labelled(spark)
    assert B.sampled(rows, 1200, RI.KEY, most=2000).count() == 1200
    assert 200 < B.sampled(rows, 1200, RI.KEY, most=300).count() < 400


@pytest.mark.parametrize("size", [3, 14])
def test_patterns_are_numbered_in_order(size):
    pattern = np.random.default_rng(size).integers(0, 1 << size, 200)
    shapes, which = B._numbered(pattern, size)
    assert shapes.tolist() == sorted(set(pattern.tolist())) and (shapes[which] == pattern).all()


def test_horizons_fitted_side_by_side_are_those_fitted_alone(spark):
    x, y = data(4, n=400)
    rows = [("R", "1", k, float(a), float(b), int(v), int(v and k % 2), True) for k, ((a, b, *_), v) in enumerate(zip(x, y))]
    train = spark.createDataFrame(rows, "race string, drv string, tick int, speed double, throttle double, y30 int, y10 int, train_keep boolean")
    train = train.withColumn("track_status", F.lit("1"))
    both = RI.fit_horizons(train, (10, 30), ["speed", "throttle"], 4, 5)
    for model, h in zip(both, (10, 30)):
        alone = RI.fit(train, h, ["speed", "throttle"], 4, 5)
        assert len(model.trees.nodes) and (model.trees.nodes == alone.trees.nodes).all() and model.neg_share == alone.neg_share
    assert len(both[0].trees.nodes) != len(both[1].trees.nodes) or (both[0].trees.nodes != both[1].trees.nodes).any()
