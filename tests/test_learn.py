"""Labels, anomaly score, forecast and their measures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackguard.functions.stats import average_precision, exact_quantile_per, exact_quantiles_of
from trackguard.operators import anomaly as AN, risk as RI, scoring as SC
from trackguard.sources import readers as RE


def rows_of_two_cars(spark):
    rows = [("R", d, k, k / 4, 200.0, False, False, 0.0, s) for d, s in (("1", 5), ("2", 12)) for k in range(160)]
    return spark.createDataFrame(rows, "race string, drv string, tick int, t double, speed double, in_pit boolean, suspended boolean, field_slow double, msector int")


def test_labels_before_the_incident_and_nothing_after(spark):
    first = spark.createDataFrame([("R", "1", 35.0)], "race string, drv string, t_inc double")
    none = spark.createDataFrame([], "race string, t double, sectors array<int>")
    got = RI.label(rows_of_two_cars(spark), first, none, 20).collect()
    one = {r["t"]: r for r in got if r["drv"] == "1"}
    assert max(one) == 34.75 and one[25.0]["y10"] == 1 and one[24.75]["y10"] == 0 and one[5.0]["y30"] == 1 and one[4.75]["y30"] == 0
    assert all(r["y30"] == 0 for r in got if r["drv"] == "2") and sum(r["drv"] == "2" for r in got) == 160


def test_rows_an_unattributed_incident_may_be_about_are_dropped(spark):
    first = spark.createDataFrame([], "race string, drv string, t_inc double")
    alone = spark.createDataFrame([("R", 35.0, [5])], "race string, t double, sectors array<int>")
    got = RI.label(rows_of_two_cars(spark), first, alone, 20).collect()
    kept = {r["t"] for r in got if r["drv"] == "1"}
    assert 4.75 in kept and 5.0 not in kept and 35.0 not in kept and 35.25 in kept
    assert sum(r["drv"] == "2" for r in got) == 160


def test_odds_correction_is_monotone(spark):
    p = [r["c"] for r in spark.range(1, 100).select(RI.correct(F.col("id") / 100.0, 0.03).alias("c")).orderBy("id").collect()]
    assert p == sorted(p) and abs(p[49] - 0.03 / 1.03) < 1e-12


def test_average_precision_takes_ties_together(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "y int, s double")
    r = average_precision(df, "y", "s").first()
    assert abs(r["pr_auc"] - (0.5 * 0.5 + 0.5 * 2 / 3)) < 1e-12 and r["base_rate"] == 0.5


def normal(spark):
    cols = AN.FEATURES
    df = spark.range(3000).select(F.lit("R").alias("race"), F.lit("1").alias("drv"), F.col("id").cast("int").alias("tick"),
                                  *[F.randn(i).alias(c) for i, c in enumerate(cols)])
    return df


def test_outliers_score_higher(spark):
    forest = AN.train(normal(spark), trees=40, per_tree=256)
    odd = spark.createDataFrame([("R", "1", 1, *[0.0] * 11), ("R", "1", 2, *[9.0] * 11), ("R", "1", 3, *[None] * 11)],
                                "race string, drv string, tick int, " + ", ".join(f"{c} double" for c in AN.FEATURES))
    s = {r["tick"]: r["anomaly_score"] for r in AN.attach_scores(odd, forest).collect()}
    assert 0 < s[1] < 0.5 < s[2] < 1 and s[3] < 0.5
    assert forest.quantiles[0.999] <= forest.quantiles[0.99999] < s[2]
    assert forest.feature.shape[0] == 40


def test_trees_draw_from_all_rows(spark):
    df = spark.range(4000).select(F.concat(F.lit("R"), (F.col("id") % 2).cast("string")).alias("race"), F.lit("1").alias("drv"), F.col("id").cast("int").alias("tick"),
                                  F.lit("1").alias("track_status"), F.lit(False).alias("in_pit"), F.lit(False).alias("suspended"), F.lit(0.0).alias("field_slow"),
                                  F.lit(200.0).alias("speed"), *[F.lit(1.0).alias(c) for c in AN.FEATURES])
    rows = AN.normal_rows(df)
    assert rows.count() == 4000
    for trees, per_tree in ((3, 200), (40, 500), (2, 9000)):        # one draw a row, a draw for each tree, and fewer rows than asked
        a, b = (AN.tree_rows(rows, 4000, trees, per_tree, 1) for _ in range(2))
        assert [r["count"] for r in a.groupBy("tree").count().collect()] == [min(per_tree, 4000)] * trees
        assert a.exceptAll(b).isEmpty() and a.select("race").distinct().count() == 2


def test_trees_part_neighbouring_doubles():
    x = np.array([[1.0], [np.nextafter(1.0, 2.0)]])
    for seed in range(20):
        nodes = AN.grow_tree(x, seed, 3)
        assert sorted(n[0] for n in nodes) == [0, 1, 2] and nodes[0][2] == 1.0


def test_forecast_finds_the_signal(spark):
    rows = spark.range(2000).select(
        F.lit("R").alias("race"), F.lit("1").alias("drv"), (F.col("id") * 4).cast("int").alias("tick"), F.col("id").cast("double").alias("t"),
        (F.rand(1) * 300).alias("speed"), F.rand(2).alias("throttle"), F.lit("1").alias("track_status"), F.lit(False).alias("in_pit"),
        F.lit(False).alias("suspended"), F.lit(0.0).alias("field_slow")).withColumns({
            "y30": (F.col("speed") < 60).cast("int"), "y10": (F.col("speed") < 30).cast("int"), "train_keep": F.lit(True)})
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    m30, m10 = (RI.fit(rows, h, iterations=5, min_rows=5) for h in (30, 10))
    imp = RI.importance(m30, rows).collect()
    assert imp[0]["feature"] == "speed" and abs(sum(r["gain"] for r in imp) - 1) < 1e-9
    got = RI.forecast(rows, m10, m30).collect()
    assert len(got) == 2000 and all(0 <= r["risk_10s"] <= r["risk_30s"] <= 1 for r in got)
    by = {r["tick"]: r for r in got}
    high = [by[r["tick"]] for r in rows.filter("speed < 50").collect()]
    low = [by[r["tick"]] for r in rows.filter("speed > 80").collect()]
    assert min(r["risk_30s"] for r in high) > max(r["risk_30s"] for r in low)
    assert all(r["top_features"][:1] == ["speed"] for r in high)


def test_prediction_keeps_the_rows_and_the_base_rate(spark):
    """Whether or not negatives were left out in training, the mean prediction is near the share of positives."""
    rows = spark.range(6000).select(
        F.lit("R").alias("race"), F.lit("1").alias("drv"), F.col("id").cast("int").alias("tick"), (F.rand(1) * 300).alias("speed"),
        F.when(F.rand(3) < 0.5, F.rand(2)).alias("lap_ratio"), F.lit("1").alias("track_status"), F.rand(5).alias("_u"))
    rows = rows.withColumn("y30", ((F.col("speed") < 60) & (F.col("_u") < 0.7)).cast("int"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    base = rows.agg(F.avg("y30")).first()[0]
    for keep in (F.lit(True), (F.col("y30") == 1) | (F.col("tick") % 10 == 0)):
        given = rows.withColumn("train_keep", keep)
        model = RI.fit(given, 30, iterations=60, min_rows=20)
        out = RI.predict(given, model, "p")
        assert abs(out.agg(F.avg("p")).first()[0] - base) < 0.25 * base
        assert out.drop("p").exceptAll(given).isEmpty() and out.count() == 6000


def test_columns_without_values_have_no_quantiles(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    assert exact_quantiles_of(df, ["a", "b"], [0.5]) == {"a": [2.0], "b": [None]}
    assert exact_quantiles_of(df.limit(0), ["a"], [0.1, 0.9]) == {"a": [None, None]}


def test_average_precision_of_crowded_scores(spark):
    """Most scores lie close to zero, one far out: the result is that of the plain sum."""
    rows = [(int(k % 7 == 0), 1e-9 * k) for k in range(3000)] + [(1, 1e6), (0, 0.5)]
    got = average_precision(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()
    seen = hits = total = 0
    for y, _ in sorted(rows, key=lambda r: -r[1]):
        seen, hits = seen + 1, hits + y
        total += y * hits / seen
    assert abs(got["pr_auc"] - total / sum(y for y, _ in rows)) < 1e-9


def test_holdout_races_are_not_learnt(spark):
    held = normal(spark).withColumn("race", F.lit(RE.HOLDOUT_IDS[0]))
    with pytest.raises(RE.HoldoutError):
        AN.train(held, trees=2, per_tree=16)
    with pytest.raises(RE.HoldoutError):
        RI.fit(held.withColumns({"y30": F.lit(0), "train_keep": F.lit(True)}), 30, iterations=1)
    with pytest.raises(RE.HoldoutError):
        SC.leave_one_out(held.select("race", F.lit("own").alias("system"), F.lit(0).alias("cand"), F.lit(1).alias("matched"), F.lit(0).alias("false_alarms"), F.lit(1.0).alias("hours")), [3.0])


def two_level_scores(spark):
    return spark.range(6000).select((F.col("id") % 3).cast("string").alias("k"), F.when(F.col("id") % 3 == 2, F.lit(0.5)).otherwise(F.rand(4) * F.pow(F.lit(10.0), -(F.col("id") % 3 * 6))).alias("v"))


def test_quantiles_of_every_key(spark):
    import numpy as np
    df = spark.createDataFrame(two_level_scores(spark).collect(), "k string, v double")
    for q in (0.0, 0.37, 0.9999, 1.0):
        got = exact_quantile_per(df, "k", "v", q)
        for k in "012":
            assert abs(got[k] - np.quantile([r.v for r in df.filter(F.col("k") == k).collect()], q)) < 1e-15
    assert exact_quantile_per(df.limit(0), "k", "v", 0.5) == {}


def test_every_race_is_scored_by_the_forest_of_the_others(spark, monkeypatch):
    from trackguard.operators import folds
    from trackguard.session import stored
    monkeypatch.setattr(folds, "PART_ROWS", 700)
    rows = normal(spark).withColumn("race", F.concat(F.lit("R"), (F.col("tick") % 3).cast("string"))).withColumns(
        {"track_status": F.lit("1"), "in_pit": F.lit(False), "suspended": F.lit(False), "field_slow": F.lit(0.0), "speed": F.lit(200.0)})
    rows = rows.withColumns({c: F.when(F.col("race") == "R2", F.lit(9.0)).otherwise(F.col(c)) for c in AN.FEATURES})             # one race is strange to the others
    rows = stored(rows.withColumn(AN.FEATURES[1], F.when(F.col("tick") == 7, F.lit(None).cast("double")).otherwise(F.col(AN.FEATURES[1]))))
    got = AN.leave_one_race_out(rows, trees=30, per_tree=128, q=0.99)
    mean = {r.race: r.m for r in got.groupBy("race").agg(F.avg("anomaly_score").alias("m")).collect()}
    assert mean["R2"] > max(mean["R0"], mean["R1"]) + 0.02 and got.count() == 3000 and got.filter("anomaly_score is null").isEmpty()
    limit = {r.race: r.threshold for r in got.select("race", "threshold").distinct().collect()}
    assert len(limit) == 3 and limit["R2"] < got.filter("race = 'R2'").agg(F.expr("median(anomaly_score)")).first()[0]
    assert got.drop("anomaly_score", "threshold").select(*rows.columns).exceptAll(AN.with_inputs(rows).select(*rows.columns)).isEmpty()


def many_rows(spark):
    """More labelled rows than a model once learnt from, in two races."""
    return spark.range(440_000).select(
        F.concat(F.lit("R"), (F.col("id") % 2).cast("string")).alias("race"), F.lit("1").alias("drv"), F.col("id").cast("int").alias("tick"),
        (F.col("id") * 7919 % 300).cast("double").alias("speed"), F.lit("1").alias("track_status"), F.lit(True).alias("train_keep"),
        (F.col("id") * 7919 % 300 < 60).cast("int").alias("y30"))


def test_models_learn_from_all_kept_rows(spark):
    """The first node of a tree covers the share of the rows that a tree sees, 80% of all and not of a draw."""
    model = RI.fit_horizons(many_rows(spark), (30,), ["speed"], 1, 100)[0]
    assert abs(model.trees.nodes[0]["cover"] / 440_000 - 0.8) < 0.01


def test_models_of_the_other_races_learn_from_all_kept_rows(spark):
    from trackguard.operators.boosting import Trees
    from trackguard.session import stored
    models = RI.fold_models(stored(many_rows(spark)), (30,), 1, 100, {"": ["speed"]}).collect()
    assert sorted(m.fold for m in models) == ["R0", "R1"]
    assert all(abs(Trees.unpacked(m.trees).nodes[0]["cover"] / 220_000 - 0.8) < 0.01 for m in models)
