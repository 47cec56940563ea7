"""Anomaly score and risk forecast (M operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackguard.functions.stats import average_precision, exact_quantiles, exact_quantiles_of
from trackguard.operators import anomaly as AN, risk as RI
from trackguard.functions.ring import risk_level
from trackguard.plans import tables as T
from trackguard.plans.registry import query, with_tables
from trackguard.plans.sqlparts import FEATURES, INC, NAIVE, PARTS, TICKS
from trackguard.session import stored
from trackguard.sources import adapter as AD

N = AD.SECTORS
MIN_ROWS = 10         # of a leaf: the test tables have few positive rows


def sql(names: list[str], body: str) -> str:
    return with_tables(PARTS, names, body)


# ---- anomaly

_NORMAL = """normal AS (SELECT * FROM features WHERE track_status = '1' AND NOT in_pit AND NOT suspended AND field_slow < 0.5 AND speed > 60
    AND rel_ratio IS NOT NULL AND rel_ratio_min_2s IS NOT NULL AND lap_ratio IS NOT NULL AND lap_ratio_min_2s IS NOT NULL AND dspeed_1s IS NOT NULL
    AND dspeed_min_2s IS NOT NULL AND lat_abs_max_2s IS NOT NULL AND lat_off_std_2s IS NOT NULL AND throttle_std_2s IS NOT NULL AND brake_throttle_2s IS NOT NULL)"""


@T.kept("normal")
def normal(spark, sf):
    """Normal rows; the field of the test data crawls more, so the limit on it is relaxed."""
    return AN.normal_rows(T.features(spark, sf), crawl=0.5)


@query("m1_normal_rows", sql(FEATURES, "") + f", {_NORMAL} SELECT race, drv, tick FROM normal")
def _(spark, sf):
    return normal(spark, sf).select("race", "drv", "tick")


@query("m2_rows_per_tree", sql(FEATURES, "") + f""", {_NORMAL} SELECT CAST(t.tree AS INT) AS tree, (SELECT least(count(*), {AN.ROWS_PER_TREE}) FROM normal) AS rows_kept
    FROM (SELECT unnest(range({AN.TREES})) AS tree) t""")
def _(spark, sf):
    """Every tree draws its rows from all normal rows."""
    rows = normal(spark, sf)
    return AN.tree_rows(rows, rows.count(), AN.TREES, AN.ROWS_PER_TREE, 0).groupBy("tree").agg(F.count(F.lit(1)).alias("rows_kept"))


_MED = [c for c in AN.FEATURES if c != "heading_err"]        # the test data has no headings


@query("m3_medians", sql(FEATURES, "") + f", {_NORMAL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(median({c}) + 1e-9, 6) AS median FROM normal""" for c in _MED))
def _(spark, sf):
    s = normal(spark, sf)
    rows = [(c, v[0]) for c, v in exact_quantiles_of(s, _MED, [0.5]).items()]
    return spark.createDataFrame(rows, "column string, median double").withColumn("median", F.round(F.col("median") + 1e-9, 6))


def forest(spark, sf):
    return AN.train(normal(spark, sf))


@query("m4_m5_anomaly_score")
def _(spark, sf):
    df = AN.attach_scores(T.features(spark, sf), forest(spark, sf))
    return df.select("race", "drv", "tick", F.round("anomaly_score", 6).alias("anomaly_score"))


@query("m6_score_quantiles", "SELECT q::DOUBLE AS q, round(v + 1e-9, 6) AS v FROM (SELECT unnest([0.5, 0.9, 0.999, 0.9995]) AS q, unnest(quantile_cont(l_extendedprice, [0.5, 0.9, 0.999, 0.9995])) AS v FROM lineitem) k")
def _(spark, sf):
    qs = [0.5, 0.9, 0.999, 0.9995]
    found = exact_quantiles(AD.table(spark, sf, "lineitem"), "l_extendedprice", qs)
    return spark.createDataFrame(list(zip(qs, found)), "q double, v double").select("q", F.round(F.col("v") + 1e-9, 6).alias("v"))


@T.kept("scored")
def scored(spark, sf):
    """Every race scored by a forest of the other races."""
    return AN.leave_one_race_out(T.features(spark, sf), 0.5)


@query("m7_leave_one_race_out")
def _(spark, sf):
    return scored(spark, sf).groupBy("race").agg(F.count("anomaly_score").alias("rows_scored"), F.round(F.avg("anomaly_score"), 4).alias("mean_score"))


@query("e7_anomaly_detections")
def _(spark, sf):
    from trackguard.operators import detectors as DE
    limit = exact_quantiles(scored(spark, sf), "anomaly_score", [0.9])[0]
    dets = DE.detect(scored(spark, sf), T.SCALED, N, anomaly_threshold=limit)
    return dets.filter("type = 'ANOMALY'").select("race", "t", F.get("drivers", F.lit(0)).alias("drv"), "msector", "severity")


# ---- labels

_RACING = """racing AS (SELECT * FROM fieldrows WHERE speed IS NOT NULL AND NOT in_pit AND NOT suspended AND field_slow < 0.5)"""
_LABELS = f"""hits AS (SELECT n.race, n.drv, n.t, i.incident FROM gapinc i JOIN gapsec s USING (race, incident)
    JOIN naive n ON n.race = i.race AND n.msector = s.msector AND n.t BETWEEN i.t - 1 AND i.t + 0.25),
alone AS (SELECT * FROM gapinc i WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.race = i.race AND h.incident = i.incident)),
firstinc AS (SELECT race, drv, min(t) AS t_inc FROM hits GROUP BY ALL), {_RACING},
labelled AS (SELECT r.race, r.drv, r.tick, r.t, r.speed, f.t_inc, coalesce(r.t >= f.t_inc - 1, false)::INT AS y1, coalesce(r.t >= f.t_inc - 3, false)::INT AS y30
    FROM racing r LEFT JOIN firstinc f USING (race, drv) WHERE (f.t_inc IS NULL OR r.t < f.t_inc)
    AND NOT EXISTS (SELECT 1 FROM alone a JOIN gapsec s USING (race, incident) WHERE a.race = r.race AND s.msector = r.msector AND r.t BETWEEN a.t - 0.5 AND a.t))"""
_LABEL_TABLES = NAIVE + INC


def with_labels(spark, sf, rows):
    """Labels from the baseline's detections; a horizon of 3 s plays the 30 s one."""
    first, alone = RI.incident_times(T.gap_incidents(spark, sf), T.naive(spark, sf), N, 1.0, 0.25)
    rows = RI.label(rows, first, alone, N, (1, 2, 3), ambiguous_s=0.5)
    return RI.train_keep(rows.withColumnsRenamed({"y3": "y30", "y2": "y20"}).withColumn("y10", F.col("y1")))


@T.kept("labels")
def labels(spark, sf):
    """Labels, time and speed of the racing rows, without the inputs of a model."""
    return with_labels(spark, sf, T.paces(spark, sf)).select("race", "drv", "tick", "t", "speed", "y1", "y10", "y20", "y30", "train_keep")


@T.kept("labelled")
def labelled(spark, sf):
    """Racing rows with their labels and all features."""
    return with_labels(spark, sf, T.features(spark, sf))


@query("m8_incident_times", sql(_LABEL_TABLES, "") + f", {_LABELS} SELECT race, drv, t_inc FROM firstinc")
def _(spark, sf):
    return RI.incident_times(T.gap_incidents(spark, sf), T.naive(spark, sf), N, 1.0, 0.25)[0]


@query("m8_unattributed", sql(_LABEL_TABLES, "") + f", {_LABELS} SELECT race, incident FROM alone")
def _(spark, sf):
    return RI.incident_times(T.gap_incidents(spark, sf), T.naive(spark, sf), N, 1.0, 0.25)[1].select("race", "incident")


@query("m9_m10_labels", sql(_LABEL_TABLES, "") + f", {_LABELS} SELECT race, drv, tick, y1, y30 FROM labelled")
def _(spark, sf):
    return labels(spark, sf).select("race", "drv", "tick", "y1", "y30")


@query("m11_racing_rows", sql(TICKS, "") + f", {_RACING} SELECT race, drv, tick FROM racing")
def _(spark, sf):
    df = T.paces(spark, sf)
    return df.filter(RI.is_racing(df)).select("race", "drv", "tick")


@query("m12_feature_matrix", sql(["grid", "laps"], """
    SELECT g.race, g.drv, g.tick, round(g.speed, 4) AS speed, round(g.throttle, 4) AS throttle, CAST(g.track_status AS DOUBLE) AS status_code,
           coalesce(CASE l.compound WHEN 'SOFT' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HARD' THEN 2 END, -1)::DOUBLE AS compound_code
    FROM grid g ASOF LEFT JOIN laps l ON l.race = g.race AND l.drv = g.drv AND l.t_start <= g.t"""))
def _(spark, sf):
    m = RI.feature_matrix(T.features(spark, sf))
    return m.select("race", "drv", "tick", F.round("speed", 4).alias("speed"), F.round("throttle", 4).alias("throttle"), "status_code", "compound_code")


@query("m13_train_keep", sql(_LABEL_TABLES, "") + f""", {_LABELS} SELECT race, drv, tick,
    y30 = 1 OR CAST('0x' || substr(md5(race || '|' || drv || '|' || CAST(tick AS VARCHAR)), 1, 7) AS BIGINT) % 1000 < 30 AS train_keep FROM labelled""")
def _(spark, sf):
    return labels(spark, sf).select("race", "drv", "tick", "train_keep")


# ---- model

@T.kept("predicted")
def predicted(spark, sf):
    """Cross-validated predictions, with and without the anomaly score."""
    rows = labelled(spark, sf).join(scored(spark, sf).select("race", "drv", "tick", "anomaly_score"), ["race", "drv", "tick"])
    return RI.cross_validate(stored(rows), RI.HORIZONS, min_rows=MIN_ROWS)


@query("m14_m15_m19_cross_validation")
def _(spark, sf):
    p = predicted(spark, sf)
    return p.groupBy("race").agg(F.count(F.lit(1)).alias("rows_scored"), *[F.round(F.avg(c), 6).alias(c) for c in ("p10", "p20", "p30", "p10_noanom", "p20_noanom", "p30_noanom")])


@query("m16_odds_correction", """SELECT l_orderkey, l_linenumber, round(l_discount / (1 - l_discount) * 0.03 / (1 + l_discount / (1 - l_discount) * 0.03) + 1e-9, 8) AS p FROM lineitem""")
def _(spark, sf):
    return AD.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(RI.correct(F.col("l_discount"), RI.NEG_PER_MILLE / 1000) + 1e-9, 8).alias("p"))


def one_model(spark, sf, h=30):
    return RI.fit(labelled(spark, sf), h, min_rows=MIN_ROWS)


@query("m17_m18_forecast")
def _(spark, sf):
    m10, m30 = RI.fit_horizons(labelled(spark, sf), (10, 30), min_rows=MIN_ROWS)
    return RI.forecast(T.features(spark, sf), m10, m30).withColumn("top_features", F.array_join("top_features", ","))


@query("m17_due_rows", sql(TICKS, "") + f", {_RACING} SELECT race, drv, tick FROM racing WHERE tick % 4 = 0")
def _(spark, sf):
    df = T.paces(spark, sf)
    return df.filter(RI.is_racing(df) & (F.col("tick") % 4 == 0)).select("race", "drv", "tick")


@query("m27_importance")
def _(spark, sf):
    return RI.importance(one_model(spark, sf), labelled(spark, sf))


# ---- how good it is

_AP = """ap AS (SELECT grp, y, s FROM (SELECT lang AS grp, quality AS y, n_chars AS s FROM labels JOIN documents USING (doc_id)) q),
each AS (SELECT grp, s, count(*) AS n, sum(y) AS p FROM ap GROUP BY grp, s),
cum AS (SELECT *, sum(n) OVER w AS cn, sum(p) OVER w AS cp, sum(p) OVER (PARTITION BY grp) AS tp FROM each WINDOW w AS (PARTITION BY grp ORDER BY s DESC))"""


def graded(spark, sf):
    return AD.table(spark, sf, "labels").join(AD.table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")


@query("m20_average_precision", "WITH " + _AP.replace("lang AS grp", "1 AS grp") + " SELECT round(sum(p / tp * cp / cn) + 1e-9, 6) AS pr_auc FROM cum")
def _(spark, sf):
    return average_precision(graded(spark, sf), "quality", "n_chars").select(F.round(F.col("pr_auc") + 1e-9, 6).alias("pr_auc"))


@query("m21_average_precision_per_group", "WITH " + _AP + " SELECT grp AS lang, round(sum(p / tp * cp / cn) + 1e-9, 6) AS pr_auc FROM cum GROUP BY grp")
def _(spark, sf):
    return average_precision(graded(spark, sf), "quality", "n_chars", ["lang"]).select("lang", F.round(F.col("pr_auc") + 1e-9, 6).alias("pr_auc"))


_PREC = f"""{_LABELS}, ends AS (SELECT race, drv, max(t) + 0.25 AS t_end FROM labelled WHERE y30 = 1 GROUP BY ALL),
pred AS (SELECT l.*, e.t_end, NOT coalesce(l.t >= e.t_end - 3 AND l.t < e.t_end, false) AS precursor FROM labelled l LEFT JOIN ends e USING (race, drv))"""


@query("m22_precursor_mask", sql(_LABEL_TABLES, "") + f", {_PREC} SELECT race, drv, tick, t_end, precursor FROM pred")
def _(spark, sf):
    return RI.with_incident_end(labels(spark, sf)).select("race", "drv", "tick", "t_end", "precursor")


_LIMITS = [40.0, 80.0, 120.0]


@query("m23_m24_m26_early_warning", sql(_LABEL_TABLES, "") + f""", {_PREC}, lim AS (SELECT unnest([40.0, 80.0, 120.0])::DOUBLE AS threshold),
cars AS (SELECT threshold, race, drv, min(CASE WHEN speed >= threshold AND t <= t_end - 3 THEN t END) AS t1, any_value(t_end) AS t_end FROM pred, lim WHERE y30 = 1 GROUP BY ALL),
seen AS (SELECT threshold, count(*) AS car_incidents, avg((t1 IS NOT NULL)::INT::DOUBLE) AS share, median(t_end - t1) AS med FROM cars GROUP BY ALL),
eps AS (SELECT threshold, sum(new) AS n FROM (SELECT threshold, CASE WHEN t - lag(t) OVER (PARTITION BY threshold, race, drv ORDER BY t) <= 5 THEN 0 ELSE 1 END AS new
        FROM pred, lim WHERE y30 = 0 AND speed >= threshold) q GROUP BY threshold),
hrs AS (SELECT sum(n) / 4.0 / 3600 / avg(c) AS hours FROM (SELECT race, count(*) AS n, count(DISTINCT drv) AS c FROM labelled GROUP BY race) q)
SELECT s.threshold, s.car_incidents, round(s.share, 6) AS flagged_3s_before, round(s.med, 6) AS median_s_before, coalesce(e.n, 0)::BIGINT AS false_episodes,
       round(coalesce(e.n, 0) / h.hours, 4) AS false_episodes_per_hour FROM seen s LEFT JOIN eps e USING (threshold), hrs h""")
def _(spark, sf):
    e = RI.early_warning(labels(spark, sf), _LIMITS, "speed")
    return e.select("threshold", "car_incidents", F.round("flagged_3s_before", 6).alias("flagged_3s_before"), F.round("median_s_before", 6).alias("median_s_before"),
                    "false_episodes", F.round("false_episodes_per_hour", 4).alias("false_episodes_per_hour"))


@query("m25_thresholds", sql(_LABEL_TABLES, "") + f""", {_LABELS} SELECT unnest([0.005, 0.002, 0.001])::DOUBLE AS rate,
    round(unnest(quantile_cont(speed, [0.995, 0.998, 0.999])) + 1e-9, 6) AS threshold FROM labelled WHERE y30 = 0""")
def _(spark, sf):
    found = RI.thresholds(labels(spark, sf), "speed")
    return spark.createDataFrame(list(zip([0.005, 0.002, 0.001], found)), "rate double, threshold double").withColumn("threshold", F.round(F.col("threshold") + 1e-9, 6))


def _apsql(where: str) -> str:
    return f"""(SELECT sum(p / tp * cp / cn) FROM (SELECT *, sum(n) OVER w AS cn, sum(p) OVER w AS cp, sum(p) OVER () AS tp
        FROM (SELECT speed, count(*) AS n, sum(y30) AS p FROM pred WHERE {where} GROUP BY speed) e WINDOW w AS (ORDER BY speed)) c)"""


@query("m28_baseline_scores", sql(_LABEL_TABLES, "") + f""", {_PREC} SELECT 'speed_threshold' AS model, round({_apsql('true')} + 1e-9, 6) AS pr_auc,
    round((SELECT avg(y30) FROM pred) + 1e-9, 6) AS base_rate, round({_apsql('precursor')} + 1e-9, 6) AS pr_auc_precursor""")
def _(spark, sf):
    t = RI.score_table(labels(spark, sf), {"speed_threshold": -F.col("speed")}, "y30")
    return t.select("model", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("pr_auc", "base_rate", "pr_auc_precursor")])


@query("m28_model_scores")
def _(spark, sf):
    t = RI.score_table(predicted(spark, sf), {"model": F.col("p30"), "without_anomaly": F.col("p30_noanom"), "anomaly_score": F.col("anomaly_score"),
                                              "speed_threshold": -F.col("speed")}, "y30")
    return t.select("model", *[F.round(c, 6).alias(c) for c in ("pr_auc", "base_rate", "pr_auc_precursor", "pr_auc_mean_per_race")])


@query("m29_risk_level", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.027 THEN 'high' WHEN l_discount >= 0.009 THEN 'elevated' ELSE 'low' END AS level FROM lineitem")
def _(spark, sf):
    return AD.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", risk_level("l_discount").alias("level"))
