"""Detectors (E1-E13) on the adapter's grid. Its series last seconds, so the rules run with scaled
durations; the settings below are the ones the SQL spells out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackguard.operators import detectors as DE, scoring as SC
from trackguard.operators.fold import cooldown
from trackguard.operators.gates import race_gates
from trackguard.operators.params import DetectorParams, candidate_grid
from trackguard.plans import tables as T
from trackguard.plans.registry import query, with_tables
from trackguard.plans.sqlparts import NAIVE, PARTS, RULES, TICKS
from trackguard.sources import adapter as AD

SCALED = DetectorParams(stop_sustain_s=0.5, recover_s=0.5, spin_lat_m=6.0, spin_sustain_s=0.5, slowdown_sustain_s=0.5, dropout_s=0.25,
                        cooldown_s=5.0, grid_field_slow=0.7, grid_field_ratio=0.1, grid_hold_s=0.5, resume_min_susp_s=0.25,
                        resume_max_s=1.0, multi_window_s=1.0)
NAIVE_SET = {"kmh": 30.0, "sustain_s": 0.5, "hold_s": 0.5, "crawl_share": 0.7}
ALERT_GAP = 5.0


def naive(spark: SparkSession, sf: str) -> DataFrame:
    return DE.naive(T.fields(spark, sf), **NAIVE_SET)


@T.kept("rule_detections")
def car_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Detections of the car rules; without the heading, which the SQL leaves out."""
    return DE.car_fold(DE.car_events(T.features(spark, sf).drop("heading_err"), SCALED), SCALED)


@query("e1_race_gates", with_tables(PARTS, TICKS + ["gates"], "SELECT race, tick, suspended, grid FROM gates"))
def _(spark, sf):
    return race_gates(T.fields(spark, sf), SCALED).select("race", "tick", "suspended", "grid")


@query("e12_naive_detections", with_tables(PARTS, NAIVE, "SELECT race, id, t, drv, msector, printf('speed %.0f km/h < 30 km/h', speed) AS evidence FROM naive"))
def _(spark, sf):
    return naive(spark, sf).select("race", "id", "t", F.get("drivers", F.lit(0)).alias("drv"), "msector", "evidence")


@query("e12_alerts_by_sector", with_tables(PARTS, NAIVE + ["nalerts"], "SELECT race, msector, count(*) AS alerts FROM nalerts GROUP BY race, msector"))
def _(spark, sf):
    return SC.alerts(naive(spark, sf), gap=ALERT_GAP).groupBy("race", "msector").agg(F.count(F.lit(1)).alias("alerts"))


_E9 = """
WITH RECURSIVE ev AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t FROM events),
first AS (SELECT user_id, t, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM ev) q WHERE n = 1),
kept AS (
  SELECT user_id, t, event_id FROM first
  UNION ALL
  SELECT k.user_id, m.t, m.event_id
  FROM kept k, LATERAL (SELECT e.t, e.event_id FROM ev e WHERE e.user_id = k.user_id AND e.t >= k.t + 86400 ORDER BY e.t, e.event_id LIMIT 1) m)
SELECT user_id, event_id FROM kept
"""


@query("e9_cooldown", _E9)
def _(spark, sf):
    ev = AD.table(spark, sf, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return cooldown(ev, ["user_id"], 86400.0, on="t", tie=["event_id"], size=40 * 86400.0).select("user_id", "event_id")


@query("e2_stopped", with_tables(PARTS, RULES, "SELECT race, drv, tick, msector FROM latches WHERE f_stop"))
def _(spark, sf):
    return car_rows(spark, sf).filter("kind = 'STOPPED'").select("race", "drv", "tick", "msector")


@query("e6_dropout", with_tables(PARTS, RULES, """
    SELECT race, drv, tick, seen_sector AS msector,
           printf('no data for %.1f s, last seen at %.0f km/h', (tick - seen_tick) / 4.0 + 1, seen_speed) AS evidence
    FROM latches WHERE f_lost"""))
def _(spark, sf):
    return car_rows(spark, sf).filter("kind = 'DROPOUT'").select("race", "drv", "tick", "msector", "evidence")


@query("e4_e5_spin_and_slowdown", with_tables(PARTS, RULES + ["spincands", "spinpicks"], """
    SELECT l.race, l.drv, l.tick, l.msector,
           round(CASE WHEN l.c_spin THEN 0.4 + 0.2 * (abs(l.lat_off) < 8)::INT + 0.2 * (l.rel_ratio < 0.3)::INT
                      ELSE 0.4 + 0.3 * (1 - l.lap_ratio) END, 2) AS severity
    FROM spinpicks p JOIN latches l USING (race, drv, tick)""", recursive=True))
def _(spark, sf):
    return car_rows(spark, sf).filter("kind = 'SPIN'").select("race", "drv", "tick", "msector", "severity")


_E3 = """act AS (SELECT race, drv, tick, rel_ratio, lap_ratio, msector FROM latches WHERE act),
voids AS (SELECT race, drv, tick FROM latches WHERE pit OR suspended),
drops AS (SELECT l.race, l.drv, l.tick, -l.dspeed_1s AS fell, -l.dspeed_1s >= 180 AS hard FROM latches l
    WHERE l.act AND (-l.dspeed_1s >= 180 OR (-l.dspeed_1s >= 80 AND (l.rel_ratio < 0.4 OR NOT EXISTS (
        SELECT 1 FROM latches b WHERE b.race = l.race AND b.drv = l.drv AND b.act AND b.brake AND b.tick BETWEEN l.tick - 4 AND l.tick))))),
settled AS (SELECT d.*, a.tick AS att, a.rel_ratio AS ratio, a.msector, coalesce(a.rel_ratio < CASE WHEN d.hard THEN 0.85 ELSE 0.6 END, false)
        AND (a.lap_ratio IS NULL OR a.lap_ratio < 0.6) AS still, v.tick AS vd
    FROM drops d ASOF LEFT JOIN act a ON a.race = d.race AND a.drv = d.drv AND a.tick >= d.tick + 2
    ASOF LEFT JOIN voids v ON v.race = d.race AND v.drv = d.drv AND v.tick > d.tick),
trig AS (SELECT *, CASE WHEN coalesce(vd < coalesce(att, 1000000), false) THEN vd - 1 ELSE coalesce(att, 1000000) END AS free,
         still AND att IS NOT NULL AND NOT coalesce(vd < att, false) AS sure FROM settled),
chain AS (
    SELECT race, drv, tick, free, sure AS emit, CASE WHEN sure THEN att END AS last, att, fell, ratio, msector
    FROM (SELECT *, row_number() OVER (PARTITION BY race, drv ORDER BY tick) AS n FROM trig) q WHERE n = 1
    UNION ALL
    SELECT c.race, c.drv, m.tick, m.free, m.sure AND (c.last IS NULL OR m.att - c.last >= 20),
           CASE WHEN m.sure AND (c.last IS NULL OR m.att - c.last >= 20) THEN m.att ELSE c.last END, m.att, m.fell, m.ratio, m.msector
    FROM chain c, LATERAL (SELECT * FROM trig x WHERE x.race = c.race AND x.drv = c.drv AND x.tick > c.free ORDER BY x.tick LIMIT 1) m)
SELECT race, drv, att AS tick, msector, round(least(1.0, 0.5 + least(fell, 250) / 500 + CASE WHEN ratio < 0.3 THEN 0.2 ELSE 0 END), 2) AS severity FROM chain WHERE emit"""


@query("e3_impact", with_tables(PARTS, RULES, "", recursive=True) + ", " + _E3)
def _(spark, sf):
    return car_rows(spark, sf).filter("kind = 'IMPACT'").select("race", "drv", "tick", "msector", "severity")


_E11 = _E3[:_E3.rindex("SELECT race, drv, att AS tick")] + """SELECT race, drv, tick, 'STOPPED' AS kind, msector FROM latches WHERE f_stop
UNION ALL SELECT race, drv, tick, 'DROPOUT', seen_sector FROM latches WHERE f_lost
UNION ALL SELECT race, drv, tick, 'SPIN', msector FROM latches JOIN spinpicks USING (race, drv, tick)
UNION ALL SELECT race, drv, att, 'IMPACT', msector FROM chain WHERE emit"""


@query("e11_car_detections", with_tables(PARTS, RULES + ["spincands", "spinpicks"], "", recursive=True) + ", " + _E11)
def _(spark, sf):
    return car_rows(spark, sf).select("race", "drv", "tick", "kind", "msector")


@query("e8_multi_car")
def _(spark, sf):
    return DE.multi_car(car_rows(spark, sf), SCALED, AD.SECTORS).select(
        "race", "tick", F.array_join("drivers", ",").alias("drivers"), "msector", "severity", "evidence")


@query("e11_detector_suite")
def _(spark, sf):
    dets = DE.detect(T.features(spark, sf), T.SCALED, AD.SECTORS)
    return dets.select("race", "id", "t", F.array_join("drivers", ",").alias("drivers"), "msector", "type", "severity", "evidence")


@query("e13_candidate_settings")
def _(spark, sf):
    """Saved overrides of the settings, and the suite once per setting of the short list."""
    saved = SCALED.with_saved({"cooldown_s": 2.0, "not_a_setting": 1})
    dets = DE.detect(T.features(spark, sf).drop("heading_err"), saved, AD.SECTORS, settings=candidate_grid())
    return dets.groupBy("cand", "race", "type").agg(F.count(F.lit(1)).alias("detections"))
