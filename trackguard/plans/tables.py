"""Intermediate tables of the pipeline over the adapter's data, written once per session.

The stages of the real pipeline end in tables too (features, detections, recommendations); the
queries of later stages start from them instead of repeating the earlier stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from trackguard.functions.timeline import chunk_of, gap_islands
from trackguard.operators import detectors as DE, escalation as ES, exposure as EX, features as FE, flags as FL, incidents as IN, onset as ON
from trackguard.operators.params import DetectorParams
from trackguard.plans.pipeline import build_features, field_rows
from trackguard.session import stored
from trackguard.sources import adapter as AD

_KEPT: dict[tuple, DataFrame] = {}
N = AD.SECTORS

# The adapter's series last seconds and its speeds are noise, so durations and levels are scaled down.
SCALED = DetectorParams(stop_sustain_s=0.5, recover_s=0.5, spin_lat_m=9.5, spin_sustain_s=0.25, slowdown_sustain_s=0.5, dropout_s=0.25,
                        cooldown_s=5.0, grid_field_slow=0.7, grid_field_ratio=0.1, grid_hold_s=0.5, resume_min_susp_s=0.25,
                        resume_max_s=1.0, multi_window_s=1.0)
NAIVE_SET = {"kmh": 30.0, "sustain_s": 0.5, "hold_s": 0.5, "crawl_share": 0.7}
FLAG_SET = FL.FlagParams(sc_hold_s=0.25, vsc_hold_s=0.5, sector_clear_s=0.5, min_hold_s=0.5, track_hold_s=1.5, track_clear_s=0.5,
                         moving_kmh=400.0, follow_kmh=400.0, official_green_s=2.0, site_red_s=1.0, race_laps=4)
LAP_RULES = {"min_samples": 4, "min_coverage": 0.5, "max_gap": 300.0}
ONSET_SET = {"collapse": 0.6, "field_racing": 0.5, "sustain": 2}


def kept(name: str):
    """Builds a table at first use and keeps it for the session."""
    def wrap(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def get(spark: SparkSession, sf: str) -> DataFrame:
            key = (spark.sparkContext.applicationId, sf, name)
            if key not in _KEPT:
                _KEPT[key] = stored(fn(spark, sf))
            return _KEPT[key]
        return get
    return wrap


@kept("grid")
def grid(spark, sf):
    return AD.with_xy(AD.grid(spark, sf))


@kept("features")
def features(spark, sf):
    g = grid(spark, sf)
    df = build_features(g, AD.laps(g), AD.weather(g), AD.ring_reference(g), AD.LENGTH)
    return df.withColumn("lap", F.col("drv_lap"))


@kept("fields")
def fields(spark, sf):
    """Grid rows with gaps, own features and the state of the field."""
    return field_rows(grid(spark, sf).drop("x", "y"), AD.LENGTH)


@kept("paces")
def paces(spark, sf):
    """Grid rows with the state of the field and nothing else: all that the baseline detector, its scores, labels and stoppages ask of a row, without
    laps, weather, gaps and windows."""
    rows = FE.field_state(FE.per_row(grid(spark, sf)))
    return rows.select("race", "drv", "tick", "t", "x", "msector", "speed", "in_pit", "track_status", "suspended", "field_slow", "field_in_pit")


@kept("official")
def official(spark, sf):
    return AD.official(grid(spark, sf))


@kept("detections")
def detections(spark, sf):
    return DE.detect(features(spark, sf), SCALED, N)


@kept("naive")
def naive(spark, sf):
    return DE.naive(paces(spark, sf), **NAIVE_SET)


@kept("messages")
def incident_messages(spark, sf):
    """Official messages with their incident, by the official grouping."""
    return IN.build_incidents(official(spark, sf), paces(spark, sf), N, join_s=2.0)


@kept("incidents")
def incidents(spark, sf):
    return IN.incident_table(incident_messages(spark, sf))


@kept("gap_messages")
def gap_messages(spark, sf):
    """Official flags grouped by pauses of more than half a second: incidents that SQL can state too."""
    off = official(spark, sf).filter("flag <> 'CLEAR'")
    rows = gap_islands(off, ["race"], chunk_of("t", 1024.0), ["t", "event_id"], 0.5, "_isl")
    first = F.min("event_id").over(W.partitionBy("race", "_isl"))
    return rows.select("race", "t", "event_id", "flag", "msector", first.alias("incident"))


@kept("gap_incidents")
def gap_incidents(spark, sf):
    return IN.incident_table(gap_messages(spark, sf))


@kept("own")
def own(spark, sf):
    """Features with every car's own reference."""
    return ON.own_reference(features(spark, sf), AD.LENGTH, **LAP_RULES)


@kept("onsets")
def onsets(spark, sf):
    return ON.onsets(own(spark, sf), **ONSET_SET)


@kept("recs")
def recs(spark, sf):
    return FL.recommend(features(spark, sf), detections(spark, sf), FLAG_SET)


@kept("escalations")
def escalations(spark, sf):
    return ES.escalation_recs(recs(spark, sf))


@kept("crashes")
def crashes(spark, sf):
    cand = ON.candidates(incidents(spark, sf), onsets(spark, sf), N, before=5.0)
    return EX.group_crashes(cand, lookback=5.0)


@kept("marks")
def marks(spark, sf):
    return EX.crash_marks(own(spark, sf), incident_messages(spark, sf), crashes(spark, sf), detections(spark, sf), recs(spark, sf), N)


@kept("passes")
def passes(spark, sf):
    return EX.crossings(own(spark, sf), EX.pass_places(marks(spark, sf)), AD.LENGTH)
