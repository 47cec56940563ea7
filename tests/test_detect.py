"""The detector suite on small scenes, and against the row-at-a-time rules."""

import math

import pytest
from pyspark.sql import functions as F

from trackguard.operators import detectors as DE, features as FE
from trackguard.operators.params import DetectorParams
from trackguard.plans import tables as T
from trackguard.plans.q_detect import SCALED
from trackguard.streaming.marks import CARRIED, mark

FIELD, PACE = ["5", "21", "30", "87", "99"], 240.0
SCHEMA = ("race string, drv string, tick int, t double, speed double, x double, y double, msector int, in_pit boolean, brake boolean, "
          "lat_off double, heading_err double, ref_speed double, track_status string, suspended boolean, field_slow double")


def lap_of(n_ticks=140, edit=None):
    """Five cars at an even pace in sector 7, one row per car and tick; `edit(row, seconds)` changes rows in place."""
    out = []
    for tick in range(n_ticks):
        for place, drv in enumerate(FIELD):
            row = dict(race="T1", drv=drv, tick=tick, t=tick / 4, speed=PACE, x=16.7 * tick + 80.0 * place, y=3.0, msector=7, in_pit=False, brake=False,
                       lat_off=-0.5, heading_err=2.0, ref_speed=PACE, track_status="1", suspended=False, field_slow=0.0)
            if edit:
                edit(row, tick / 4)
            out.append(tuple(row.values()))
    return out


def into_the_wall(drv, when, sector=7):
    """From pace to a crawl in one tick, at rest a second later."""
    def edit(row, s):
        if row["drv"] == drv and s >= when:
            row["speed"], row["msector"] = (45.0 if s < when + 1 else 0.0), sector
    return edit


def frame(spark, rows):
    """Adds the derived columns the detectors read."""
    df = spark.createDataFrame(rows, SCHEMA).withColumn("speed_ratio", F.col("speed") / F.col("ref_speed"))
    keep = df.select("race", "drv", "tick", F.col("suspended").alias("s"), F.col("field_slow").alias("fs"))
    df = FE.field_state(df.withColumns({"throttle": F.lit(100.0), "lat_off_abs": F.abs("lat_off"), "brake_throttle": F.lit(0.0)}).drop("suspended", "field_slow"))
    df = df.drop("suspended", "field_slow").join(keep, ["race", "drv", "tick"]).withColumnsRenamed({"s": "suspended", "fs": "field_slow"})
    df = df.withColumn("lap_ratio", F.least(F.col("speed") / PACE, F.lit(1.1)))
    kept = df.select("race", "drv", "tick", F.col("heading_err").alias("h"))
    return FE.windows(df.drop("heading_err")).join(kept, ["race", "drv", "tick"]).withColumnRenamed("h", "heading_err")


def kinds(spark, rows, **kw):
    """(kind, car, second) of every detection."""
    return [(d["type"], d["drivers"], d["t"]) for d in DE.detect(frame(spark, rows), n_sectors=12, **kw).orderBy("id").collect()]


def test_an_even_field_is_silent(spark):
    assert kinds(spark, lap_of(60)) == []


def test_a_wall_is_one_impact_and_one_stop(spark):
    got = kinds(spark, lap_of(edit=into_the_wall("87", 12.5)))
    assert sorted(k for k, _, _ in got if k != "SPIN") == ["IMPACT", "STOPPED"]
    assert all(cars == ["87"] and 12.5 <= s <= 16 for _, cars, s in got)


def test_standing_fields_and_suspensions_are_no_incident(spark):
    def formation(row, s):
        if s < 22:
            row["speed"], row["field_slow"] = 0.0, 1.0
    assert kinds(spark, lap_of(130, formation)) == []

    def stopped_race(row, s):
        into_the_wall("21", 9.0)(row, s)
        row["suspended"] = True
    assert kinds(spark, lap_of(edit=stopped_race)) == []


def test_a_car_that_falls_silent_at_speed(spark):
    def silence(row, s):
        if row["drv"] == "99" and s >= 18:
            row["speed"] = row["x"] = row["y"] = None
    assert kinds(spark, lap_of(100, silence)) == [("DROPOUT", ["99"], 19.75)]


def test_neighbouring_crashes_are_one_incident(spark):
    def pile(row, s):
        into_the_wall("30", 14.0, 3)(row, s)
        into_the_wall("5", 15.25, 4)(row, s)
    assert [cars for k, cars, _ in kinds(spark, lap_of(edit=pile)) if k == "MULTI"] == [["30", "5"]]


def test_a_slow_pit_car_beside_fast_ones_has_not_stopped(spark):
    def limited(row, s):
        row["ref_speed"] = row["speed"] = 310.0
        if row["drv"] == "21" and s >= 11:
            row["speed"] = 79.0
    assert "STOPPED" not in {k for k, _, _ in kinds(spark, lap_of(edit=limited))}


def test_hard_braking_is_no_impact(spark):
    def corner(row, s):
        if row["drv"] == "30" and s >= 16:
            row["speed"], row["brake"] = PACE - 38.0 * min(3, int((s - 16) * 4)), s < 16.75
    assert "IMPACT" not in {k for k, _, _ in kinds(spark, lap_of(edit=corner))}


def test_the_way_back_to_the_grid_is_no_racing(spark):
    def restart(row, s):
        row["suspended"] = s < 72
        into_the_wall("5", 88.0)(row, s)
    assert kinds(spark, lap_of(460, restart)) == []


def test_the_flag_ends_it(spark):
    df = frame(spark, lap_of(edit=into_the_wall("87", 12.5))).withColumn("after_chequered", F.col("t") > 7)
    assert DE.detect(df, n_sectors=12).collect() == []


def test_the_baseline_sees_a_slow_car(spark):
    got = DE.naive(frame(spark, lap_of(edit=into_the_wall("99", 20.0)))).collect()
    assert [(d["drivers"], d["t"]) for d in got] == [(["99"], 21.0)]


@pytest.mark.parametrize("chunk", [32, 4096])
def test_windows_and_fold_equal_the_rows_marked_one_by_one(spark, chunk):
    """Every car of the tables, in one chunk and in chunks of 8 s that runs, latches and cooldowns cross: the batch finds what the stream's
    marks and the shared step find, headings and evidence included."""
    df = T.features(spark, "/root/testdata/sf0.01")
    rng = F.xxhash64("race", "drv", "tick") % 97
    df = df.withColumn("heading_err", F.when(rng == 5, F.lit(60.0)).otherwise(F.lit(3.0)))
    got = DE.car_fold(DE.car_events(df, SCALED, chunk=chunk), SCALED, chunk=chunk)
    cols = ("race", "drv", "tick", "kind", "msector", "severity", "evidence")
    got = sorted(tuple(r[c] for c in cols) for r in got.collect())
    given = [c for c in CARRIED if c in df.columns]
    rows = df.select("race", "drv", "tick", *given, *[c.alias(n) for n, c in DE.conditions(df.columns, SCALED).items()]).orderBy("race", "drv", "tick").collect()
    want, cars = [], {}
    for r in rows:
        key = (r["race"], r["drv"])
        marks, state = cars.setdefault(key, ({}, {}))
        state, made = DE.car_step(SCALED)(state, [mark(marks, {**dict.fromkeys(CARRIED), **r.asDict()}, SCALED)])
        cars[key] = (marks, state)
        want += [(*key, *(m[c] for c in cols[2:])) for m in made]
    assert len(want) > 200 and got == sorted(want) and any("heading" in w[-1] for w in want)


def test_removing_the_future_changes_nothing_before_it(spark, sf):
    df, cut = T.features(spark, sf), 60
    whole = DE.detect(df, T.SCALED, 10).filter(F.col("tick") < cut)
    part = DE.detect(df.filter(F.col("tick") < cut), T.SCALED, 10)
    key = ("race", "id", "t", "type")
    assert sorted(tuple(r[k] for k in key) for r in whole.collect()) == sorted(tuple(r[k] for k in key) for r in part.collect())


def test_features_do_not_look_ahead(spark, sf):
    from trackguard.plans.pipeline import build_features
    from trackguard.sources import adapter as AD
    g = T.grid(spark, sf)
    laps, cut = AD.laps(g), 40
    cols = ["speed_ratio", "rel_ratio", "lap_ratio", "dspeed_min_5s", "heading_max_5s", "gap_ahead_s", "t_since_restart", "field_ratio"]
    whole = build_features(g, laps, AD.weather(g), AD.ring_reference(g), AD.LENGTH).filter(F.col("tick") < cut)
    part = build_features(g.filter(F.col("tick") < cut), laps, AD.weather(g), AD.ring_reference(g), AD.LENGTH)
    a = {(r["drv"], r["tick"]): tuple(r[c] for c in cols) for r in whole.collect()}
    b = {(r["drv"], r["tick"]): tuple(r[c] for c in cols) for r in part.collect()}
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert x == y or (x is not None and y is not None and math.isclose(x, y, rel_tol=1e-12)), k


def test_saved_settings_ignore_unknown_names():
    p = DetectorParams().with_saved({"stop_ratio": 0.4, "unknown": 1})
    assert p.stop_ratio == 0.4 and p == DetectorParams(stop_ratio=0.4)
