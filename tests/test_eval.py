"""Incidents, onsets, escalations and exposure on small hand-made data."""

import random

import pytest
from pyspark.sql import functions as F

from trackguard.operators import escalation as ES, exposure as EX, geometry as GE, incidents as IN, live as LI, onset as ON, scoring as SC

L = 1000.0


def lap_race(spark, change=None, seconds=110.0):
    """Four cars 100 m apart at 50 m/s on a 1000 m lap, 4 Hz."""
    rows = []
    for i, d in enumerate(["1", "2", "3", "4"]):
        for k in range(int(seconds * 4)):
            t = k / 4
            far = 50 * t + 100 * i
            r = {"race": "R", "drv": d, "tick": k, "t": t, "dist": far % L, "drv_lap": int(far // L) + 1, "speed": 180.0, "track_status": "1",
                 "in_pit": False, "suspended": False, "msector": int(far % L // 100) + 1, "x": 0.0}
            if change:
                change(r)
            rows.append(tuple(r.values()))
    df = spark.createDataFrame(rows, "race string, drv string, tick int, t double, dist double, drv_lap int, speed double, track_status string, "
                                     "in_pit boolean, suspended boolean, msector int, x double")
    return ON.own_reference(df, L)


def test_collapse_gives_one_onset(spark):
    def slow(r):
        if r["drv"] == "1" and 86 <= r["t"] < 90:
            r["speed"] = 40.0
    assert [(o["drv"], o["t"]) for o in ON.onsets(lap_race(spark, slow)).collect()] == [("1", 86.0)]


def test_procession_and_standing_car_give_no_new_onset(spark):
    def field(r):
        if 86 <= r["t"] < 95:
            r["speed"] = 40.0
    assert ON.onsets(lap_race(spark, field)).collect() == []

    def stops(r):
        if r["drv"] == "1" and r["t"] >= 86:
            r["speed"] = 0.0
        if 95 <= r["t"] < 100:
            r["track_status"] = "4"
    assert [o["t"] for o in ON.onsets(lap_race(spark, stops)).collect()] == [86.0]


def test_crossing_of_the_crash_site(spark):
    place = spark.createDataFrame([("R", "p", 500.0, 60.0, 80.0, ["1"])], "race string, place string, crash_dist double, t0 double, t1 double, cars array<string>")
    got = EX.crossings(lap_race(spark), place, L).collect()
    two = [r for r in got if r["car"] == "2"]
    assert [r["t_pass"] for r in two] == [68.0] and two[0]["pct_of_own_normal"] == 100.0
    assert not [r for r in got if r["car"] == "1"]


def test_onset_is_the_start_of_the_last_chain(spark):
    schema = "race string, incident int, t double, t_hit double, onset_drv string, onset_dist double, hit_sector int"
    cand = spark.createDataFrame([("R", 1, 180.0, t, d, 0.0, 1) for t, d in ((100.0, "30"), (170.0, "27"), (172.0, "55"), (184.0, "4"))]
                                 + [("R", 2, 180.0, t, d, 0.0, 1) for t, d in ((182.0, "1"), (184.0, "2"))], schema)
    picked = ON.pick_onset(cand)
    assert {r["incident"]: r["onset_drv"] for r in picked.collect()} == {1: "27", 2: "1"}
    cars = {r["incident"]: r["cars"] for r in ON.onset_cars(cand, picked).collect()}
    assert cars[1] == ["27", "4", "55"]


REC = "race string, t double, id string, flag string, msector int, message string, reason string"


def recs(spark, rows):
    return spark.createDataFrame([("R", t, f"rec-{i:06d}", f, s, m, "") for i, (t, f, s, m) in enumerate(rows)], REC)


def test_downgrades_and_resets(spark):
    r = recs(spark, [(1.0, "SC", 3, "x"), (2.0, "RED", 3, "x"), (3.0, "RED", 3, "x"), (4.0, "SC", 3, "x"), (5.0, "CLEAR", 3, "TRACK CLEAR"), (6.0, "VSC", 3, "x")])
    assert sorted(x["t"] for x in ES.escalation_recs(r).collect()) == [1.0, 2.0, 3.0, 6.0]
    r = recs(spark, [(1.0, "RED", 3, "x"), (9.0, "SC", 3, "x")])
    reset = spark.createDataFrame([("R", 5.0)], "race string, t double")
    assert sorted(x["t"] for x in ES.escalation_recs(r).collect()) == [1.0]
    assert sorted(x["t"] for x in ES.escalation_recs(r, reset).collect()) == [1.0, 9.0]


def test_track_wide_state_and_running_red(spark):
    r = recs(spark, [(10.0, "SC", 3, "x"), (40.0, "RED", 3, "x"), (60.0, "RED", 3, "x"), (70.0, "CLEAR", 3, "CLEAR IN TRACK SECTOR 3"), (90.0, "SC", 3, "x"),
                     (100.0, "RED", 5, "x"), (130.0, "CLEAR", 5, "TRACK CLEAR")])
    at = spark.createDataFrame([("R", t) for t in (5.0, 50.0, 70.0, 95.0, 120.0, 140.0)], "race string, t double")
    got = {x["t"]: (x["our_flag"], x["our_red_since"]) for x in ES.track_flag_at(at, "t", ES.track_changes(r)).collect()}
    assert got == {5.0: (None, None), 50.0: ("RED", 40.0), 70.0: ("RED", 40.0), 95.0: ("SC", None), 120.0: ("RED", 100.0), 140.0: ("CLEAR", None)}


def test_delay_curve(spark):
    schema = "race string, place string, t0 double, car string, t_pass double, pct_of_own_normal double"
    rows = [("R", "p", 0.0, c, t, p) for c, t, p in [("1", 2.0, 100.0), ("1", 30.0, 100.0), ("2", 2.5, 79.9), ("2", 20.0, 80.0), ("3", 5.2, 95.0), ("4", 7.0, None), ("5", 61.0, 99.0)]]
    firsts = EX.first_racing_passes(spark.createDataFrame(rows, schema))
    assert {r["car"]: r["t_after"] for r in firsts.collect()} == {"1": 2.0, "2": 20.0, "3": 5.2, "5": 61.0}
    places = spark.createDataFrame([("R", "p"), ("R", "none")], "race string, place string")
    curve = {(r["place"], r["delay_s"]): r["cars"] for r in EX.delay_curve(firsts, places).collect()}
    assert len(curve) == 242 and curve["p", 1.5] == 0 and curve["p", 2.0] == 1 and curve["p", 5.0] == 1 and curve["p", 5.5] == 2 and curve["p", 60.0] == 3
    assert all(curve["none", d / 2] == 0 for d in range(121))
    assert all(curve["p", d / 2] <= curve["p", (d + 1) / 2] for d in range(120))


@pytest.mark.parametrize("size", [64.0, 4096.0])
def test_incident_grouping_equals_the_serial_rule(spark, size):
    rnd = random.Random(7)
    flags = ["YELLOW", "DOUBLE_YELLOW", "VSC", "SC", "RED", "CLEAR", "CLEAR"]
    msgs = []
    for i, t in enumerate(sorted(rnd.uniform(0, 3000) for _ in range(90))):
        f = rnd.choice(flags)
        s = None if f in ("VSC", "SC", "RED") or (f == "CLEAR" and rnd.random() < 0.2) else rnd.randint(1, 10)
        msgs.append(("R", t, i, f, s))
    n, shown, incs, want = 10, {}, [], {}
    for _, t, i, f, s in msgs:
        if f == "CLEAR":
            shown = {} if s is None else {k: v for k, v in shown.items() if k != s}
            continue
        recent = [x for x in incs if t - x["last"] <= 120]
        home = shown.get(s) if s is not None else None
        if home is None and s is None:
            home = max(shown.values(), key=lambda x: x["last"]) if shown else recent[-1] if recent else None
        elif home is None:
            home = next((x for x in reversed(recent) if any(abs((s - a + 5) % n - 5) <= 2 for a, v in shown.items() if v is x)), None)
        if home is None:
            home = {"id": i}
            incs.append(home)
        home["last"] = t
        want[i] = home["id"]
        if s is not None:
            shown[s] = home
    off = spark.createDataFrame(msgs, "race string, t double, event_id bigint, flag string, msector int")
    df = spark.createDataFrame([("R", 0, 0.0, False)], "race string, tick int, t double, suspended boolean")
    got = {r["event_id"]: r["incident"] for r in IN.build_incidents(off, df, n, size=size).collect()}
    assert got == want


def test_crash_grouping_merges_reflags(spark):
    schema = "race string, incident bigint, t double, onset_drv string, t_hit double, onset_dist double, hit_sector int"
    cand = spark.createDataFrame([("R", 1, 100.0, "23", 95.0, 10.0, 4), ("R", 1, 100.0, "16", 97.0, 12.0, 4), ("R", 2, 150.0, "16", 97.0, 12.0, 4),
                                  ("R", 3, 400.0, "23", 390.0, 10.0, 4)], schema)
    for size in (64.0, 4096.0):
        got = {r["incident"]: (r["crash"], r["cars"]) for r in EX.group_crashes(cand, size=size).collect()}
        assert got == {1: (1, ["16", "23"]), 2: (1, ["16", "23"]), 3: (3, ["23"])}


def test_path_projection_keeps_to_its_leg_of_a_hairpin(spark):
    """Two legs 10 m apart: a car on the first leg drifting towards the second stays on the first."""
    ref = [(i, 5.0 * i, 5.0 * i, 0.0) for i in range(40)] + [(40 + i, 200.0 + 5.0 * i, 195.0 - 5.0 * i, 10.0) for i in range(40)]
    ref = spark.createDataFrame([("R", *r) for r in ref], "race string, i int, dist double, x double, y double")
    path = [("R", "1", k, 20.0 + 5.0 * k, 0.5 if k < 4 else 6.0) for k in range(12)]
    pts = spark.createDataFrame(path, "race string, drv string, tick int, x double, y double")
    for chunk in (4, 4096):
        got = {r["tick"]: r["dist"] for r in GE.project_path(pts, ref, 400.0, chunk=chunk).collect()}
        assert all(got[k] < 200 for k in range(12)), got
    plain = {r["tick"]: r["dist"] for r in GE.project(pts, ref, ["race"], F.lit(400.0)).collect()}
    assert plain[8] > 200


def test_far_positions_are_found_in_larger_cells(spark):
    ref = spark.createDataFrame([("R", i, 5.0 * i, 5.0 * i, 0.0) for i in range(100)], "race string, i int, dist double, x double, y double")
    pts = spark.createDataFrame([("R", "1", 0, 250.0, 3.0), ("R", "1", 1, 250.0, 900.0), ("R", "1", 2, -5000.0, 70.0), ("R", "1", 3, None, None)],
                                "race string, drv string, tick int, x double, y double")
    got = {r["tick"]: r["_near"] for r in GE.nearest(pts, GE.with_next(ref, ["race"]), ["race"], 16.0).collect()}
    assert got[0][0]["i"] == 50 and got[1][0]["i"] == 50 and got[2][0]["i"] == 0 and got[3] is None


def test_call_log_order_and_confirmation(spark):
    r = spark.createDataFrame([("R", 10.0, "rec-000001", "DOUBLE_YELLOW", 5, "DOUBLE YELLOW IN TRACK SECTOR 5", "car 7 stopped (on track)", ["det-000001"]),
                               ("R", 14.0, "rec-000002", "SC", 5, "SAFETY CAR DEPLOYED", "car 7 stopped for 3.0 s after an impact", []),
                               ("R", 15.0, "rec-000003", "DOUBLE_YELLOW", 5, "DOUBLE YELLOW IN TRACK SECTOR 5", "advisory", ["det-000001"]),
                               ("R", 90.0, "rec-000004", "CLEAR", 5, "TRACK CLEAR", "", [])],
                              "race string, t double, id string, flag string, msector int, message string, reason string, source_detections array<string>")
    off = spark.createDataFrame([("R", 20.0, 1, "YELLOW", 5), ("R", 40.0, 2, "SC", None)], "race string, t double, event_id bigint, flag string, msector int")
    dets = spark.createDataFrame([("R", "det-000001", ["7"], "STOPPED")], "race string, id string, drivers array<string>, type string")
    for size in (16.0, 4096.0):
        got = [(c["t"], c["call"], c["scope"], c["cars"], c["lead_s"]) for c in LI.call_log(r, off, dets, 10, size).orderBy("t").collect()]
        assert got == [(10.0, "raise", "5", "7", None), (14.0, "raise", "TRACK", "7", None), (20.0, "confirm", "5", None, 10.0),
                       (40.0, "confirm", "TRACK", None, 26.0), (90.0, "clear", "TRACK", None, None)]


def test_positions_without_a_line_come_back_empty(spark):
    """Races without reference points, unknown positions and endless ones are not searched and not lost."""
    ref = spark.createDataFrame([("R", i, 5.0 * i, 5.0 * i, 0.0) for i in range(40)], "race string, i int, dist double, x double, y double")
    inf, nan = float("inf"), float("nan")
    pts = [("R", 1, 52.0, 1.0), ("Q", 2, 52.0, 1.0), ("R", 3, None, 1.0), ("R", 4, nan, 1.0), ("R", 5, inf, 1.0), ("R", 6, 1e12, 2.0), (None, 7, 1.0, 1.0)]
    df = spark.createDataFrame(pts, "race string, k int, x double, y double")
    got = {r["k"]: (r["dist"], r["lat_off"]) for r in GE.project(df, ref, ["race"], F.lit(400.0)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7] and abs(got[1][0] - 52.0) < 1e-6 and abs(got[1][1] - 1.0) < 1e-6 and got[6][0] is not None
    assert all(got[k] == (None, None) for k in (2, 3, 4, 5, 7))


def test_settings_that_detect_nothing_are_scored(spark):
    """A candidate without detections in a race, or anywhere, misses that race's incidents."""
    rows = [(r, "1", k, k / 4, 200.0, False, 3) for r in "AB" for k in range(80)]
    df = spark.createDataFrame(rows, "race string, drv string, tick int, t double, speed double, suspended boolean, msector int").withColumn("in_pit", F.lit(False))
    inc = spark.createDataFrame([(r, 1, 10.0, 12.0, "YELLOW", [3], False) for r in "AB"], "race string, incident int, t double, t_last double, top_flag string, sectors array<int>, track_wide boolean")
    dets = spark.createDataFrame([(0, "A", "d1", 9.0, ["1"], 3, "SPIN", 0.5), (0, "B", "d2", 9.0, ["1"], 3, "SPIN", 0.5), (1, "A", "d3", 9.0, ["1"], 3, "SPIN", 0.5)],
                                 "cand int, race string, id string, t double, drivers array<string>, msector int, type string, severity double")
    systems = spark.createDataFrame([(0,), (1,), (2,)], "cand int")
    s = SC.incident_scores(df, inc, dets, 20, ["cand", "race"], systems=systems)
    assert {(r["cand"], r["race"]): r["matched"] for r in s.collect()} == {(c, r): (c, r) in ((0, "A"), (0, "B"), (1, "A")) for c in range(3) for r in "AB"}
    found = SC.false_alarms(SC.alerts(dets, ["cand", "race"]), inc, 20, ["cand", "race"])
    got = SC.race_summary(s, found, SC.race_hours(df), ["cand", "race"], systems).collect()
    assert len(got) == 6 and all(r["hours"] > 0 for r in got) and SC.choose(SC.race_summary(s, found, SC.race_hours(df), ["cand", "race"], systems), 99.0, []).first()["cand"] == 0


def test_field_pace_knows_only_the_past(spark):
    """The pace at a pass comes from green samples up to it: the last 40 of the bin, or of a neighbour if there are fewer than 3."""
    rows = [("R", str(k % 7), 10.0 * k, 120.0, 100.0 + k, "1") for k in range(60)] + [("R", "9", 5.0, 170.0, 300.0, "1"), ("R", "8", 306.0, 120.0, 999.0, "4"),
                                                                                     ("R", "7", 307.0, 120.0, 20.0, "1")]
    df = spark.createDataFrame(rows, "race string, drv string, t double, dist double, speed double, track_status string")
    asked = [("R", 1, "1", 15.0, 120.0), ("R", 1, "2", 305.0, 120.0), ("R", 2, "3", 591.0, 120.0), ("R", 3, "4", 305.0, 170.0), ("R", 4, "5", 305.0, 800.0)]
    passes = spark.createDataFrame(asked, "race string, place int, car string, t_pass double, crash_dist double")
    got = {(r["place"], r["car"]): r["field_kmh"] for r in LI.field_pace(passes, df).collect()}
    assert got == {(1, "2"): 115.0 + 0.0, (2, "3"): 140.0, (3, "4"): 115.0}


def test_the_exposure_clock_counts_racing_cars_once(spark):
    rows = [("R", d, k, k * 0.25, float((k * 10) % 1000), v, "1", 1 + k * 10 // 1000) for d, v in (("1", 200.0), ("2", 90.0)) for k in range(400)]
    df = spark.createDataFrame(rows, "race string, drv string, tick int, t double, dist double, speed double, track_status string, drv_lap int")
    passes = spark.createDataFrame([("R", 7, c, t, v, 500.0) for c, t, v in (("1", 62.6, 170.0), ("1", 87.5, 199.0), ("2", 62.6, 60.0), ("3", 62.6, 119.0), ("4", 62.6, 165.0))],
                                   "race string, place int, car string, t_pass double, speed_kmh double, crash_dist double")
    got = {r["car"]: (r["t_pass"], r["reference"]) for r in LI.exposure_clock(passes, df, 1000.0).collect()}
    assert got == {"1": (62.6, "own pace"), "4": (62.6, "field pace")}


def test_the_clock_runs_from_our_call_to_the_official_one(spark):
    calls = spark.createDataFrame([("R", "a", 20.0, "SC"), ("R", "b", 30.0, "VSC"), ("R", "c", 40.0, "YELLOW"), ("R", "d", 90.0, "RED")], "race string, id string, t double, flag string")
    named = spark.createDataFrame([("R", "a", ["1", "2", "9"]), ("R", "b", ["1"]), ("R", "c", ["1"]), ("R", "d", ["2"])], "race string, id string, rec_cars array<string>")
    said = spark.createDataFrame([("R", 25.0, "VSC"), ("R", 33.0, "SC"), ("R", 10.0, "RED")], "race string, t double, flag string")
    df = spark.createDataFrame([("R", d, float(t), 10.0 * t + (500.0 if d == "2" else 0.0)) for d in "12" for t in range(0, 101, 5)], "race string, drv string, t double, dist double")
    got = {r["place"]: (r["crash_dist"], r["t0"], r["t1"]) for r in LI.clock_places(calls, named, said, df).collect()}
    assert got == {"a": (700.0, 20.0, 33.0), "b": (300.0, 30.0, 33.0), "d": (1400.0, 90.0, 100.0)}


@pytest.mark.parametrize("name", ["h8_race_hours", "h9_race_summary", "h9_h10_levels", "m9_m10_labels", "m13_train_keep"])
def test_scores_and_labels_do_not_wait_for_the_features(spark, sf, name, monkeypatch):
    """They ask for the state of the field only, which is the same in the full table."""
    from trackguard.plans import catalog, tables as T
    monkeypatch.setattr(T, "_KEPT", {})
    assert catalog.QUERIES[name](spark, sf).count()
    assert "features" not in {made for _, _, made in T._KEPT}


def test_the_state_of_the_field_is_that_of_the_features(spark, sf):
    from trackguard.plans import tables as T
    own, full = T.paces(spark, sf), T.features(spark, sf)
    full = full.select(*own.columns)
    assert own.exceptAll(full).isEmpty() and full.exceptAll(own).isEmpty()
