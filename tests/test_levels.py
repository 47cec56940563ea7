"""Totals of several levels in one pass, and the filling of a speed profile."""

from statistics import median

import pytest
from pyspark.sql import functions as F

from trackguard.operators import geometry as GE, scoring as SC

SCORE = "system string, race string, matched boolean, held boolean, lead_s double"


def test_levels_are_sums_over_their_own_rows(spark):
    scores = [("a", "R", True, False, 2.0), ("a", "R", True, True, None), ("a", "S", True, False, 5.0), ("a", "S", True, False, -1.0), ("a", "S", False, False, None),
              ("b", "R", False, False, None), ("b", "R", False, False, None), ("b", "S", True, False, 7.0), ("b", "S", False, False, None), ("b", "S", False, False, None)]
    marked = [("a", "R", True), ("a", "S", False), ("b", "S", True), ("b", "T", True)]
    hours = [(s, r, h) for s in "ab" for r, h in (("R", 1.0), ("S", 2.0), ("T", 0.5))]
    got = SC.score_levels(spark.createDataFrame(scores, SCORE), spark.createDataFrame(marked, "system string, race string, false_alarm boolean"),
                          spark.createDataFrame(hours, "system string, race string, hours double")).collect()
    assert len(got) == 6 + 2 + 1
    for r in got:
        inside = lambda row: (r["system"] is None or row[0] == r["system"]) and (r["race"] is None or row[1] == r["race"])
        s, m, h = ([x for x in table if inside(x)] for table in (scores, marked, hours))
        leads = [x[4] for x in s if x[4] is not None]
        assert r["level"] == (r["race"] is None) + 2 * (r["system"] is None) and r["races"] == len(h)
        assert (r["incidents"], r["matched"], r["held"], r["alerts"], r["false_alarms"]) == (
            len(s), sum(x[2] for x in s), sum(x[3] for x in s), len(m), sum(x[2] for x in m))
        assert r["median_lead_s"] == (median(leads) if leads else None) and r["hours"] == sum(x[2] for x in h)
        assert r["recall"] == (pytest.approx(sum(x[2] for x in s) / len(s)) if s else None)
        assert r["fa_per_hour"] == pytest.approx(sum(x[2] for x in m) / sum(x[2] for x in h))


def test_empty_bins_of_a_profile_lie_between_their_neighbours(spark):
    rows = [("R", 25.0, 100.0), ("R", 26.0, 120.0), ("R", 27.0, 300.0), ("R", 65.0, 200.0), ("R", 5000.0, 50.0), ("R", 15.0, None), ("Q", 5.0, 80.0)]
    got = {(r["race"], r["bin"]): r["ref_speed"] for r in GE.speed_profile(spark.createDataFrame(rows, "race string, dist double, speed double"), ["race"], 100.0).collect()}
    assert [got["R", b] for b in range(10)] == [120.0, 120.0, 120.0, 140.0, 160.0, 180.0, 200.0, 150.0, 100.0, 50.0]
    assert all(got["Q", b] == 80.0 for b in range(10))
