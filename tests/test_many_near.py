"""Races in which very many rows lie near very many messages."""

from trackguard.operators import exposure as EX, features as FE


def test_slow_cars_are_joined_once_per_time_and_sector(spark, monkeypatch):
    rows = [("R", str(c), k, k / 4, "1", False, 0.0, 0.3, False, 1 + c % 2) for k in range(8) for c in range(100)]
    df = spark.createDataFrame(rows, "race string, drv string, tick int, t double, track_status string, suspended boolean, field_slow double, "
                                     "speed_ratio double, in_pit boolean, msector int")
    calls = spark.createDataFrame([("R", 1, 1.0, "YELLOW", 1), ("R", 2, 1.0, "YELLOW", 6)], "race string, event_id bigint, t double, flag string, msector int")
    seen, join = [], FE.interval_join
    monkeypatch.setattr(FE, "interval_join", lambda points, *a, **k: seen.append(points.count()) or join(points, *a, **k))
    assert [tuple(r) for r in FE.flag_alignment(df, calls, 10).collect()] == [("R", 1, 2)]
    assert seen == [16]


def test_places_in_lists_need_no_sort_of_the_pairs(spark):
    dets = spark.createDataFrame([("R", f"d{k:03d}", (k * 7 % 50) * 5.0) for k in range(200)], "race string, id string, t double")
    crashes = spark.createDataFrame([("R", c, c * 12.25) for c in range(30)], "race string, crash bigint, onset double")
    want = []
    pairs = sorted((c["crash"], round(d["t"] - c["onset"], 2), d["id"]) for c in crashes.collect() for d in dets.collect() if -10 <= d["t"] - c["onset"] <= 180)
    for k, p in enumerate(pairs):
        want.append((*p, 1 if k == 0 or pairs[k - 1][0] != p[0] else want[-1][3] + 1))
    got = EX.listed_detections(dets, crashes)
    assert sorted((r["crash"], r["t_after"], r["id"], r["place_in_list"]) for r in got.collect()) == want
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_lists_are_the_same_when_detections_are_too_many_to_broadcast(spark, monkeypatch):
    dets = spark.createDataFrame([("R", f"d{k:03d}", k * 0.25) for k in range(100)], "race string, id string, t double")
    crashes = spark.createDataFrame([("R", c, c * 1.5) for c in range(20)], "race string, crash bigint, onset double")
    few = sorted(map(tuple, EX.listed_detections(dets, crashes).collect()))
    monkeypatch.setattr(EX, "is_small", lambda df: False)
    assert sorted(map(tuple, EX.listed_detections(dets, crashes).collect())) == few and few
