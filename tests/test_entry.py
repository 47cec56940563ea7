"""The entry points, a sample of the registered queries against their SQL, and the session rules."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry
from check import TABLES, close, rows_of
from trackguard import session
from trackguard.sources import readers as RE, sinks as SI

FAST = ["a4_time_grid", "a5_asof_with_staleness", "a8_in_pit", "a12_neighbour_gaps", "d8_previous_lap", "d19_long_windows", "e1_race_gates",
        "e12_naive_detections", "h7_incident_scores", "h15_h16_own_reference", "m20_average_precision", "r5_project", "v1_cars_out", "v9_lead_labels"]


def test_every_oracle_has_its_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) > 130 and set(o) <= set(q) and len(o) > 95


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["race", "msector", "alerts"] and df.count() > 0


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    ecols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert cols == ecols and len(got) == len(want) > 0
    assert all(all(close(x, y) for x, y in zip(a, b)) for a, b in zip(got, want))


def test_shared_folder_comes_from_the_cluster(monkeypatch):
    class Conf:
        def __init__(self, named):
            self.named = named

        def get(self, key, default=None):
            return self.named if key == "spark.checkpoint.dir" else default

    class Fake:
        def __init__(self, named, master):
            self.conf = Conf(named)
            self.sparkContext = type("C", (), {"master": master, "applicationId": "x"})()
    assert session.shared_dir(Fake("hdfs://share", "yarn")) == "hdfs://share"
    with pytest.raises(RuntimeError):
        session.shared_dir(Fake(None, "yarn"))


def test_holdout_races_are_refused(spark):
    ok = spark.createDataFrame([("2024_Monaco",)], "race string")
    assert RE.assert_no_holdout(ok) is ok
    with pytest.raises(RE.HoldoutError):
        RE.assert_no_holdout(spark.createDataFrame([("2026_Spanish",)], "race string"))


def test_raw_tables_are_read_with_their_schema(spark, tmp_path):
    path = str(tmp_path / "weather")
    spark.createDataFrame([("R", 1.0, 20.0, float("nan"), 0.0)], RE.SCHEMAS["weather"]).write.json(path)
    df = RE.without_nan(RE.read_raw(spark, path, "weather", "json"))
    assert df.first()["air_temp"] == 20.0 and df.first()["track_temp"] is None
    assert SI.markdown(df.select("race", "t")) == "| race | t |\n|---|---|\n| R | 1.0 |\n"


def test_raw_samples_to_recommendations(spark, sf):
    """The two pipelines end to end: alignment keeps every car on every tick, and flags follow detections."""
    from trackguard.plans import catalog, pipeline, tables as T
    rows = catalog.QUERIES["a20_align_race"](spark, sf)
    per = rows.groupBy("race").agg({"tick": "count"}).collect()
    assert len(per) == 4 and rows.count() == rows.select("race", "drv", "tick").distinct().count()
    assert rows.filter("dist is not null and (msector < 1 or msector > 10)").isEmpty()
    out = pipeline.watch(T.features(spark, sf), 10, T.SCALED, T.FLAG_SET)
    named = {d["id"] for d in out.detections.collect()}
    sources = {s for r in out.recommendations.collect() for s in r["source_detections"]}
    assert named and sources and sources <= named
