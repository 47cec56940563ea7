"""Streams give what the batch gives."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from trackguard.plans import catalog, tables as T
from trackguard.plans.q_ingest import scratch
from trackguard.plans.q_stream import in_steps
from trackguard.streaming import queries as ST

SF = "/root/testdata/sf0.01"


def test_streamed_detections_equal_the_batch(spark):
    got = sorted((r["race"], r["drv"], r["tick"], r["kind"], r["msector"], r["severity"], r["evidence"]) for r in catalog.QUERIES["e15_streaming_detection"](spark, SF).collect())
    want = sorted((r["race"], r["drivers"][0], r["tick"], r["type"], r["msector"], r["severity"], r["evidence"]) for r in T.detections(spark, SF).filter("type <> 'MULTI'").collect())
    assert len(want) > 100 and got == want


def test_streamed_flags_equal_the_batch(spark):
    cols = ("race", "tick", "t", "msector", "flag", "confidence", "reason", "message")
    key = [lambda r: tuple(r[c] for c in cols)][0]
    got = sorted(map(key, catalog.QUERIES["g_streaming_flags"](spark, SF).collect()))
    want = sorted(map(key, T.recs(spark, SF).collect()))
    assert len(want) > 100 and got == want


def test_incident_sessions(spark):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    rows = [("R", i, at(s), f, 1) for i, (s, f) in enumerate([(0, "YELLOW"), (60, "SC"), (130, "RED"), (131, "CLEAR"), (1000, "YELLOW")])]
    df = spark.createDataFrame(rows, "race string, tick int, ts timestamp, flag string, msector int")
    root = f"{scratch(spark)}-{uuid.uuid4().hex[:6]}"
    in_steps(df, f"{root}/in", ["race"], 2)
    ST.run_to_table(ST.incident_stream(ST.tick_source(spark, f"{root}/in", df.schema)), f"{root}/out", f"{root}/checkpoint")
    got = spark.read.parquet(f"{root}/out").orderBy("ts_first").select("events", "flags", F.unix_timestamp("ts_first").alias("a")).collect()
    base = int(at(0).replace(tzinfo=dt.timezone.utc).timestamp())
    assert [(r["events"], r["flags"], r["a"] - base) for r in got] == [(2, "SC YELLOW", 0), (1, "RED", 130)]


def test_records_do_not_convert_whole_frames(monkeypatch):
    """A key has few rows: whole-frame operations cost the same for one row as for many, so none is used."""
    import pandas as pd
    from trackguard.streaming.queries import records
    first = pd.DataFrame({"tick": [5, 3], "drv": ["b", None], "speed": [float("nan"), 2.0], "at": pd.to_datetime(["2026-01-01", None]), "ok": [True, None], "ids": [["x"], []]})
    second = pd.DataFrame({"tick": [3], "drv": ["a"], "speed": [1.5], "at": pd.to_datetime([None]), "ok": [False], "ids": [None]})
    for name in ("astype", "where", "notna", "sort_values", "to_dict"):
        monkeypatch.setattr(pd.DataFrame, name, None)
    got = records(iter([first, second]), ["tick", "drv"])
    assert [(r["tick"], r["drv"], r["speed"], r["ok"]) for r in got] == [(3, "a", 1.5, False), (3, None, 2.0, None), (5, "b", None, True)]
    assert got[0]["at"] is None and got[2]["at"] == pd.Timestamp("2026-01-01") and got[2]["ids"] == ["x"] and type(got[0]["tick"]) is int
