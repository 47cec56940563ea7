"""How a stream's rows are dealt to micro-batches and tasks, and how a car's rows travel."""

import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from trackguard.plans import q_stream as Q
from trackguard.streaming import queries as ST


def test_a_time_slice_is_one_micro_batch_and_its_files_hold_keys_of_every_task(spark, monkeypatch):
    """A file that held the keys of one task would leave all other tasks idle."""
    seen = {}

    def run(stream, path, checkpoint, run_to_table=ST.run_to_table):
        run_to_table(stream, path, checkpoint)
        seen["batches"] = len([f for f in os.listdir(f"{checkpoint.removeprefix('file:')}/commits") if f.isdigit()])
        seen["in"] = f"{path.removesuffix('out')}in"
    monkeypatch.setattr(ST, "run_to_table", run)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(6000).select(F.lit("R").alias("race"), (F.col("id") % 1000).cast("string").alias("drv"), F.floor(F.col("id") / 1000).cast("int").alias("tick"))
    out = Q.streamed(spark, rows, lambda s: s, ["race", "drv"])
    assert out.exceptAll(rows).isEmpty() and out.count() == 6000 and seen["batches"] == Q.STEPS
    tasks = spark.read.parquet(seen["in"]).select(F.input_file_name().alias("f"), F.pmod(F.hash("race", "drv"), F.lit(n)).alias("task"))
    assert min(r["n"] for r in tasks.groupBy("f").agg(F.countDistinct("task").alias("n")).collect()) == n
    slices = spark.read.parquet(seen["in"]).select(F.input_file_name().alias("f"), "drv", F.floor(F.col("tick") / 2).alias("slice"))
    assert slices.groupBy("drv", "slice").agg(F.countDistinct("f").alias("n")).filter("n > 1").isEmpty()


def test_packed_rows_are_in_order_and_plain():
    frames = [pd.DataFrame({"tick": [5, 3], "given": [np.array([1.005, np.nan]), [2.675, None]]}), pd.DataFrame({"tick": [4], "given": [np.array([0.0, 1.0])]})]
    got = ST.unpacked(iter(frames), ["a", "b"])
    assert got == [{"tick": 3, "a": 2.675, "b": None}, {"tick": 4, "a": 0.0, "b": 1.0}, {"tick": 5, "a": 1.005, "b": None}]
    assert all(type(r["a"]) is float for r in got)


def test_waiting_rows_are_kept_as_the_bytes_of_their_numbers():
    """A row that waits for the watermark holds eight bytes a number and no names; the feed carries only what is asked for."""
    from trackguard.operators.params import DetectorParams
    from trackguard.streaming import ordered as OR
    names = [f"n{i}" for i in range(30)]
    cars = OR.Cars(DetectorParams(), None, names)
    given = np.array([1.005, np.nan, *range(28)], float)
    (tick, row), = cars.told(iter([pd.DataFrame({"tick": [7], "ts": [pd.Timestamp(0)], "given": [given]})]))
    assert tick == 7 and len(row) == 8 * 30
    assert cars.recalled(tick, row) == {"tick": 7, "n0": 1.005, "n1": None, **{f"n{i + 2}": float(i) for i in range(28)}}


def test_a_feed_carries_what_detections_ask_for(spark):
    from trackguard.operators.params import DetectorParams
    rows = spark.createDataFrame([], "race string, drv string, tick int, t double, x double, y double, speed double, tyre_life double, " + ", ".join(
        f"{c} {'boolean' if c in ('in_pit', 'suspended', 'brake') else 'double'}" for c in ("rel_ratio", "lap_ratio", "lat_off", "in_pit", "suspended", "dspeed_1s", "dspeed_min_2s", "brake", "ref_speed")) + ", track_status string")
    fed = ST.watched(rows, "tyre_life")
    assert set(rows.columns) - set(fed.columns) == {"t", "y"}
    p = DetectorParams()
    plans = [ST.packed(r, p, None)[0].schema for r in (rows, fed)]
    assert plans[0] == plans[1]
