"""Structured Streaming: ticks in, detections, forecasts and flags out.

The tick source is ordered in time (a replay, or one topic partition per race). Inside a micro-batch
rows arrive in any order, so every batch is sorted by tick; a row at or before the last tick of its
key is late and dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trackguard.operators.detectors import DETECTED, car_step, conditions
from trackguard.operators.flags import Control, FlagParams, control_rows
from trackguard.operators.params import DetectorParams
from trackguard.streaming.marks import CARRIED, mark
from trackguard.streaming.seek import kept_marks

CAR = ["race", "drv"]
DETECTION = f"race string, drv string, {DETECTED}"
REC = "race string, tick int, t double, msector int, flag string, confidence double, reason string, message string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tick_source(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Feature rows as a stream: files in the order they were written."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def records(frames: Iterator[pd.DataFrame], order: list[str]) -> list[dict]:
    """One key's rows of a micro-batch in time order, missing values as None."""
    rows = []
    for frame in frames:          # column by column: a key has few rows, and whole-frame operations cost the same for one row as for many
        columns = [[None if v is pd.NaT or (isinstance(v, float) and v != v) else v for v in frame[c].tolist()] for c in frame.columns]
        rows += [dict(zip(frame.columns, r)) for r in zip(*columns)]
    return sorted(rows, key=lambda r: [(r[c] is None, r[c]) for c in order])


def watched(ticks: DataFrame, *more: str) -> DataFrame:
    """The columns that detections ask for, and `more` of those a stream has: what a feed of ticks carries."""
    asked = {*CAR, "tick", *CARRIED, "x", "track_status", "dspeed_min_2s", "after_chequered", *more}
    return ticks.select(*[c for c in ticks.columns if c in asked])


def packed(ticks: DataFrame, p: DetectorParams, threshold: float | None, *more: str) -> tuple[DataFrame, list[str]]:
    """What a car's step asks of each row as one column of numbers (a key's rows become a frame of their own, and what that costs are its
    columns), and the names of these numbers."""
    if "after_chequered" in ticks.columns:
        ticks = ticks.filter(~F.col("after_chequered"))
    absent = F.lit(None)
    given = {**{c: F.col(c) if c in ticks.columns else absent for c in CARRIED}, **conditions(ticks.columns, p, threshold)}
    return ticks.select(*CAR, "tick", *more, F.array(*[c.cast("double") for c in given.values()]).alias("given")), list(given)


def named(tick: int, given, names: list[str]) -> dict:
    """A row from the numbers of `packed`, missing values as None. Numbers are Python's own, as in the batch: numpy rounds otherwise."""
    return {"tick": tick, **{n: None if v != v else v for n, v in zip(names, np.asarray(given, float).tolist())}}


def unpacked(frames: Iterator[pd.DataFrame], names: list[str]) -> list[dict]:
    """One key's rows of a micro-batch in time order."""
    rows = [named(t, given, names) for frame in frames for t, given in zip(frame["tick"].tolist(), frame["given"].tolist())]
    return sorted(rows, key=lambda r: r["tick"])


class CarProcessor(StatefulProcessor):
    """Detections of one car: rows are marked one by one and go through the batch's step."""

    def __init__(self, params: DetectorParams, threshold: float | None, names: list[str]) -> None:
        self.params, self.threshold, self.names = params, threshold, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("car", "json string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.state.update((json.dumps(kept_marks(json.loads(initialState["state"].iloc[0]))),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get()             # one call of the state server instead of two: what a car costs are these calls
        kept = json.loads(held[0]) if held else {"tick": None, "marks": {}, "step": {}}
        marked = []
        for r in unpacked(rows, self.names):
            if kept["tick"] is None or r["tick"] > kept["tick"]:
                kept["tick"] = int(r["tick"])
                marked.append(mark(kept["marks"], r, self.params))
        kept["step"], made = car_step(self.params, self.threshold)(kept["step"], marked) if marked else (kept["step"], [])
        self.state.update((json.dumps(kept, default=float),))
        if made:
            names = [c.split()[0] for c in DETECTED.split(", ")]
            yield pd.DataFrame([(*key, *(m[n] for n in names)) for m in made], columns=[*CAR, *names])

    def close(self) -> None:
        pass


def detect_stream(ticks: DataFrame, params: DetectorParams | None = None, threshold: float | None = None, at: int | None = None,
                  states: DataFrame | None = None) -> DataFrame:
    """Detections of every car as its ticks arrive. The state is one small record per car, and a restart goes on from the checkpoint. A
    seek is a new query from the tick `at` on that begins with the `states` of `seek.car_state`."""
    ticks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    p = params or DetectorParams()
    rows, names = packed(ticks, p, threshold)
    rows = rows if at is None else rows.filter(F.col("tick") >= at)
    begin = None if states is None else states.groupBy(*CAR)
    return rows.groupBy(*CAR).transformWithStateInPandas(CarProcessor(p, threshold, names), outputStructType=DETECTION, outputMode="append", timeMode="None",
                                                         initialState=begin)


class FlagProcessor(StatefulProcessor):
    """Flag recommendations of one race, from the rows of `flag_rows`."""

    def __init__(self, params: FlagParams) -> None:
        self.params = params

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("control", "json string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = json.loads(self.state.get()[0]) if self.state.exists() else {}
        control, epoch, made = self.wake(kept), kept.get("epoch"), []

        def take() -> None:
            made.extend((key[0], round(m["t"] * 4), m["t"], m["msector"], m["flag"], m["confidence"], m["reason"], m["message"]) for m in control.made if m["flag"])
            control.made = []
        for r in records(rows, ["tick", "kind", "seq", "drv"]):
            if r["epoch"] != epoch:                     # a jump in time wipes the flags
                control.run_to(control.last)
                take()
                control, epoch = self.wake({}), int(r["epoch"])
            control.row(r)
            take()
        control.run_to(control.last)
        take()
        self.state.update((json.dumps({"state": control.state(control.now), "cars": control.cars, "epoch": epoch, **{n: getattr(control, n) for n in self.CLOCK}}, default=float),))
        yield pd.DataFrame(made, columns=["race", "tick", "t", "msector", "flag", "confidence", "reason", "message"])

    CLOCK = ("now", "tick", "last", "status", "lap", "laps")

    def wake(self, kept: dict) -> Control:
        control = Control(self.params, kept.get("state", {}), kept.get("cars"))
        for n in self.CLOCK:
            if n in kept:
                setattr(control, n, kept[n])
        return control

    def close(self) -> None:
        pass


def flag_rows(df: DataFrame, dets: DataFrame, params: FlagParams | None = None, risk: DataFrame | None = None) -> DataFrame:
    """What flags are called from, as one ordered stream: changes of the named cars (with their risk), ticks, and requests. A race sends a
    row per tick and a few per incident, not its field."""
    rows = control_rows(df, dets, [params or FlagParams()], risk, run_ticks=1)
    return rows.filter("kind >= 0").drop("variant")


def flag_stream(rows: DataFrame, params: FlagParams | None = None) -> DataFrame:
    """Flag recommendations as rows of `flag_rows` arrive."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return rows.groupBy("race").transformWithStateInPandas(
        FlagProcessor(params or FlagParams()), outputStructType=REC, outputMode="append", timeMode="None")


def incident_stream(official: DataFrame, gap: str = "60 seconds 1 millisecond", delay: str = "10 seconds") -> DataFrame:
    """Official flags (race, ts, flag, msector) grouped by pauses, emitted once a pause is over."""
    rows = official.filter("flag <> 'CLEAR'").withWatermark("ts", delay)
    return rows.groupBy("race", F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.array_join(F.array_sort(F.collect_set("flag")), " ").alias("flags"), F.min("ts").alias("ts_first"),
        F.max("ts").alias("ts_last")).drop("w")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over everything its source holds and writes the result to a folder."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
    q.awaitTermination()
