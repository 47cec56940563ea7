"""The two long pipelines: raw samples to features, and features to recommendations.

Tables are written where the stages of the work meet: after alignment, after features, after
detection. Later stages read them with only the columns they need."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from trackguard.operators import alignment as AL, detectors as DE, features as FE, flags as FL, geometry as GE
from trackguard.operators.params import DetectorParams
from trackguard.session import stored


def align_race(car: DataFrame, pos: DataFrame, laps: DataFrame, messages: DataFrame, status: DataFrame, ref: DataFrame,
               sectors: DataFrame, profile: DataFrame, pit: DataFrame, length: float, margin_s: float = 10.0) -> DataFrame:
    """Raw car and position samples of all races on the 250 ms grid, with everything known at each tick."""
    window = AL.race_window(laps, messages)
    pos = AL.valid_positions(pos)
    grid = AL.time_grid(pos, window.withColumn("t_end", F.col("t_end") + margin_s))
    car = car.withColumn("brake", F.col("brake") > 0)
    rows = AL.align(grid, car, ["speed", "throttle", "brake", "gear", "rpm"])
    rows = stored(AL.align(rows, pos, ["x", "y"]))
    rows = GE.project_path(rows, ref, length)
    rows = AL.hold_glitches(rows, F.lit(length))
    rows = GE.near_pit(AL.in_pit(rows, AL.pit_intervals(laps)), pit, ["race"])
    rows = rows.withColumn("in_pit", F.col("in_pit") | F.col("near_pit")).drop("near_pit")
    rows = GE.reference_speed(GE.sector_at(rows, sectors, ["race"]), profile, ["race"], length)
    ticks = grid.select("race", "tick", "t").distinct()
    race = AL.leader_lap(AL.status_at(ticks, status), laps).select("race", "tick", "lap", "track_status")
    return AL.after_chequered(rows.join(race, ["race", "tick"], "left"), window)


def build_features(aligned: DataFrame, laps: DataFrame, weather: DataFrame | None, ref: DataFrame | None, length: float) -> DataFrame:
    """Every feature of the aligned rows: lap and race context first, on narrow rows, then the windows."""
    df = FE.race_context(aligned)
    df = FE.lap_features(FE.weather(df, weather) if weather is not None else df, laps)
    if ref is not None:
        df = FE.reference_point(df, ref, ["race"])
    df = stored(df.withColumn("is_lap1", FE.is_lap1()))
    df = FE.previous_lap(field_rows(df, length), length, positions=df)
    return FE.windows(df)


def field_rows(aligned: DataFrame, length: float) -> DataFrame:
    """Gaps, a row's own features and the state of the field: what the baseline detector needs."""
    return FE.gap_seconds(AL.add_gaps(FE.field_state(FE.per_row(aligned)), length))


@dataclass
class Outcome:
    detections: DataFrame
    recommendations: DataFrame


def watch(features: DataFrame, n_sectors: int, params: DetectorParams | None = None, flags: FL.FlagParams | None = None,
          anomaly_threshold: float | None = None, risk: DataFrame | None = None) -> Outcome:
    """Detections and flag recommendations of all races."""
    dets = stored(DE.detect(features, params, n_sectors, anomaly_threshold))
    return Outcome(dets, FL.recommend(features, dets, flags, risk))
