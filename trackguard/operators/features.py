"""Backward-looking features on the aligned grid. Frames are row counts on the dense 4 Hz grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trackguard.functions.ring import circ, sector_matches
from trackguard.functions.timeline import (CHUNK_TICKS, asof_join, chunk_of, in_chunk, interval_join, own_rows, running,
                                           with_history)
from trackguard.session import is_small

WIN_1S, WIN_2S, WIN_5S = 4, 8, 20
NEUTRAL_STATUS = ["4", "5", "6", "7"]      # SC, red, VSC, VSC ending
CAR = ["race", "drv"]
HISTORY = WIN_1S + WIN_5S                  # the longest chain: a 1 s difference inside a 5 s frame
MAX_STEP_M = 150.0
BUCKET_S = 1024.0


def _frame(n: int, chunk: bool = True):
    return in_chunk(CAR).rowsBetween(-(n - 1), 0)


def _rolling(fn, col: str, n: int, at_least: int) -> Column:
    w = _frame(n)
    return F.when(F.count(col).over(w) >= at_least, fn(col).over(w))


def per_row(df: DataFrame) -> DataFrame:
    """Features of a single row: pace against the reference, line and pedals."""
    ratio = F.col("speed") / F.greatest("ref_speed", F.lit(30.0))
    return df.withColumns({
        "speed_dev": F.col("speed") - F.col("ref_speed"), "speed_ratio": F.when(F.col("ref_speed").isNotNull(), ratio),
        "lat_off_abs": F.abs("lat_off"),
        "brake_throttle": F.coalesce(F.col("brake") & (F.col("throttle") > 10), F.lit(False)).cast("double")})


def gap_seconds(df: DataFrame) -> DataFrame:
    """Gaps to the neighbours in seconds (at 1 m/s or more) and how many are within one second."""
    known, v = F.col("speed").isNotNull(), F.greatest(F.col("speed") / 3.6, F.lit(1.0))
    gap = {c: F.when(known, F.col(f"gap_{c}_m") / v) for c in ("ahead", "behind")}
    near = F.when(gap["ahead"] < 1, 1).otherwise(0) + F.when(gap["behind"] < 1, 1).otherwise(0)
    return df.withColumns({"gap_ahead_s": gap["ahead"], "gap_behind_s": gap["behind"], "cars_within_1s": near})


def field_state(df: DataFrame) -> DataFrame:
    """State of the whole field at each tick, and each car's pace relative to it. One tick of one race
    is one window partition; the gaps, taken after this, reuse its shuffle."""
    w = W.partitionBy("race", "tick")
    live, out_of_pit = F.col("speed").isNotNull(), ~F.col("in_pit")
    placed = F.col("x").isNotNull() if "x" in df.columns else F.lit(True)
    slow = F.when(live & out_of_pit, F.when(F.col("speed") < 30, 1.0).otherwise(0.0))
    df = df.withColumns({
        "field_in_pit": F.avg(F.when(live, F.col("in_pit").cast("double"))).over(w),
        "field_slow": F.coalesce(F.avg(slow).over(w), F.lit(0.0)),
        "field_ratio": F.coalesce(F.percentile(F.when(live & out_of_pit & placed, F.col("speed_ratio")), 0.5).over(w),
                                  F.lit(1.0)),
        "live_share": F.avg(live.cast("double")).over(w)})
    suspended = (F.col("track_status") == "5") | F.coalesce(F.col("field_in_pit") >= 0.5, F.lit(False))
    return df.withColumns({
        "suspended": suspended,
        "rel_ratio": F.col("speed_ratio") / F.least(F.greatest("field_ratio", F.lit(0.2)), F.lit(1.0))})


def windows(df: DataFrame, chunk: int = CHUNK_TICKS) -> DataFrame:
    """All 1 s, 2 s and 5 s backward windows in one pass: one shuffle and one sort for every column.
    Columns whose inputs are absent are left out."""
    have = set(df.columns)
    w = in_chunk(CAR)
    df = with_history(df, HISTORY, chunk)
    first = {"dspeed_1s": F.col("speed") - F.lag("speed", WIN_1S).over(w)}
    if {"gap_ahead_m", "ahead_drv"} <= have:
        closing = F.lag("gap_ahead_m", WIN_1S).over(w) - F.col("gap_ahead_m")
        same = F.col("ahead_drv") == F.lag("ahead_drv", WIN_1S).over(w)
        first["closing_rate"] = F.when(same & (F.abs(closing) <= 100), closing)
    if {"x", "y", "ref_x", "ref_y"} <= have:
        first["heading_err"] = _heading(w)
    df = df.withColumns(first)
    have = set(df.columns)
    spec = [("lat_off_std_2s", F.stddev_samp, "lat_off", WIN_2S, 4),
            ("throttle_std_2s", F.stddev_samp, "throttle", WIN_2S, 4),
            ("ratio_min_2s", F.min, "speed_ratio", WIN_2S, 2), ("dspeed_min_2s", F.min, "dspeed_1s", WIN_2S, 2),
            ("lat_abs_max_2s", F.max, "lat_off_abs", WIN_2S, 2),
            ("brake_throttle_2s", F.avg, "brake_throttle", WIN_2S, 2),
            ("lap_ratio_min_2s", F.min, "lap_ratio", WIN_2S, 2), ("rel_ratio_min_2s", F.min, "rel_ratio", WIN_2S, 2),
            ("rel_ratio_min_5s", F.min, "rel_ratio", WIN_5S, 2), ("lap_ratio_mean_5s", F.avg, "lap_ratio", WIN_5S, 2),
            ("lap_ratio_min_5s", F.min, "lap_ratio", WIN_5S, 2), ("lat_off_std_5s", F.stddev_samp, "lat_off", WIN_5S, 2),
            ("throttle_std_5s", F.stddev_samp, "throttle", WIN_5S, 2),
            ("brake_throttle_5s", F.avg, "brake_throttle", WIN_5S, 2),
            ("dspeed_min_5s", F.min, "dspeed_1s", WIN_5S, 2), ("closing_rate_max_5s", F.max, "closing_rate", WIN_5S, 2),
            ("heading_max_5s", F.max, "heading_err", WIN_5S, 2)]
    df = df.withColumns({name: _rolling(fn, src, n, k) for name, fn, src, n, k in spec if src in have})
    return own_rows(df, chunk)


def _heading(w) -> Column:
    """Angle between the car's path over 1 s and the reference line's path between the same two
    positions, in degrees; NULL when either moved less than 4 m."""
    d = {c: F.col(c) - F.lag(c, WIN_1S).over(w) for c in ("x", "y", "ref_x", "ref_y")}
    moved, ref = F.hypot(d["x"], d["y"]), F.hypot(d["ref_x"], d["ref_y"])
    cos = (d["x"] * d["ref_x"] + d["y"] * d["ref_y"]) / (moved * ref + 1e-9)
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))
    return F.when((moved >= 4.0) & (ref >= 4.0), angle)


def reference_point(df: DataFrame, ref: DataFrame, by: list[str], step: float = 5.0) -> DataFrame:
    """Adds ref_x, ref_y: the last reference point before the car's distance (points every `step` metres)."""
    side = ref.select(*by, F.col("i").alias("_i"), F.col("x").alias("ref_x"), F.col("y").alias("ref_y"))
    at = df.withColumn("_i", F.greatest(F.ceil(F.col("dist") / step) - 1, F.lit(0)).cast("int"))
    at = at.withColumn("_i", F.when(F.col("dist").isNotNull(), F.col("_i")))
    return at.join(F.broadcast(side) if is_small(side) else side, [*by, "_i"], "left").drop("_i")


def race_distance(df: DataFrame, length, chunk: int = CHUNK_TICKS) -> DataFrame:
    """Adds race_dist: metres of forward progress since the car's first sample."""
    df = with_history(df, 1, chunk)
    step = circ(F.col("dist") - F.lag("dist").over(in_chunk(CAR)), length)
    step = F.when((step > 0) & (step < MAX_STEP_M), step).otherwise(0.0)
    df = own_rows(df.withColumn("_step", step), chunk, keep_chunk=True)
    return running(df, CAR, F.col("_chunk"), ["tick"], sums={"race_dist": F.col("_step")}).drop("_step", "_chunk")


def previous_lap(df: DataFrame, length: float, bucket_m: float = 50_000.0, positions: DataFrame | None = None) -> DataFrame:
    """Adds race_dist, prev_lap_speed (the car's speed one lap of forward progress ago, interpolated between
    the two samples around that point) and lap_ratio. Only samples already passed can be hit.

    Only (race, drv, tick, dist, speed) go along the line, and what they find is joined back to the rows by car and tick (one row
    each). `positions` names a cheaper source of those columns than `df` itself. Every position appears twice along the car's race
    distance: as a sample where it is, and as a question one lap behind; the question takes the samples before and after it."""
    thin = race_distance((df if positions is None else positions).select(*CAR, "tick", "dist", "speed"), length)
    known = F.col("speed").isNotNull() & F.col("dist").isNotNull()
    sample = F.when(known, F.struct(F.col("race_dist").alias("d"), F.col("speed").alias("v")))
    where = F.array(F.struct(F.col("race_dist").alias("pos"), F.lit(0).alias("side")),
                    F.struct((F.col("race_dist") - length).alias("pos"), F.lit(1).alias("side")))
    line = thin.withColumn("_s", sample).withColumn("_e", F.explode(where)).select(*CAR, "tick", "race_dist", "_s", "_e.*").filter("side = 1 or _s is not null")
    here = F.when(F.col("side") == 0, F.col("_s"))
    line = running(line, CAR, chunk_of("pos", bucket_m), ["pos", "side", "tick"], lasts={"a": here}, nexts={"z": here})
    at = F.col("pos") - F.col("a.d")
    slope = (F.col("z.v") - F.col("a.v")) / (F.col("z.d") - F.col("a.d"))
    prev = F.when(F.col("z").isNotNull(), slope * at + F.col("a.v")).otherwise(F.col("a.v"))
    found = line.filter("side = 1").select(*CAR, "tick", "race_dist", F.when(F.col("a").isNotNull(), prev).alias("prev_lap_speed"))
    ratio = F.least(F.col("speed") / F.greatest("prev_lap_speed", F.lit(20.0)), F.lit(1.1))
    both_known = F.col("speed").isNotNull() & F.col("prev_lap_speed").isNotNull()
    return df.join(found, [*CAR, "tick"]).withColumn("lap_ratio", F.when(both_known, ratio))


def lap_features(df: DataFrame, laps: DataFrame) -> DataFrame:
    """What is known of the car's laps at t, in one pass over its time line:

    as of a lap's start  drv_lap, compound, tyre_life, stint, laps_since_pit
    as of a lap's end    last_lap_delta, that lap's time against the median of the three before it
    """
    first = laps.groupBy(*CAR, "stint").agg(F.min("lap").alias("_first"))
    begun = laps.filter("t_start is not null").join(first, [*CAR, "stint"], "left")
    info = F.struct(F.col("lap").alias("drv_lap"), "compound", "tyre_life", "stint", (F.col("lap") - F.col("_first")).alias("laps_since_pit"))
    # three earlier laps at most: the history is counted in laps of one car
    done = laps.filter("lap_s is not null and t_end is not null")
    w = W.partitionBy(*CAR, "_chunk").orderBy("lap").rowsBetween(-3, -1)
    done = with_history(done, 8, 64, "lap").withColumn("_med", F.percentile("lap_s", 0.5).over(w))
    done = own_rows(done, 64, "lap")
    delta = F.struct((F.try_divide("lap_s", "_med") - 1).alias("last_lap_delta"))
    df = df.drop("drv_lap", "compound", "tyre_life", "stint", "laps_since_pit", "last_lap_delta")
    keep = [c for c in df.columns if c not in CAR]
    rows = df.select(*CAR, F.col("t").alias("_t"), F.lit(1).alias("_side"), F.lit(0).alias("_lap"), F.struct(*keep).alias("_row"))
    rows = rows.unionByName(begun.select(*CAR, F.col("t_start").alias("_t"), F.lit(0).alias("_side"), F.col("lap").alias("_lap"),
                                         info.alias("_info")), allowMissingColumns=True)
    rows = rows.unionByName(done.select(*CAR, F.col("t_end").alias("_t"), F.lit(0).alias("_side"), F.col("lap").alias("_lap"),
                                        delta.alias("_done")), allowMissingColumns=True)
    rows = running(rows, CAR, chunk_of("_t", BUCKET_S), ["_t", "_side", "_lap"], lasts={"_i": F.col("_info"), "_d": F.col("_done")})
    out = rows.filter("_side = 1").select(*CAR, "_row.*", "_i.*", "_d.*")
    return out.withColumn("compound", F.coalesce("compound", F.lit("UNKNOWN")))


def weather(df: DataFrame, samples: DataFrame) -> DataFrame:
    """Latest weather of the race, looked up once per tick."""
    cols = ["air_temp", "track_temp", "rainfall"]
    ticks = df.groupBy("race", "tick").agg(F.first("t").alias("t"))
    now = asof_join(ticks, samples, ["race"], "t", "t", cols, BUCKET_S).select("race", "tick", *cols)
    return df.join(F.broadcast(now) if is_small(now) else now, ["race", "tick"], "left")


def race_context(df: DataFrame, chunk: int = CHUNK_TICKS) -> DataFrame:
    """Adds t_since_restart: seconds since the last neutralisation ended."""
    ticks = df.groupBy("race", "tick").agg(F.first("t").alias("t"), F.min("track_status").alias("_st"))
    neutral = F.col("_st").isin(NEUTRAL_STATUS)
    ticks = with_history(ticks, 1, chunk)
    ended = F.lag(neutral).over(in_chunk(["race"])) & ~neutral
    ticks = own_rows(ticks.withColumn("_end", F.when(ended, F.col("t"))), chunk, keep_chunk=True)
    ticks = running(ticks, ["race"], F.col("_chunk"), ["tick"], lasts={"_end": F.col("_end")})
    ticks = ticks.select("race", "tick", (F.col("t") - F.col("_end")).alias("t_since_restart"))
    return df.join(F.broadcast(ticks) if is_small(ticks) else ticks, ["race", "tick"], "left")


def is_lap1() -> Column:
    return F.when(F.col("drv_lap") == 1, 1).otherwise(0)


def profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, min and max of each column, one row per column."""
    items = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"),
                      F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")) for c in cols]
    return df.agg(F.array(*items).alias("_a")).select(F.explode("_a").alias("_r")).select("_r.*")


def flag_alignment(df: DataFrame, official: DataFrame, n_sectors: int) -> DataFrame:
    """Per race: official sector yellows in normal running, and how many had a slow car in a
    matching sector from 20 s before to 2 s after."""
    ticks = df.groupBy("race", "tick").agg(F.first("t").alias("t"), F.min("track_status").alias("_st"),
                                           F.first("suspended").alias("_su"), F.first("field_slow").alias("_fs"))
    calls = (official.filter(F.col("flag").isin("YELLOW", "DOUBLE_YELLOW") & F.col("msector").isNotNull())
             .select("race", F.col("event_id").alias("call"), F.col("t").alias("t_call"), F.col("msector").alias("flagged")))
    state = asof_join(calls, ticks, ["race"], "t_call", "t", ["_st", "_su", "_fs"], BUCKET_S, max_stale=1.0)
    normal = state.filter(F.col("_st").isNotNull() & ~F.col("_st").isin(NEUTRAL_STATUS) & ~F.col("_su") & (F.col("_fs") < 0.5))
    # one row per race, time and sector, however many cars were slow there
    slow = df.filter((F.col("speed_ratio") < 0.6) & ~F.col("in_pit") & (F.col("msector") > 0)).select("race", "t", "msector").distinct()
    near = interval_join(slow, normal.withColumns({"lo": F.col("t_call") - 20, "hi": F.col("t_call") + 2}), ["race"], "t",
                         "lo", "hi", 64.0, extra=sector_matches("msector", "flagged", n_sectors))
    hit = near.select("race", "call").distinct().withColumn("_hit", F.lit(1))
    return (normal.join(hit, ["race", "call"], "left").groupBy("race")
            .agg(F.count("_hit").alias("hits"), F.count(F.lit(1)).alias("total")))
