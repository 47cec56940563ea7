"""Raw samples, laps and messages aligned on one 250 ms grid. A value at t uses samples at or before t."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trackguard.functions.ring import circ
from trackguard.functions.timeline import CHUNK_TICKS, asof_join, chunk_of, in_chunk, own_rows, running, with_history

TICKS_PER_S = 4
MAX_STALE_S = 1.0
POS_SCALE = 0.1
GLITCH_BACK_M = 2.0
GLITCH_MIN_KMH = 30.0
BUCKET_S = 1024.0
CAR = ["race", "drv"]


def valid_positions(pos: DataFrame) -> DataFrame:
    """Without the x = y = z = 0 placeholders of a lost car, in metres."""
    lost = (F.col("x") == 0) & (F.col("y") == 0) & (F.col("z") == 0)
    return pos.filter(~lost).withColumns({c: F.col(c) * POS_SCALE for c in ("x", "y", "z")})


def session_seconds(ts: Column, t0: Column) -> Column:
    """Wall time to seconds since the session's zero."""
    return (F.unix_micros(ts) - F.unix_micros(t0)) / F.lit(1e6)


def time_grid(samples: DataFrame, window: DataFrame | None = None, chunk: int = CHUNK_TICKS) -> DataFrame:
    """Every (race, drv, tick) from the race's first to its last sample, cut to the race window
    (race, t_start, t_end), the end not included. Chunks of ticks are listed first and spread
    over the cluster, then each is filled."""
    span = samples.groupBy("race").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    if window is not None:
        span = (span.join(window, "race", "left")
                .select("race", F.greatest("lo", "t_start").alias("lo"), F.least("hi", "t_end").alias("hi")))
    span = span.select("race", F.ceil(F.col("lo") * TICKS_PER_S).cast("bigint").alias("a"),
                       (F.ceil(F.col("hi") * TICKS_PER_S) - 1).cast("bigint").alias("b")).filter("a <= b")
    cars = samples.select("race", "drv").distinct()
    chunks = cars.join(span, "race").withColumn(
        "_c", F.explode(F.sequence(chunk_of("a", chunk), chunk_of("b", chunk))))
    first, last = F.greatest("a", F.col("_c") * chunk), F.least("b", F.col("_c") * chunk + (chunk - 1))
    return (chunks.repartition("race", "drv", "_c")
            .withColumn("tick", F.explode(F.sequence(first, last)))
            .select("race", "drv", F.col("tick").cast("int").alias("tick"),
                    (F.col("tick") / F.lit(TICKS_PER_S)).cast("double").alias("t")))


def align(grid: DataFrame, samples: DataFrame, values: list[str], max_stale: float = MAX_STALE_S,
          bucket: float = BUCKET_S) -> DataFrame:
    """Latest sample of each car at every grid tick, NULL when older than `max_stale`."""
    return asof_join(grid, samples, CAR, "t", "t", values, bucket, max_stale)


def race_window(laps: DataFrame, messages: DataFrame) -> DataFrame:
    """(race, t_start, t_end): lights out to the first chequered flag, else the last lap end."""
    start = laps.groupBy("race").agg(F.min(F.when(F.col("lap") == 1, F.col("t_start"))).alias("t_start"),
                                     F.max("t_end").alias("_last"))
    flag = F.upper("message").contains("CHEQUERED FLAG")
    end = messages.groupBy("race").agg(F.min(F.when(flag, F.col("t"))).alias("_flag"))
    return start.join(end, "race", "left").select("race", "t_start", F.coalesce("_flag", "_last").alias("t_end"))


def pit_intervals(laps: DataFrame) -> DataFrame:
    """(race, drv, pit_in, pit_out): each pit entry with the first exit after it, in lap order; NULL when there is none."""
    ins = laps.filter("pit_in is not null").select(*CAR, F.col("pit_in").alias("t"), "pit_in")
    outs = laps.filter("pit_out is not null").select(*CAR, (-F.col("pit_out")).alias("_neg"), "pit_out")
    ins = ins.withColumn("_neg", -F.col("t") - F.lit(1e-9))
    hit = asof_join(ins, outs, CAR, "_neg", "_neg", ["pit_out"], bucket=4 * BUCKET_S)
    return hit.select(*CAR, "pit_in", "pit_out")


def in_pit(grid: DataFrame, intervals: DataFrame) -> DataFrame:
    """Adds in_pit. Only the latest pit entry can still be open: an earlier one has the same exit or an earlier one."""
    hit = asof_join(grid, intervals.withColumn("_in", F.col("pit_in")), CAR, "t", "_in", ["pit_in", "pit_out"], BUCKET_S)
    inside = F.col("pit_in").isNotNull() & (F.col("pit_out").isNull() | (F.col("t") < F.col("pit_out")))
    return hit.withColumn("in_pit", inside).drop("pit_in", "pit_out")


def leader_lap(ticks: DataFrame, laps: DataFrame) -> DataFrame:
    """Adds lap: the highest lap any car has started by t, 1 before the first."""
    starts = laps.filter("t_start is not null").select("race", "t_start", "lap")
    best = running(starts, ["race"], chunk_of("t_start", BUCKET_S), ["t_start", "lap"], maxs={"lap": F.col("lap")})
    out = asof_join(ticks, best, ["race"], "t", "t_start", ["lap"], BUCKET_S, tie=["lap"])
    return out.withColumn("lap", F.coalesce("lap", F.lit(1)))


def status_at(ticks: DataFrame, changes: DataFrame) -> DataFrame:
    """Adds track_status as of t, "1" before the first change."""
    out = asof_join(ticks, changes, ["race"], "t", "t", ["track_status"], BUCKET_S)
    return out.withColumn("track_status", F.coalesce("track_status", F.lit("1")))


def hold_glitches(df: DataFrame, length, cols=("x", "y", "dist", "lat_off"), passes: int = 3,
                  chunk: int = CHUNK_TICKS) -> DataFrame:
    """A car at speed cannot move backwards: such samples keep the previous position, up to three in a row."""
    w = in_chunk(CAR)
    df = with_history(df, passes, chunk)
    cols = [c for c in cols if c in df.columns]
    for _ in range(passes):
        back = circ(F.col("dist") - F.lag("dist").over(w), length) < -GLITCH_BACK_M
        bad = F.coalesce(back & (F.col("speed") > GLITCH_MIN_KMH), F.lit(False))
        df = df.withColumns({c: F.when(bad, F.lag(c).over(w)).otherwise(F.col(c)) for c in cols})
    return own_rows(df, chunk)


def add_gaps(df: DataFrame, length) -> DataFrame:
    """Metres to the next car on track ahead and behind, and the car ahead; NULL with fewer than 2 cars.
    One tick of one race is one partition, so its size is the number of cars."""
    length = F.lit(length) if not isinstance(length, Column) else length
    on = F.col("dist").isNotNull() & ~F.col("in_pit")
    spec = W.partitionBy("race", "tick", "_on").orderBy("dist", "drv")
    whole = spec.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    df = df.withColumn("_on", on)
    ahead = F.coalesce(F.lead("dist").over(spec), F.first("dist").over(whole))
    ahead_drv = F.coalesce(F.lead("drv").over(spec), F.first("drv").over(whole))
    behind = F.coalesce(F.lag("dist").over(spec), F.last("dist").over(whole))
    ok = F.col("_on") & (F.count(F.lit(1)).over(whole) >= 2)
    return df.withColumns({
        "gap_ahead_m": F.when(ok, F.pmod(ahead - F.col("dist"), length)),
        "gap_behind_m": F.when(ok, F.pmod(F.col("dist") - behind, length)),
        "ahead_drv": F.when(ok, ahead_drv)}).drop("_on")


def classify(category: Column, message: Column, flag: Column) -> Column:
    """Flag of a race control message; NULL for the ones that are no incident flag."""
    text, name = F.upper(F.coalesce(message, F.lit(""))), F.upper(F.coalesce(flag, F.lit("")))
    deployed = text.contains("DEPLOYED") & ~text.contains("ENDING")
    virtual = text.contains("VIRTUAL") | text.rlike(r"\bVSC\b")
    safety = F.when(deployed & virtual, "VSC").when(deployed, "SC")
    plain = F.when(name.isin("YELLOW", "RED", "CLEAR"), name).when(name == "DOUBLE YELLOW", "DOUBLE_YELLOW")
    return F.when(F.coalesce(category == "SafetyCar", F.lit(False)), safety).otherwise(plain)


def drivers_in(message: Column) -> Column:
    """Car numbers a message names."""
    return F.concat(F.regexp_extract_all(message, F.lit(r"CARS? (\d+)")),
                    F.regexp_extract_all(message, F.lit(r"AND (\d+) \(")))


def official_events(messages: DataFrame) -> DataFrame:
    """Race control messages (race, t, category, message, flag, scope, sector, car) kept as official events."""
    named = F.when(F.col("car").isNotNull(), F.array(F.col("car").cast("string"))).otherwise(
        drivers_in(F.coalesce("message", F.lit(""))))
    return (messages.withColumn("flag", classify(F.col("category"), F.col("message"), F.col("flag")))
            .filter("flag is not null")
            .select("race", F.round("t", 2).alias("t"), "category", "message", "flag",
                    F.coalesce("scope", F.lit("Track")).alias("scope"), F.col("sector").cast("int").alias("msector"),
                    named.alias("drivers")))


def is_live() -> Column:
    """A row fit for the tick stream: every channel has a value."""
    ok = F.lit(True)
    for c in ("x", "y", "speed", "dist", "gear", "rpm"):
        ok = ok & F.col(c).isNotNull()
    return ok


def ticks_nested(df: DataFrame) -> DataFrame:
    """One row per (race, tick) holding its live cars; unknown numbers become -1."""
    def num(c: str, nd: int) -> Column:
        return F.coalesce(F.round(c, nd), F.lit(-1.0)).alias(c)
    car = F.struct(F.col("drv"), num("x", 1), num("y", 1), num("dist", 1), num("lat_off", 2), num("speed", 1),
                   num("throttle", 1), F.col("brake").cast("boolean").alias("brake"), F.col("gear").cast("int").alias("gear"),
                   F.col("rpm").cast("int").alias("rpm"), F.col("msector"), num("gap_ahead_m", 1), F.col("in_pit"))
    return (df.groupBy("race", "tick").agg(
        F.round(F.first("t"), 2).alias("t"), F.first("lap").alias("lap"), F.first("track_status").alias("track_status"),
        F.array_sort(F.collect_list(F.when(is_live(), car))).alias("cars")))


def after_chequered(df: DataFrame, window: DataFrame) -> DataFrame:
    """Adds after_chequered: the tick lies past the chequered flag."""
    return (df.join(window.select("race", "t_end"), "race", "left")
            .withColumn("after_chequered", F.coalesce(F.col("t") > F.col("t_end"), F.lit(False))).drop("t_end"))


def entry_list(df: DataFrame) -> DataFrame:
    """Every car of each race with its place in numeric car order."""
    cars = df.select("race", "drv").distinct()
    number = F.expr("try_cast(drv AS int)")
    place = F.row_number().over(W.partitionBy("race").orderBy(number.isNull(), F.coalesce(number, F.lit(0)), "drv"))
    return cars.withColumn("place", place)
