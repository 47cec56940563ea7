"""Race-wide context of each tick: when detectors rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trackguard.functions.timeline import CHUNK_TICKS, in_chunk, own_rows, with_history
from trackguard.operators.params import DetectorParams

TICKS_PER_S = 4


def race_gates(df: DataFrame, p: DetectorParams | None = None, chunk: int = CHUNK_TICKS) -> DataFrame:
    """One row per (race, tick) before the chequered flag: suspended, neutral, live_share and grid.

    grid holds for `grid_hold_s` after the field crawled, and, after a suspension of at least
    `resume_min_susp_s`, until the field forms up, at most `resume_max_s`. Everything looks back a
    bounded time, so one window over chunks with that much history gives it.
    """
    p = p or DetectorParams()
    hold, resume = int(p.grid_hold_s * TICKS_PER_S), int(p.resume_max_s * TICKS_PER_S)
    need = int(p.resume_min_susp_s * TICKS_PER_S)
    if "after_chequered" in df.columns:
        df = df.filter(~F.col("after_chequered"))
    first = [F.first(c).alias(c) for c in ("t", "track_status", "suspended", "field_slow", "field_ratio")]
    ticks = df.groupBy("race", "tick").agg(*first, F.avg(F.col("speed").isNotNull().cast("double")).alias("live_share"))
    ticks = with_history(ticks, resume + need + hold + 2, chunk)
    w = in_chunk(["race"])
    pos = F.col("tick")
    running = ~F.col("suspended")
    # ticks since the last running tick: a suspension ends here after that long
    last_run = F.max(F.when(running, pos)).over(w.rowsBetween(-need - 2, -1))
    susp_start = F.min(F.when(F.col("suspended"), pos)).over(w.rowsBetween(-need - 1, -1))
    ended = running & F.lag("suspended").over(w)
    long_enough = F.coalesce(last_run + 1, susp_start) <= pos - need
    ticks = ticks.withColumn("_resume", F.when(ended & F.coalesce(long_enough, F.lit(False)), pos))
    crawl = running & ((F.col("field_slow") >= p.grid_field_slow) | (F.col("field_ratio") < p.grid_field_ratio))
    upto = w.rangeBetween(-resume - hold - 1, 0)
    ticks = ticks.withColumns({"_crawl": F.max(F.when(crawl, pos)).over(upto), "_resumed": F.max("_resume").over(upto)})
    held = F.coalesce(pos < F.col("_crawl") + hold, F.lit(False))
    forming = F.coalesce((F.col("_resumed") > F.coalesce("_crawl", F.lit(-1))) & (pos < F.col("_resumed") + resume), F.lit(False))
    ticks = ticks.withColumn("grid", running & (held | forming))
    ticks = own_rows(ticks, chunk).withColumn("neutral", F.col("track_status").isin("4", "6", "7"))
    return ticks.select("race", "tick", "t", "track_status", "suspended", "neutral", "field_slow", "field_ratio",
                        "live_share", "grid")
