"""What a viewer sees at a moment: cars out of the race, stoppages, states, leads, the exposure clock, calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from trackguard.functions.ring import near_sector, sector_matches
from trackguard.functions.timeline import CHUNK_TICKS, asof_join, chunk_of, gap_islands, interval_join, numbered, running
from trackguard.session import stored

CAR = ["race", "drv"]
MOVE_KMH, OUT_AFTER_S, STOPPAGE_MIN_S = 20.0, 60.0, 60.0
STILL_M, STOPPED_AFTER_S = 3.0, 3.0
INCIDENT_GAP_S, ESCALATION_LOOKBACK_S, MATCH_BEFORE_S, MATCH_AFTER_S = 60.0, 120.0, 60.0, 10.0
MIN_LEAD_S, CONFIRM_WINDOW_S = 0.05, 120.0
RANKS = {"CLEAR": 0, "YELLOW": 1, "DOUBLE_YELLOW": 2, "VSC": 1, "SC": 2, "RED": 3}
TRACK, WIDE = "TRACK", ("VSC", "SC", "RED")
BUCKET_S = 1024.0
# fixed values: bin of the speed memory (m), samples the field's pace keeps and needs, and the speed below which a car is no reference
BIN_M, FIELD_KEPT, FIELD_LEAST, FIELD_MIN_KMH = 50.0, 40, 3, 60.0


def stop_ticks(df: DataFrame) -> DataFrame:
    """(race, t, on_track): ticks at which the whole field stood; `on_track` when most of it stood on the track."""
    ticks = df.groupBy("race", "tick").agg(F.first("t").alias("t"), F.first("suspended").alias("_su"),
                                           F.coalesce(F.first("field_slow"), F.lit(0.0)).alias("_fs"),
                                           F.coalesce(F.first("field_in_pit"), F.lit(0.0)).alias("_fp"))
    slow = F.col("_fs") >= 0.5
    on = slow & (F.col("_fp") < 0.5) & ~F.col("_su")
    return ticks.filter(F.col("_su") | slow).select("race", "tick", "t", on.alias("on_track"))


def out_spans(df: DataFrame, out_after: float = OUT_AFTER_S, chunk: int = CHUNK_TICKS) -> DataFrame:
    """(race, drv, why, since, msector, t0, t1, first): when each car counts as out, from t0 up to but without t1 (NULL: to the end).

    One row per silence of at least `out_after`, per stretch in which a standing car has been passed by a moving field for that long, and
    per car before its first data. A silence counts once the race itself has data `out_after` beyond its begin (`first`)."""
    live = df.filter("speed is not null" + (" and x is not null" if "x" in df.columns else ""))
    rows = live.select(*CAR, "tick", "t", "speed", "in_pit", "msector").withColumn("_chunk", chunk_of("tick", chunk))
    rows = running(rows, CAR, F.col("_chunk"), ["tick"], starts={"_still": F.col("speed") < MOVE_KMH}, nexts={"_next": F.col("t")})
    state = F.struct("_still", "in_pit", "msector")
    new = ~state.eqNullSafe(F.lag(state).over(W.partitionBy(*CAR, "_chunk").orderBy("tick")))
    silent = F.col("_next").isNull() | (F.col("_next") - F.col("t") >= out_after)
    # a state holds until the next change; one more cut where a chunk begins does no harm
    few = stored(rows.withColumns({"_new": new, "_silent": silent}).filter("_new or _silent").withColumn("since", F.col("_still") / F.lit(4.0)))
    cars = df.groupBy(*CAR).agg(F.min("t").alias("_from"))
    start = cars.groupBy("race").agg(F.min("_from").alias("first"))
    unseen = cars.select(*CAR).join(few.groupBy(*CAR).agg(F.min("t").alias("t1")), CAR, "left").join(start, "race").select(
        *CAR, F.lit("no data").alias("why"), F.lit(None).cast("double").alias("since"), F.lit(None).cast(few.schema["msector"].dataType).alias("msector"),
        F.col("first").alias("t0"), "t1", (F.col("first") + out_after).alias("first"))
    silences = few.filter("_silent").select(*CAR, F.lit("no data").alias("why"), F.col("t").alias("since"), "msector", F.col("t").alias("t0"),
                                            F.col("_next").alias("t1"), (F.col("t") + out_after).alias("first"))
    spans = running(few.filter("_new").drop("_next"), CAR, chunk_of("tick", chunk), ["tick"], nexts={"t1": F.col("t")}).filter("since is not null")
    spans = spans.withColumn("_pit", F.coalesce("in_pit", F.lit(False)))
    begun = passed_from(spans.select(*CAR, "since", "_pit").distinct(), df, out_after)
    stands = spans.join(begun, [*CAR, "since", "_pit"]).select(
        *CAR, F.when(F.col("_pit"), "in the pit lane").otherwise("stopped").alias("why"), "since", "msector",
        F.greatest("t", "_out").alias("t0"), "t1", F.lit(None).cast("double").alias("first"))
    return unseen.unionByName(silences).unionByName(stands).filter("t1 is null or t0 < t1")


def passed_from(runs: DataFrame, df: DataFrame, out_after: float) -> DataFrame:
    """Adds _out to runs of standing (race, drv, since, _pit): when the field has moved for `out_after` without a stop since then. For a car
    in the pits every stop of the field counts as one, for others a stop on the track."""
    stops = stop_ticks(df).select("race", "t", F.explode(F.when(F.col("on_track"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("_pit"))
    key, at = ["race", "_pit"], lambda: chunk_of("t", BUCKET_S)
    stops = running(stops, key, at(), ["t"], nexts={"_then": F.col("t")})
    stops = stops.withColumns({"_stop": F.col("t"), "_free": F.when(F.col("_then").isNull() | (F.col("_then") - F.col("t") >= out_after), F.col("t"))})
    both = runs.withColumnRenamed("since", "t").unionByName(stops.drop("_then"), allowMissingColumns=True).withColumn("_side", F.col("drv").isNull().cast("int"))
    both = running(both, key, at(), ["t", "_side", "drv"], nexts={"_first": F.col("_stop"), "_later": F.col("_free")}).filter("_side = 0")
    at_once = F.col("_first").isNull() | (F.col("_first") - F.col("t") >= out_after)
    return both.select(*CAR, F.col("t").alias("since"), "_pit", (F.when(at_once, F.col("t")).otherwise(F.col("_later")) + out_after).alias("_out"))


def cars_out(df: DataFrame, at: DataFrame, out_after: float = OUT_AFTER_S) -> DataFrame:
    """Cars out of the race at each asked time (race, t_at): no data for a while, or standing still
    for a while of time in which the field moved. Times meet the spans in which a car is out, so the cost is that of spans and answers."""
    live = df.filter("speed is not null" + (" and x is not null" if "x" in df.columns else ""))
    asked = at.select("race", "t_at").distinct()
    asked = asof_join(asked.withColumn("_q", F.col("t_at")), live.groupBy("race", "tick").agg(F.first("t").alias("now")),
                      ["race"], "_q", "now", ["now"], BUCKET_S).withColumn("now", F.coalesce("now", "t_at"))
    last = asked.groupBy("race").agg(F.max("t_at").alias("_last"))
    spans = out_spans(df, out_after).join(last, "race").withColumn("t1", F.coalesce("t1", F.greatest("_last", "t0") + 1.0)).drop("_last")
    hits = interval_join(asked.select("race", "t_at", "now"), spans, ["race"], "t_at", "t0", "t1", BUCKET_S, closed=False,
                         extra=F.col("first").isNull() | (F.col("now") >= F.col("first")))
    # missing data come before standing
    found = hits.groupBy("race", "t_at", "drv").agg(F.min(F.struct(F.when(F.col("why") == "no data", 0).otherwise(1).alias("p"), "why", "since", "msector")).alias("s"))
    return found.select("race", "t_at", "drv", "s.why", "s.since", "s.msector")


def stoppages(df: DataFrame, t_at: float | None = None, min_s: float = STOPPAGE_MIN_S) -> DataFrame:
    """(race, t0, t1) of every field stop of at least `min_s`, up to t_at."""
    stops = stop_ticks(df).select("race", "t")
    if t_at is not None:
        stops = stops.filter(F.col("t") <= t_at)
    isl = gap_islands(stops, ["race"], chunk_of("t", BUCKET_S), ["t"], 1.0)
    out = isl.groupBy("race", "island").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    return out.filter(F.col("t1") - F.col("t0") >= min_s).select("race", "t0", "t1")


def car_states(df: DataFrame, anchors: DataFrame, stopped_after: float = STOPPED_AFTER_S, out_after: float = OUT_AFTER_S,
               min_still: int = 5) -> DataFrame:
    """Status of every live car at every tick: PIT, OUT, STOPPED or none; a field that stands as a whole is not stopped."""
    rows = anchors.select(*CAR, "tick", "t", "in_pit", (F.col("t") - F.col("moved")).alias("_for"))
    w = W.partitionBy("race", "tick")
    still = F.count_if(~F.col("in_pit") & (F.col("_for") >= stopped_after)).over(w)
    on = F.count_if(~F.col("in_pit")).over(w)
    rows = rows.withColumn("field_still", (still >= min_still) & (still >= on / 2))
    status = (F.when(F.col("in_pit"), "PIT").when(F.col("field_still"), None).when(F.col("_for") >= out_after, "OUT")
              .when(F.col("_for") >= stopped_after, "STOPPED"))
    return rows.select(*CAR, "tick", F.col("_for").alias("still_for"), status.alias("status"))


def official_state_at(rows: DataFrame, t: str, official: DataFrame) -> DataFrame:
    """Adds official_state: the flag of the last track-wide message."""
    wide = official.filter("msector is null").select("race", F.col("t").alias("_ot"), "event_id", F.col("flag").alias("official_state"))
    out = asof_join(rows, wide, ["race"], t, "_ot", ["official_state"], BUCKET_S, tie=["event_id"])
    return out.withColumn("official_state", F.coalesce("official_state", F.lit("CLEAR")))


def first_from(asked: DataFrame, events: DataFrame, by: list[str], lo: str, name: str) -> DataFrame:
    """Adds `name`: the time of the first of the events (by, at) at or after `lo`, NULL without one. Looking ahead is an as-of join against
    the clock, so rows and events do not meet in pairs."""
    back = events.select(*by, (-F.col("at")).alias("_back"), F.col("at").alias(name))
    return asof_join(asked.withColumn("_from", -F.col(lo)), back, by, "_from", "_back", [name], 256.0).drop("_from")


def incident_start(official: DataFrame) -> DataFrame:
    """Adds start: for a track-wide flag the first sector flag of the 120 s before it, else its own time."""
    wide = official.filter("msector is null").select("race", "event_id", (F.col("t") - ESCALATION_LOOKBACK_S).alias("lo"), F.col("t").alias("hi"))
    first = first_from(wide, official.filter("msector is not null").select("race", F.col("t").alias("at")), ["race"], "lo", "_st")
    first = first.filter(F.col("_st") < F.col("hi")).groupBy("race", "event_id").agg(F.min("_st").alias("_first"))
    return official.join(first, ["race", "event_id"], "left").withColumn("start", F.coalesce("_first", "t")).drop("_first")


def our_match(official: DataFrame, recs: DataFrame, n: int, before: float = MATCH_BEFORE_S, after: float = MATCH_AFTER_S) -> DataFrame:
    """Adds t_ours: our first flag for each official one, track-wide with track-wide, sector with the same
    or an adjacent sector."""
    off = incident_start(official.filter("flag <> 'CLEAR'")).withColumns({"lo": F.col("start") - before, "hi": F.col("t") + after})
    at = lambda d: F.pmod(F.col("msector") + d, F.lit(n)).cast("int")
    scopes = F.when(F.col("msector").isNull(), F.array(F.lit(-1))).otherwise(F.array_distinct(F.array(at(-1), at(0), at(1))))
    asked = off.select("race", "event_id", "lo", "hi", F.explode(scopes).alias("scope"))
    ours = recs.filter("flag <> 'CLEAR'").select("race", F.when(F.col("flag").isin(*WIDE), -1).otherwise(at(0)).alias("scope"), F.col("t").alias("at"))
    hits = first_from(asked, ours.filter("scope is not null"), ["race", "scope"], "lo", "_rt").filter(F.col("_rt") <= F.col("hi"))
    hits = hits.groupBy("race", "event_id").agg(F.min("_rt").alias("t_ours"))
    return off.drop("lo", "hi").join(hits, ["race", "event_id"], "left")


def lead_summary(matched: DataFrame, stops: DataFrame) -> DataFrame:
    """Per race: official flags outside stoppages, how many we had first, and the median lead of those."""
    inside = interval_join(matched, stops.withColumn("hi", F.col("t1") + 1), ["race"], "t", "t0", "hi", 256.0, how="left_semi")
    out = matched.join(inside.select("race", "event_id"), ["race", "event_id"], "left_anti")
    lead = F.col("t") - F.col("t_ours")
    return out.groupBy("race").agg(F.count(F.lit(1)).alias("official_flags"), F.count_if(lead > 0).alias("earlier"),
                                   F.percentile(F.when(lead > 0, lead), 0.5).alias("median_lead_s"))


def flag_incidents(official: DataFrame, gap: float = INCIDENT_GAP_S) -> DataFrame:
    """Official flags in groups without a gap of more than 60 s."""
    rows = gap_islands(official.filter("flag <> 'CLEAR'"), ["race"], chunk_of("t", BUCKET_S), ["t", "event_id"], gap, "incident")
    return rows.groupBy("race", "incident").agg(
        F.min("t").alias("t"), F.max("t").alias("t_last"), F.count(F.lit(1)).alias("events"),
        F.array_join(F.array_sort(F.collect_set("flag")), " ").alias("flags"),
        F.array_join(F.transform(F.array_sort(F.collect_set("msector")), lambda s: s.cast("string")), " ").alias("sectors"))


def last_green_lap(df: DataFrame, length: float, bin_m: float = 50.0) -> DataFrame:
    """(race, drv, drv_lap, bin, v): the car's speed per 50 m on its latest fully green lap before drv_lap."""
    ok = df.filter("speed is not null and dist is not null")
    bins = ok.filter("track_status = '1'").groupBy(*CAR, "drv_lap", chunk_of("dist", bin_m).alias("bin")).agg(F.max_by("speed", "tick").alias("v"))
    laps = ok.groupBy(*CAR, "drv_lap").agg(F.bool_and(F.col("track_status") == "1").alias("green"))
    laps = running(laps, CAR, chunk_of("drv_lap", 64), ["drv_lap"], lasts_before={"ref_lap": F.when(F.col("green"), F.col("drv_lap"))})
    ref = laps.filter("ref_lap is not null").select(*CAR, "drv_lap", "ref_lap")
    return ref.join(bins.withColumnRenamed("drv_lap", "ref_lap"), [*CAR, "ref_lap"]).select(*CAR, "drv_lap", "bin", "v")


def clock_places(calls: DataFrame, named: DataFrame, official: DataFrame, df: DataFrame) -> DataFrame:
    """Where and when the exposure clock of each of our track-wide calls runs: (race, place, crash_dist, cars, t0, t1). It starts with
    the call (race, id, t, flag), at the last place known then of a car it names (`named`: race, id, rec_cars; the last one with a place
    counts), and ends with the first official track-wide message of at least its level, or with the race's data."""
    rank = F.coalesce(*[F.when(F.col("flag") == f, F.lit(RANKS[f])) for f in ("VSC", "SC", "RED")])
    ends = df.groupBy("race").agg(F.max("t").alias("_end"))
    ours = calls.filter(F.col("flag").isin("VSC", "SC", "RED")).select("race", "id", "t", rank.alias("_rank"))
    ours = ours.join(named, ["race", "id"]).join(ends, "race").withColumnsRenamed({"rec_cars": "cars", "t": "t0"})
    places = df.filter("dist is not null").select("race", F.col("drv").alias("car"), "t", "dist")
    at = ours.select("race", "id", "t0", F.posexplode("cars").alias("_n", "car"))
    at = asof_join(at, places, ["race", "car"], "t0", "t", ["dist"], BUCKET_S).filter("dist is not null")
    at = at.groupBy("race", "id").agg(F.max_by("dist", "_n").alias("crash_dist"))
    theirs = official.filter(F.col("flag").isin("VSC", "SC", "RED")).select("race", "t", rank.alias("_their_rank"))
    spans = ours.select("race", "id", "_rank", F.col("t0").alias("lo"), F.greatest("t0", "_end").alias("hi"))
    over = interval_join(theirs, spans, ["race"], "t", "lo", "hi", BUCKET_S, extra=F.col("_their_rank") >= F.col("_rank"))
    over = over.groupBy("race", "id").agg(F.min("t").alias("_over"))
    out = ours.join(at, ["race", "id"]).join(over, ["race", "id"], "left")
    return out.select("race", F.col("id").alias("place"), "crash_dist", "cars", "t0", F.coalesce("_over", F.greatest("t0", "_end")).alias("t1"))


def field_pace(passes: DataFrame, df: DataFrame, bin_m: float = BIN_M, kept: int = FIELD_KEPT, least: int = FIELD_LEAST) -> DataFrame:
    """(race, place, car, t_pass, field_kmh): the median of the last `kept` green samples of the whole field at the pass's
    50 m, at or before the pass; with fewer than `least`, of the 50 m before, else behind. Nothing later counts."""
    fast = df.filter((F.col("track_status") == "1") & (F.col("speed") >= FIELD_MIN_KMH) & F.col("dist").isNotNull())
    fast = fast.select("race", chunk_of("dist", bin_m).alias("bin"), "t", "drv", "speed")
    fast = numbered(fast, ["race", "bin"], chunk_of("t", BUCKET_S), ["t", "drv"], "k")
    asked = passes.select("race", "place", "car", "t_pass", "crash_dist").withColumn("off", F.explode(F.array(F.lit(0), F.lit(-1), F.lit(1))))
    asked = asked.withColumn("bin", chunk_of("crash_dist", bin_m) + F.col("off"))
    asked = asof_join(asked, fast, ["race", "bin"], "t_pass", "t", ["k"], BUCKET_S).filter("k is not null")
    spans = asked.select("race", "bin", "place", "car", "t_pass", "off", F.greatest(F.col("k") - kept + 1, F.lit(1)).alias("lo"), F.col("k").alias("hi"))
    seen = interval_join(fast.select("race", "bin", "k", "speed"), spans, ["race", "bin"], "k", "lo", "hi", float(kept))
    each = seen.groupBy("race", "place", "car", "t_pass", "off").agg(F.sort_array(F.collect_list("speed")).alias("_v")).filter(F.size("_v") >= least)
    middle = F.element_at("_v", F.floor(F.size("_v") / 2).cast("int") + 1)
    rank = F.when(F.col("off") == 0, 0).when(F.col("off") == -1, 1).otherwise(2)
    return each.groupBy("race", "place", "car", "t_pass").agg(F.min_by(middle, rank).alias("field_kmh"))


def exposure_clock(passes: DataFrame, df: DataFrame, length: float, bin_m: float = BIN_M, share: float = 0.8, fallback: float = 120.0) -> DataFrame:
    """Passes (race, place, car, t_pass, speed_kmh, crash_dist) at racing speed: 80% of the car's own last green lap at that
    point, else of the field's pace there so far, else 120 km/h. Each car counts once per clock."""
    laps = df.filter("drv_lap is not null").select("race", F.col("drv").alias("car"), "t", "drv_lap")
    at = asof_join(passes.drop("drv_lap"), laps, ["race", "car"], "t_pass", "t", ["drv_lap"], BUCKET_S).withColumn("bin", chunk_of("crash_dist", bin_m))
    own = last_green_lap(df, length, bin_m).withColumnRenamed("drv", "car")
    own = own.withColumn("_d", F.explode(F.array(F.lit(0), F.lit(1), F.lit(-1)))).withColumn("bin", F.col("bin") + F.col("_d"))
    rank = F.when(F.col("_d") == 0, 0).when(F.col("_d") == 1, 1).otherwise(2)          # the bin itself, the one before, the one after
    own = own.groupBy("race", "car", "drv_lap", "bin").agg(F.min_by("v", rank).alias("_own"))
    at = at.join(own, ["race", "car", "drv_lap", "bin"], "left").join(field_pace(passes, df, bin_m), ["race", "place", "car", "t_pass"], "left")
    ref = F.coalesce(F.when(F.col("_own") > 0, F.col("_own")), "field_kmh")
    racing = F.when(ref.isNotNull(), F.col("speed_kmh") >= share * ref).otherwise(F.col("speed_kmh") >= fallback)
    label = F.when(F.col("_own") > 0, "own pace").when(F.col("field_kmh") > 0, "field pace").otherwise("no reference")
    hits = at.withColumns({"reference": label, "_racing": racing}).filter("_racing")
    return hits.groupBy("race", "place", "car").agg(F.min(F.struct("t_pass", "speed_kmh", "reference")).alias("_p")).select(
        "race", "place", "car", "_p.*")


def lead_labels(ours: DataFrame, official: DataFrame, n: int) -> DataFrame:
    """What to say about our raise (race, id, t, msector, rank, track_wide) next to race control's messages
    of at least that level within the confirm window."""
    rank = F.when(F.col("flag").isin("YELLOW", "VSC"), 1).when(F.col("flag").isin("DOUBLE_YELLOW", "SC"), 2).when(F.col("flag") == "RED", 3)
    off = official.filter("flag <> 'CLEAR'").select("race", F.col("t").alias("_ot"), F.col("msector").alias("_os"), rank.alias("_or"))
    spans = ours.withColumns({"lo": F.col("t") - CONFIRM_WINDOW_S, "hi": F.col("t") + CONFIRM_WINDOW_S})
    fit = F.when(F.col("track_wide"), F.col("_os").isNull()).otherwise(
        F.col("_os").isNotNull() & sector_matches(F.col("msector"), F.col("_os"), F.lit(n)))
    hits = interval_join(off, spans, ["race"], "_ot", "lo", "hi", 256.0, extra=F.coalesce(fit, F.lit(False)) & (F.col("_or") >= F.col("rank")))
    first = hits.groupBy("race", "id").agg(F.min("_ot").alias("_first"))
    out = ours.join(first, ["race", "id"], "left")
    d = F.round(F.col("_first") - F.col("t"), 2)
    label = (F.when(d.isNull(), "WAITING").when(d <= -MIN_LEAD_S, "FIRST").when(d < MIN_LEAD_S, "LEVEL").otherwise("AHEAD"))
    return out.select("race", "id", "t", d.alias("lead_s"), label.alias("label"))


def call_log(recs: DataFrame, official: DataFrame, dets: DataFrame, n: int, size: float = 4096.0) -> DataFrame:
    """The calls read out in a race, in order: raises of a scope with the cars and type behind them,
    clears, and race control's confirmations with our lead. A raise only counts above the scope's level. Unknown flags, and sector flags without a sector, are left out.

    Scopes fall into runs between their clears (`scope_runs`), runs give the raises, the causes and the episodes, and messages meet the
    episodes by time (`confirmations`)."""
    src = recs.select("race", "id", F.explode_outer("source_detections").alias("det"))
    facts = src.join(dets.select("race", F.col("id").alias("det"), "drivers", "type"), ["race", "det"], "left").groupBy("race", "id").agg(
        F.array_distinct(F.flatten(F.collect_list("drivers"))).alias("_cars"),
        F.max_by("type", F.struct((F.col("type") != "ANOMALY").alias("p"), F.col("det"))).alias("dtype"))
    in_order = F.array_sort(F.transform("_cars", lambda c: F.struct(F.coalesce(F.try_to_number(c, F.lit("999999")), F.lit(10**6)).cast("int").alias("n"), c.alias("c"))))
    facts = facts.select("race", "id", F.transform(in_order, lambda x: x["c"]).alias("cars"), "dtype")
    rank = F.coalesce(*[F.when(F.col("flag") == f, r) for f, r in RANKS.items()])
    own = recs.withColumn("rank", rank).filter("rank is not null").join(facts, ["race", "id"], "left")
    own = own.withColumn("scope", F.when(F.when(F.col("rank") == 0, F.col("message") == "TRACK CLEAR").otherwise(F.col("flag").isin(*WIDE)), TRACK)
                         .otherwise(F.col("msector").cast("int").cast("string")))
    runs = stored(scope_runs(own.filter("scope is not null"), size))
    levels = runs.select("race", "scope", F.explode(F.array_distinct(F.array_compact(F.array("up1", "up2", "up3")))).alias("up")).select("race", "scope", "up.*")
    ends = runs.filter("over is not null").select("race", "scope", "over.*")
    cause = causes(own, ends, size)
    raised = levels.filter("not quiet").join(cause, ["race", "id"], "left").select(
        "race", "t", F.lit("raise").alias("call"), "flag", "scope", F.concat_ws(",", "why.cars").alias("cars"), F.col("why.dtype").alias("dtype"))
    cleared = ends.select("race", "t", F.lit("clear").alias("call"), F.lit("CLEAR").alias("flag"), "scope")
    off = official.withColumns({"rank": rank, "sector": F.col("msector").cast("int")}).filter("rank > 0").select("race", "t", "event_id", "flag", "rank", "sector")
    agreed = confirmations(episodes(levels, ends, size), stored(off), n).select(
        "race", "t", F.lit("confirm").alias("call"), "flag", F.coalesce(F.col("sector").cast("string"), F.lit(TRACK)).alias("scope"), "lead_s")
    out = raised.unionByName(cleared, allowMissingColumns=True).unionByName(agreed, allowMissingColumns=True)
    return out.select("race", "t", "call", "flag", "scope", "cars", "dtype", "lead_s")


def scope_runs(own: DataFrame, size: float) -> DataFrame:
    """The rows of a scope between two of its clears, as one row: who first reached level 1, 2 and 3 (`up1` to `up3`, the same row where it
    jumped), and the clear that ended it (`over`). Those rows are all that a level can be raised by. Runs without a raise are left out."""
    row = F.struct("t", "id", "rank", "flag", F.col("msector").cast("int").alias("sector"), F.contains("reason", F.lit("advisory")).alias("quiet"))
    clears = (F.col("rank") == 0).cast("bigint")
    own = running(own.withColumn("reason", F.coalesce("reason", F.lit(""))), ["race", "scope"], chunk_of("t", size), ["t", "id"], sums={"_cut": clears})
    ups = [F.min(F.when(F.col("rank") >= r, row)).alias(f"up{r}") for r in (1, 2, 3)]
    runs = own.groupBy("race", "scope", (F.col("_cut") - clears).alias("cut")).agg(*ups, F.min(F.when(F.col("rank") == 0, F.struct("t", "id"))).alias("over"))
    return runs.filter("up1 is not null").drop("cut")


def causes(own: DataFrame, ends: DataFrame, size: float) -> DataFrame:
    """(race, id, why): the cars and type that a recommendation's sector was last flagged for, forgotten when its flag is cleared."""
    given = F.when(F.size("cars") > 0, F.struct("cars", "dtype"))
    rows = own.filter("rank > 0").select("race", F.col("msector").cast("int").cast("string").alias("scope"), "t", "id", given.alias("_why"))
    nothing = F.lit(None).cast(rows.schema["_why"].dataType)
    blank = F.struct(F.array().cast("array<string>").alias("cars"), F.lit(None).cast("string").alias("dtype"))
    rows = rows.withColumn("_why", F.coalesce("_why", nothing)).unionByName(ends.filter(F.col("scope") != TRACK).select("race", "scope", "t", "id", blank.alias("_why")))
    return running(rows, ["race", "scope"], chunk_of("t", size), ["t", "id"], lasts={"why": F.col("_why")}).select("race", "id", "why")


def episodes(levels: DataFrame, ends: DataFrame, size: float) -> DataFrame:
    """(race, scope, start, until, reach1..3): from a scope's first raise to its clear, and the times it reached each level. A raise for the
    whole track that was announced counts for its sector as well. `until` is the last time at which a message can refer to the episode:
    its clear or the confirm window, whichever is later, but not beyond the next episode's start; NULL while it is open."""
    notes = levels.select("race", "scope", "t", "id", "rank")
    shared = levels.filter((F.col("scope") == TRACK) & ~F.col("quiet") & F.col("sector").isNotNull())
    notes = notes.unionByName(shared.select("race", F.col("sector").cast("string").alias("scope"), "t", "id", "rank"))
    rows = notes.withColumn("_end", F.lit(0)).unionByName(ends.select("race", "scope", "t", "id").withColumn("_end", F.lit(1)), allowMissingColumns=True)
    rows = running(rows, ["race", "scope"], chunk_of("t", size), ["t", "id"], sums={"_n": F.col("_end").cast("bigint")})
    rows = rows.groupBy("race", "scope", (F.col("_n") - F.col("_end")).alias("episode")).agg(
        F.min(F.when(F.col("_end") == 0, F.col("t"))).alias("start"), F.max(F.when(F.col("_end") == 1, F.col("t"))).alias("_closed"),
        *[F.min(F.when(F.col("rank") >= r, F.col("t"))).alias(f"reach{r}") for r in (1, 2, 3)]).filter("start is not null")
    rows = running(rows, ["race", "scope"], chunk_of("start", size), ["start", "episode"], nexts={"_next": F.col("start")})
    last = F.least(F.greatest("_closed", F.col("start") + CONFIRM_WINDOW_S), "_next")
    return rows.withColumn("until", F.when(F.col("_closed").isNotNull(), last)).drop("_closed", "_next", "episode")


def confirmations(eps: DataFrame, off: DataFrame, n: int) -> DataFrame:
    """Race control's messages (rank above 0) that follow a call of ours: the first one per own first call, with the lead, if race control had
    not spoken of the place shortly before that call. An episode is listed in the time buckets in which it can be referred to; per scope
    these do not overlap. Messages come before our calls of the same time."""
    end = off.groupBy("race").agg(F.max("t").alias("_last"))
    spans = eps.join(end, "race").withColumn("until", F.coalesce("until", "_last")).filter("start < until").drop("_last")
    spans = spans.withColumn("_own", F.when(F.col("scope") != TRACK, F.col("scope").cast("int"))).drop("scope")
    same = F.when(F.col("sector").isNull(), F.col("_own").isNull()).otherwise(F.col("_own").isNotNull() & sector_matches(F.col("_own"), F.col("sector"), F.lit(n)))
    near = interval_join(off, spans, ["race"], "t", "start", "until", 256.0, extra=same & (F.col("t") > F.col("start")))
    reach = F.coalesce(*[F.when(F.col("rank") == r, F.col(f"reach{r}")) for r in (1, 2, 3)])
    asked = near.groupBy("race", "t", "event_id", "flag", "rank", "sector").agg(F.min("start").alias("start"), F.min(reach).alias("_reach"))
    # the level itself counts for the whole track only
    asked = asked.filter((F.col("sector").isNotNull() | (F.col("_reach") < F.col("t"))) & (F.col("t") - F.col("start") >= MIN_LEAD_S)).drop("_reach")
    asked = stored(asked)
    earlier = off.select("race", F.col("t").alias("_t"), F.col("sector").alias("_s"))
    over = F.col("_s").isNull() | (F.col("sector").isNotNull() & sector_matches(F.col("sector"), F.col("_s"), F.lit(n)))
    back = asked.withColumn("_lo", F.col("start") - CONFIRM_WINDOW_S)
    spoken = interval_join(earlier, back, ["race"], "_t", "_lo", "start", 256.0, extra=F.coalesce(over, F.lit(False)), closed=False).select("race", "event_id", "start").distinct()
    asked = asked.join(spoken, ["race", "event_id", "start"], "left_anti").withColumn("_wide", F.col("sector").isNull())
    first = asked.groupBy("race", "_wide", "start").agg(F.min(F.struct("t", "event_id", "flag", "sector")).alias("m"))
    return first.select("race", "m.*", F.round(F.col("m.t") - F.col("start"), 2).alias("lead_s"))
