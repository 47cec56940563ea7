"""Our VSC, SC and red recommendations against race control's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trackguard.functions.text import fixed
from trackguard.functions.timeline import asof_join, beside, chunk_of, interval_join, running
from trackguard.operators import onset as ON
from trackguard.operators.incidents import ESCALATIONS, MATCH_BEFORE_S, in_sectors, match_incidents, suspended_at
from trackguard.operators.scoring import ratio
from trackguard.session import stored

LATE_S, RED_WINDOW_S, FA_AFTER_S = 60.0, 1200.0, 60.0
BUCKET_S = 1024.0
NEUTRAL = ["4", "5", "6", "7"]
# fixed values: categories of the escalation report that must match
RED_UNCALLED = "red while race control kept its SC or VSC"
NEUTRAL_CALL = "during an official neutralisation"
OUTSIDE, YELLOWS, NOTHING = "escalated incident, outside the match window", "official yellows only", "no official flag"
EXTRA = [YELLOWS, OUTSIDE, NOTHING, RED_UNCALLED]


def level(flag: Column) -> Column:
    """0, 1, 2 for VSC, SC, RED; NULL otherwise."""
    return F.when(flag == "VSC", 0).when(flag == "SC", 1).when(flag == "RED", 2)


def is_track_clear() -> Column:
    return (F.col("flag") == "CLEAR") & (F.col("message") == "TRACK CLEAR")


def track_changes(recs: DataFrame, resets: DataFrame | None = None, by: list[str] = ["race"]) -> DataFrame:
    """(by, t, seq, flag, cause, red_since): every change of our track-wide flag; a reset clears it."""
    own = recs.filter(F.col("flag").isin(ESCALATIONS) | is_track_clear()).select(
        *by, "t", F.col("id").alias("seq"), "flag", F.col("msector").alias("cause"))
    if resets is not None:
        own = own.unionByName(resets.select(*by, "t", F.lit("").alias("seq"), F.lit("CLEAR").alias("flag"),
                                            F.lit(None).cast("int").alias("cause")))
    return running(own, by, chunk_of("t", BUCKET_S), ["t", "seq"], starts={"red_since": F.col("flag") == "RED"})


def escalation_recs(recs: DataFrame, resets: DataFrame | None = None, by: list[str] = ["race"]) -> DataFrame:
    """Recommendations that raise or restate our track-wide flag; a lower one is a downgrade, not a call."""
    rank = F.coalesce(level(F.col("flag")), F.lit(-1))
    rows = recs.filter(F.col("flag").isin(ESCALATIONS) | is_track_clear()).withColumn("_rank", rank)
    if resets is not None:
        rows = rows.unionByName(resets.select(*by, "t", F.lit("").alias("id"), F.lit(-1).alias("_rank")), allowMissingColumns=True)
    rows = running(rows, by, chunk_of("t", BUCKET_S), ["t", "id"], lasts_before={"_level": F.col("_rank")})
    keep = (F.col("_rank") >= 0) & (F.col("_rank") >= F.coalesce("_level", F.lit(-1)))
    return rows.filter(keep).drop("_rank", "_level")


def track_flag_at(rows: DataFrame, t: str, changes: DataFrame, by: list[str] = ["race"]) -> DataFrame:
    """Adds our_flag, our_since, our_cause and our_red_since as of t."""
    ch = changes.withColumns({"our_flag": F.col("flag"), "our_since": F.col("t"), "our_cause": F.col("cause"),
                              "our_red_since": F.col("red_since"), "_ct": F.col("t")})
    return asof_join(rows, ch, by, t, "_ct", ["our_flag", "our_since", "our_cause", "our_red_since"], BUCKET_S, tie=["seq"])


def official_state(rows: DataFrame, t: str, df: DataFrame) -> DataFrame:
    """Adds status (race control's track status as of t) and neutral (SC, VSC, red or suspended)."""
    ticks = df.groupBy("race", "tick").agg(F.first("t").alias("_st"), F.min("track_status").alias("status"))
    first = ticks.groupBy("race").agg(F.min_by("status", "_st").alias("_first"))
    out = asof_join(rows, ticks, ["race"], t, "_st", ["status"], BUCKET_S).join(first, "race", "left")
    out = suspended_at(out.withColumn("status", F.coalesce("status", "_first")).drop("_first"), df, t)
    return out.withColumn("neutral", F.col("status").isin(NEUTRAL) | F.coalesce("suspended", F.lit(False))).drop("suspended")


def official_side(df: DataFrame, msgs: DataFrame, incidents: DataFrame, official: DataFrame, recs: DataFrame, esc: DataFrame,
                  changes: DataFrame, ons: DataFrame, dets: DataFrame, n: int, by: list[str] = ["race"]) -> DataFrame:
    """One row per official escalation: earlier, later, already out or missed, and why.

    `by` may hold more than the race (a setting): recommendations carry those keys."""
    key, extra = ["race", "incident"], [k for k in by if k != "race"]
    up = msgs.filter(F.col("flag").isin(ESCALATIONS)).groupBy(*key).agg(
        F.min(F.struct("t", "event_id", "flag")).alias("_f"), F.max_by("flag", level(F.col("flag"))).alias("official_top"),
        F.min(F.when(F.col("flag") == "RED", F.col("t"))).alias("official_red_t"))
    off = up.join(incidents.select(*key, F.col("t").alias("t_incident"), "sectors"), key).select(
        *key, "t_incident", "sectors", F.col("_f.t").alias("t_official"), F.col("_f.flag").alias("official_flag"),
        "official_top", "official_red_t")
    clears = official.filter("flag = 'CLEAR' and msector is null").select("race", F.col("t").alias("_clear"))
    ahead = asof_join(off.withColumn("_neg", -F.col("t_official") - F.lit(1e-6)), clears.withColumn("_cn", -F.col("_clear")),
                      ["race"], "_neg", "_cn", ["_clear"], BUCKET_S).drop("_neg")
    off = ahead.withColumn("t_end", F.coalesce("_clear", F.col("t_official") + RED_WINDOW_S)).drop("_clear")
    if extra:
        off = off.join(recs.select(*by).distinct(), "race")
    okey = [*by, "incident"]
    off = stored(off)
    # our escalations and the zone flags we showed, through one join
    hits = esc.select(*by, "id", "flag", "reason", F.col("t").alias("t_hit"), F.col("msector").alias("hit_sector"), F.lit(True).alias("_call"))
    hits = hits.unionByName(recs.filter(F.col("flag").isin("YELLOW", "DOUBLE_YELLOW")).select(
        *by, "flag", F.col("t").alias("t_hit"), F.col("msector").alias("hit_sector"), F.lit(False).alias("_call")), allowMissingColumns=True)
    spans = off.withColumns({"lo": F.col("t_incident") - MATCH_BEFORE_S, "hi": F.greatest(F.col("t_official") + LATE_S, "t_end")})
    near = interval_join(hits, spans, by, "t_hit", "lo", "hi", 256.0, extra=in_sectors(F.col("hit_sector"), F.col("sectors"), n))
    due = F.col("t_hit") <= F.col("t_official") + LATE_S
    call, red = F.col("_call") & due, F.col("_call") & (F.col("flag") == "RED") & (F.col("t_hit") <= F.col("t_end"))
    ours = near.groupBy(*okey).agg(
        F.min(F.when(call, F.struct("t_hit", "id", "flag", "reason"))).alias("_m"), F.max_by("flag", F.when(call, level(F.col("flag")))).alias("our_top"),
        F.min(F.when(red, F.col("t_hit"))).alias("our_red_t"),
        F.max_by("flag", F.when(~F.col("_call") & due, (F.col("flag") == "DOUBLE_YELLOW").cast("int"))).alias("_shown"))
    cand = ON.candidates(incidents, ons, n)
    car = ON.pick_onset(cand).select(*key, "t_onset", F.col("onset_drv").alias("onset_car"))
    types = interval_join(dets.select("race", F.explode("drivers").alias("drv"), "t", "type"),
                          car.withColumnRenamed("onset_car", "drv").withColumns({"lo": F.col("t_onset") - 10, "hi": F.col("t_onset") + 60}),
                          ["race", "drv"], "t", "lo", "hi", 64.0)
    types = types.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("type")), " ").alias("onset_car_alerts"))
    out = (off.join(ours, okey, "left").join(car, key, "left").join(types, key, "left")
           .join(ON.no_onset_reason(df, incidents, n), key, "left"))
    out = track_flag_at(out, "t_official", changes, by)
    at_red = track_flag_at(out.select(*okey, "official_red_t").filter("official_red_t is not null"), "official_red_t", changes, by)
    out = out.drop("our_red_since").join(at_red.select(*okey, "our_red_since"), okey, "left")
    hit, open_ = F.col("_m").isNotNull(), F.coalesce(F.col("our_flag").isin(ESCALATIONS), F.lit(False))
    lead = F.col("t_official") - F.col("_m.t_hit")
    status = F.when(hit & (lead > 0), "earlier").when(hit, "later").when(open_, "already out").otherwise("missed")
    missed = status == "missed"
    ago = F.col("t_incident") - F.col("t_onset")
    what = F.coalesce(F.format_string("we showed %s but did not escalate", F.lower(F.replace("_shown", F.lit("_"), F.lit(" ")))),
                      F.lit("we made no recommendation"))
    what = F.when(F.col("_shown").isNotNull(), what).otherwise("we made no recommendation")
    collapse = F.format_string("car %s collapsed %s s %s the first official message; %s", "onset_car", fixed(F.abs(ago)),
                               F.when(ago >= 0, "before").otherwise("after"), what)
    detail = (F.when(hit, F.col("_m.reason"))
              .when(open_, F.format_string("our %s out since %s s before, cause sector %d", "our_flag",
                                           fixed(F.col("t_official") - F.col("our_since")), "our_cause"))
              .when(F.col("onset_car").isNotNull(), collapse).otherwise(F.col("reason")))
    return out.select(
        *by, "incident", "t_incident", "t_official", "official_flag", "official_top",
        F.when(F.size("sectors") > 0, F.array_join("sectors", " ")).otherwise("track-wide").alias("sectors"),
        status.alias("status"), F.when(hit, F.round(lead, 2)).alias("lead_s"),
        F.when(hit, F.col("_m.t_hit")).when(open_, F.col("our_since")).alias("our_t"),
        F.when(hit, F.col("_m.flag")).when(open_, F.col("our_flag")).alias("our_flag"), "our_top",
        F.when(missed, F.when(F.col("onset_car").isNull(), "no car collapse").otherwise("car collapse seen")).alias("miss_kind"),
        "onset_car", F.coalesce("onset_car_alerts", F.lit("")).alias("onset_car_alerts"), detail.alias("detail"),
        "official_red_t", F.coalesce("our_red_t", "our_red_since").alias("our_red_t"))


def our_side(df: DataFrame, msgs: DataFrame, incidents: DataFrame, official: DataFrame, esc: DataFrame, n: int,
             by: list[str] = ["race"]) -> DataFrame:
    """One row per recommendation of ours with its category, and whether race control showed a red around it."""
    key, rid = ["race", "incident"], [*by, "id"]
    up = msgs.groupBy(*key).agg(F.min(F.when(F.col("flag").isin(ESCALATIONS), F.col("t"))).alias("_up"))
    inc = incidents.select(*key, "t", "t_last", "sectors").join(up, key)
    hits = esc.select(*by, "id", F.col("t").alias("t_hit"), F.col("msector").alias("hit_sector"))
    window = F.greatest(F.col("t_last") + FA_AFTER_S, F.coalesce(F.col("_up") + LATE_S, "t_last"))
    fits = match_incidents(inc.withColumn("_hi", window), hits, n, MATCH_BEFORE_S, 0.0, "_hi")
    facts = fits.groupBy(*rid).agg(
        F.max(F.coalesce(F.col("t_hit") <= F.col("_up") + LATE_S, F.lit(False))).alias("_matched"),
        F.max(F.when(F.col("t_hit") <= F.col("t_last") + FA_AFTER_S, F.col("_up").isNotNull())).alias("_escalated"),
        F.count_if(F.col("t_hit") <= F.col("t_last") + FA_AFTER_S).alias("_fits"))
    red = official.filter("flag = 'RED'").select("race", F.col("t").alias("t_red")).withColumns(
        {"lo": F.col("t_red") - RED_WINDOW_S, "hi": F.col("t_red") + MATCH_BEFORE_S})
    near_red = interval_join(esc.filter("flag = 'RED'").select(*by, "id", "t"), red, ["race"], "t", "lo", "hi", 256.0)
    near_red = near_red.select(*rid).distinct().withColumn("_near_red", F.lit(True))
    out = official_state(esc.select(*by, "id", "t", "flag", "msector", "reason"), "t", df)
    out = out.join(facts, rid, "left").join(near_red, rid, "left")
    is_red = F.col("flag") == "RED"
    rc_red = F.when(is_red, (F.col("status") == "5") | F.coalesce("_near_red", F.lit(False)))
    category = (F.when(F.col("_matched"), "matched")
                .when(F.col("neutral"), F.when(is_red & ~rc_red, RED_UNCALLED).otherwise(NEUTRAL_CALL))
                .when(F.col("_escalated"), OUTSIDE).when(F.col("_fits") > 0, YELLOWS).otherwise(NOTHING))
    return out.select(*by, "id", "t", "flag", "msector", "reason", category.alias("category"), rc_red.alias("race_control_red"))


def clears_under_neutral(df: DataFrame, recs: DataFrame, by: list[str] = ["race"]) -> DataFrame:
    """TRACK CLEARs of ours while race control's status was SC, VSC or red (there should be none)."""
    rows = official_state(recs.filter(is_track_clear()).select(*by, "id", "t"), "t", df)
    return rows.groupBy(*by).agg(F.count_if(F.col("status").isin(NEUTRAL)).alias("track_clears_under_neutral"))


# ---- totals

def official_summary(off: DataFrame, by: list[str] = []) -> DataFrame:
    """Counts by status, median lead and its quartiles, first flags that agree, reds, over all races."""
    quart = F.percentile("lead_s", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    both = F.col("official_red_t").isNotNull() & F.col("our_red_t").isNotNull()
    impact = F.col("onset_car").isNotNull() & F.col("onset_car_alerts").rlike("IMPACT|MULTI")
    severe = F.col("official_flag").isin("SC", "RED")
    has = F.col("onset_car").isNotNull()
    aggs = [F.count(F.lit(1)).alias("official"), *[F.count_if(F.col("status") == s).alias(s.replace(" ", "_")) for s in
            ("earlier", "later", "already out", "missed")],
            F.count_if(F.col("status").isin("earlier", "later")).alias("matched"),
            *[F.get(quart, F.lit(i)).alias(f"lead_{s}_s") for i, s in enumerate(("p25", "median", "p75"))],
            F.count_if(F.col("status").isin("earlier", "later") & (F.col("our_flag") == F.col("official_flag"))).alias("same_first_flag"),
            *[F.count_if(F.col("miss_kind") == k).alias(k.replace(" ", "_")) for k in ("car collapse seen", "no car collapse")],
            F.count_if(both).alias("red_both"),
            F.count_if(F.col("official_red_t").isNotNull() & F.col("our_red_t").isNull()).alias("red_race_control_only"),
            F.percentile(F.when(both, F.col("official_red_t") - F.col("our_red_t")), 0.5).alias("red_median_lead_s"),
            F.count_if(has).alias("with_onset_car"), F.count_if(impact & severe).alias("sc_or_red_with_impact"),
            F.count_if(has & severe).alias("sc_or_red"), F.count_if(has & ~impact & ~severe).alias("vsc_without_impact"),
            F.count_if(has & (impact == severe)).alias("right_with_impact_rule")]
    return off.groupBy(*by).agg(*aggs) if by else off.agg(*aggs)


def flag_pairs(off: DataFrame) -> DataFrame:
    """Official first flag against ours, as a pivot."""
    return off.filter(F.col("status").isin("earlier", "later")).groupBy("official_flag").pivot("our_flag", ESCALATIONS).count().fillna(0)


def our_summary(ours: DataFrame, hours: DataFrame, by: list[str] = []) -> DataFrame:
    """Our escalations by category and flag, extras per hour (of the race, where `by` names it), reds by cause."""
    extra = F.col("category").isin(EXTRA)
    red = F.col("flag") == "RED"
    timed, late = F.col("reason").contains("crash site"), F.col("reason").contains("laps left")
    called = F.coalesce("race_control_red", F.lit(False))
    own = [k for k in by if k == "race"]
    total = hours.groupBy(*own).agg(F.sum("hours").alias("hours"))
    names = {"matched": "matched", NEUTRAL_CALL: "during_neutral", YELLOWS: "yellows_only", OUTSIDE: "outside_window",
             NOTHING: "no_official_flag", RED_UNCALLED: "red_uncalled"}
    aggs = [F.count(F.lit(1)).alias("ours"), *[F.count_if(F.col("category") == c).alias(n) for c, n in names.items()],
            *[F.count_if(F.col("flag") == f).alias(f"our_{f.lower()}") for f in ESCALATIONS], F.count_if(extra).alias("extra"),
            F.count_if(red & late).alias("reds_late_race"), F.count_if(red & timed).alias("reds_by_time"),
            F.count_if(red & ~timed & ~late).alias("reds_multi_car"), F.count_if(red & called).alias("reds_called"),
            F.count_if(red & ~called).alias("reds_uncalled")]
    out = ours.groupBy(*by).agg(*aggs) if by else ours.agg(*aggs)
    out = out.join(total, own) if own else beside(out, total)
    return out.withColumn("extra_per_hour", ratio("extra", "hours"))


def stopped_offset(df: DataFrame) -> DataFrame:
    """Lateral offset of stopped cars: why it cannot choose between VSC and SC."""
    s = df.filter((F.col("speed") < 5.0) & ~F.col("in_pit") & F.col("lat_off").isNotNull())
    off = F.abs("lat_off")
    return s.agg(F.count(F.lit(1)).alias("stopped_rows"), F.count_if(off <= 1.0).alias("within_1m"), F.count_if(off > 8.0).alias("beyond_8m"),
                 F.countDistinct(F.when(off > 8.0, F.struct("race", "drv"))).alias("cars_beyond_8m"))


def red_study(df: DataFrame, recs: DataFrame, official: DataFrame, by: list[str] = ["variant"], before: float = 300.0,
              after: float = 60.0) -> DataFrame:
    """Per setting: official reds our red episodes hit (300 s before to 60 s after), missed, and false episodes."""
    keys = [*by, "race"]
    rows = recs.filter(F.col("flag").isin(ESCALATIONS) | is_track_clear()).withColumn("_red", F.col("flag") == "RED")
    rows = running(rows, keys, chunk_of("t", BUCKET_S), ["t", "id"], lasts_before={"_was": F.col("_red")})
    eps = rows.filter(F.col("_red") & ~F.coalesce("_was", F.lit(False))).select(*keys, "id", "t")
    reds = official.filter("flag = 'RED'").select("race", "event_id", F.col("t").alias("t_red")).withColumns(
        {"lo": F.col("t_red") - before, "hi": F.col("t_red") + after})
    near = interval_join(eps, reds, ["race"], "t", "lo", "hi", 256.0)
    caught = near.groupBy(*by, "race", "event_id").agg(F.min(F.struct("id", "t")).alias("_e"), F.first("t_red").alias("t_red"))
    hits = caught.groupBy(*by).agg(F.count(F.lit(1)).alias("hits"), F.percentile(F.col("t_red") - F.col("_e.t"), 0.5).alias("median_lead_s"))
    red_ticks = df.filter("track_status = '5'").groupBy("race", "tick").agg(F.first("t").alias("_rt")).withColumns(
        {"lo": F.col("_rt") - 0.3, "hi": F.col("_rt") + 0.3}).drop("tick")
    shown = interval_join(eps, red_ticks, ["race"], "t", "lo", "hi", 64.0).filter(F.abs(F.col("t") - F.col("_rt")) < 0.3)
    false = eps.join(near.select(*keys, "id").distinct(), [*keys, "id"], "left_anti").join(
        shown.select(*keys, "id").distinct(), [*keys, "id"], "left_anti").groupBy(*by).agg(F.count(F.lit(1)).alias("false_reds"))
    total = official.filter("flag = 'RED'").agg(F.count(F.lit(1)).alias("official_reds"))
    out = beside(recs.select(*by).distinct().join(hits, by, "left").join(false, by, "left"), total)
    return out.fillna(0, ["hits", "false_reds"]).withColumn("misses", F.col("official_reds") - F.col("hits"))
