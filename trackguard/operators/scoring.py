"""Detections scored against official incidents: alerts, matches, held stops, false alarms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trackguard.functions.timeline import beside, chunk_of, in_chunk, interval_join, own_rows, running, with_history
from trackguard.sources.readers import assert_no_holdout
from trackguard.operators.incidents import MATCH_AFTER_S, MATCH_BEFORE_S, in_sectors, match_incidents

ALERT_GAP_S, FA_AFTER_S, MOVING_KMH, MAX_HOLD_S = 60.0, 60.0, 60.0, 900.0
SPAN_S = 1024.0


def rule_alerts(dets: DataFrame) -> DataFrame:
    """Everything but the anomaly advisory."""
    return dets.filter("type <> 'ANOMALY'")


def advisories(dets: DataFrame) -> DataFrame:
    return dets.filter("type = 'ANOMALY'")


def alerts(dets: DataFrame, by: list[str] = ["race"], gap: float = ALERT_GAP_S) -> DataFrame:
    """A car's first detection after `gap` without one (a MULTI counts for its sector)."""
    who = F.when(F.col("type") == "MULTI", F.concat(F.lit("sector-"), F.col("msector").cast("string"))).otherwise(F.get("drivers", F.lit(0)))
    hist = with_history(dets.withColumn("_who", who), gap, SPAN_S, "t")
    w = in_chunk([*by, "_who"], ["t", "id"])
    hist = hist.withColumn("_prev", F.lag("t").over(w))
    quiet = F.col("_prev").isNull() | (F.col("t") - F.col("_prev") >= gap)
    return own_rows(hist.filter(quiet), SPAN_S, "t").drop("_who", "_prev")


def false_alarms(found: DataFrame, incidents: DataFrame, n: int, by: list[str] = ["race"], before: float = MATCH_BEFORE_S,
                 after: float = FA_AFTER_S) -> DataFrame:
    """Adds false_alarm: the alert fits no incident from 60 s before it to 60 s after its last message."""
    key = [*by, "id"]
    hits = found.select(*key, F.col("t").alias("t_hit"), F.col("msector").alias("hit_sector"))
    inc = incidents.select("race", "incident", "t", "t_last", "sectors")
    fits = match_incidents(inc, hits, n, before, after, "t_last").select(*key).distinct()
    return found.join(fits.withColumn("_fits", F.lit(True)), key, "left").withColumn(
        "false_alarm", F.col("_fits").isNull()).drop("_fits")


def held_stops(df: DataFrame, dets: DataFrame, by: list[str] = ["race"], max_hold: float = MAX_HOLD_S) -> DataFrame:
    """(by, id, msector, t0, t1): each STOPPED from its start until the car moves, pits or falls
    silent, at most `max_hold` seconds, at the latest the end of its data."""
    stops = dets.filter("type = 'STOPPED'").select(*by, "id", "msector", F.get("drivers", F.lit(0)).alias("drv"), F.col("t").alias("t0"))
    over = (F.col("speed") > MOVING_KMH) | F.col("in_pit") | F.col("speed").isNull()
    rows = df.select("race", "drv", "t", over.alias("_over"))
    spans = stops.withColumn("hi", F.col("t0") + max_hold)
    after = interval_join(rows, spans, ["race", "drv"], "t", "t0", "hi", 256.0).filter("t > t0")
    ends = after.groupBy(*by, "id").agg(F.min(F.when(F.col("_over"), F.col("t"))).alias("_end"), F.max("t").alias("_last"))
    out = stops.join(ends, [*by, "id"], "left")
    return out.select(*by, "id", "msector", "t0", F.coalesce("_end", F.least(F.col("_last"), F.col("t0") + max_hold), "t0").alias("t1"))


def incident_scores(df: DataFrame, incidents: DataFrame, dets: DataFrame, n: int, by: list[str] = ["race"],
                    max_hold: float = MAX_HOLD_S, before: float = MATCH_BEFORE_S, after: float = MATCH_AFTER_S,
                    systems: DataFrame | None = None) -> DataFrame:
    """One row per (by, incident): matched, held, lead_s and the first detection that hit it. With more
    keys than the race (a system, a candidate) every one of them is scored in every race, also where it
    detected nothing: `systems` lists them; without it, those that detect anything anywhere."""
    hits = dets.select(*by, "id", "type", F.col("t").alias("t_hit"), F.col("msector").alias("hit_sector"))
    inc = incidents.select("race", "incident", "t", "t_last", "top_flag", "sectors", "track_wide")
    fits = match_incidents(inc, hits, n, before, after).groupBy(*by, "incident").agg(
        F.min(F.struct("t_hit", "id", "type")).alias("hit"))
    held = held_stops(df, dets, by, max_hold).select(*by, F.col("msector").alias("stop_sector"), "t0", "t1")
    at = inc.select("race", "incident", "t", "sectors")
    over = interval_join(at, held, ["race"], "t", "t0", "t1", 256.0, extra=in_sectors(F.col("stop_sector"), F.col("sectors"), n))
    over = over.select(*by, "incident").distinct().withColumn("_held", F.lit(True))
    extra = [k for k in by if k != "race"]
    every = inc if not extra else with_systems(inc, (dets if systems is None else systems).select(*extra))
    out = every.join(fits, [*by, "incident"], "left").join(over, [*by, "incident"], "left")
    was_held = F.col("hit").isNull() & F.coalesce("_held", F.lit(False))
    return out.select(*by, "incident", F.col("t").alias("t_official"), F.col("top_flag").alias("flag"),
                      (F.col("hit").isNotNull() | was_held).alias("matched"), was_held.alias("held"),
                      F.round(F.col("t") - F.col("hit.t_hit"), 2).alias("lead_s"), F.col("hit.type").alias("our_type"),
                      F.col("hit.id").alias("our_id"))


def with_systems(rows: DataFrame, systems: DataFrame) -> DataFrame:
    """Every row once per system; the systems are a short list, which travels as one array."""
    listed = systems.distinct().agg(F.array_sort(F.collect_list(F.struct(*systems.columns))).alias("_systems"))
    return beside(rows, listed).withColumn("_system", F.explode("_systems")).select(*rows.columns, "_system.*")


def race_hours(df: DataFrame) -> DataFrame:
    """(race, hours): time outside suspensions. A tick lasts until the next one."""
    ticks = df.groupBy("race", "tick").agg(F.first("t").alias("t"), F.first("suspended").alias("suspended"))
    ticks = running(ticks, ["race"], chunk_of("tick", 4096), ["tick"], nexts={"_next": F.col("t")})
    dt = F.when(~F.col("suspended"), F.coalesce("_next", "t") - F.col("t"))
    return ticks.groupBy("race").agg((F.coalesce(F.sum(dt), F.lit(0.0)) / 3600).alias("hours"))


def ratio(a, b) -> Column:
    return F.try_divide(a if isinstance(a, Column) else F.col(a), (b if isinstance(b, Column) else F.col(b)).cast("double"))


def race_summary(scores: DataFrame, marked: DataFrame, hours: DataFrame, by: list[str] = ["race"], systems: DataFrame | None = None) -> DataFrame:
    """Per (by): incidents, matched, held, recall, median lead, alerts, false alarms per hour. Races with
    neither incidents nor alerts are there with their hours."""
    s = scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("incidents"), F.count_if("matched").alias("matched"), F.count_if("held").alias("held"),
        F.percentile("lead_s", 0.5).alias("median_lead_s"), F.count_if(F.col("lead_s") > 0).alias("earlier"),
        F.count("lead_s").alias("leads"))
    a = marked.groupBy(*by).agg(F.count(F.lit(1)).alias("alerts"), F.count_if("false_alarm").alias("false_alarms"))
    extra = [k for k in by if k != "race"]
    if extra:
        named = (scores.select(*extra).unionByName(marked.select(*extra)) if systems is None else systems.select(*extra))
        hours = with_systems(hours, named)
    out = s.join(a, by, "full").join(hours, by, "full").fillna(0, ["incidents", "matched", "held", "earlier", "leads", "alerts",
                                                                     "false_alarms"])
    return out.withColumns({"recall": ratio("matched", "incidents"),
                            "recall_window": ratio(F.col("matched") - F.col("held"), "incidents"),
                            "fa_per_hour": ratio("false_alarms", "hours")})


def totals(per_race: DataFrame, scores: DataFrame, by: list[str]) -> DataFrame:
    """Totals over races for each value of `by` (for example a system)."""
    leads = scores.groupBy(*by).agg(F.percentile("lead_s", 0.5).alias("median_lead_s"),
                                    F.avg(F.when(F.col("lead_s").isNotNull(), (F.col("lead_s") > 0).cast("double"))).alias("earlier_share"))
    sums = per_race.groupBy(*by).agg(F.count(F.lit(1)).alias("races"), *[F.sum(c).alias(c) for c in
                                     ("incidents", "matched", "held", "false_alarms", "hours")])
    return sums.join(leads, by, "left").withColumns({
        "recall": ratio("matched", "incidents"), "recall_window": ratio(F.col("matched") - F.col("held"), "incidents"),
        "fa_per_hour": ratio("false_alarms", "hours")})


def score_levels(scores: DataFrame, marked: DataFrame, hours: DataFrame, by: list[str] = ["system"]) -> DataFrame:
    """Race rows, totals of every system and the whole, from one aggregation over grouping sets of (by, race).

    `level` is 0 for a race, 1 for a system, and has one more bit set for each further column of `by` that is summed over. Counts, hours and
    the exact median of the leads belong to the level's own rows; a race without incidents or alerts is there with its hours. `hours` holds
    one row per (by, race)."""
    one = F.lit(1)
    facts = scores.select(*by, "race", one.alias("_inc"), F.col("matched").cast("int").alias("_hit"), F.col("held").cast("int").alias("_held"), "lead_s")
    facts = facts.unionByName(marked.select(*by, "race", one.alias("_alert"), F.col("false_alarm").cast("int").alias("_false")), allowMissingColumns=True)
    facts = facts.unionByName(hours.select(*by, "race", "hours"), allowMissingColumns=True)
    count = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = facts.rollup(*by, "race").agg(
        F.grouping_id().cast("int").alias("level"), F.count("hours").alias("races"), count("_inc").alias("incidents"), count("_hit").alias("matched"),
        count("_held").alias("held"), count("_alert").alias("alerts"), count("_false").alias("false_alarms"), F.sum("hours").alias("hours"),
        F.percentile("lead_s", 0.5).alias("median_lead_s"), F.count_if(F.col("lead_s") > 0).alias("earlier"), F.count("lead_s").alias("leads"))
    return out.withColumns({"recall": ratio("matched", "incidents"), "recall_window": ratio(F.col("matched") - F.col("held"), "incidents"),
                            "earlier_share": ratio("earlier", "leads"), "fa_per_hour": ratio("false_alarms", "hours")})


def alerts_by_type(marked: DataFrame, by: list[str] = []) -> DataFrame:
    return marked.groupBy(*by, "type").agg(F.count(F.lit(1)).alias("alerts"), F.count_if("false_alarm").alias("false_alarms"))


# ---- choosing settings

def choose(per_race: DataFrame, budget: Column | float, by: list[str]) -> DataFrame:
    """Per `by`: the candidate with the most matched incidents within the false-alarm budget (ties:
    fewer false alarms, then the lower number); with none within it, the fewest false alarms."""
    c = per_race.groupBy(*by, "cand").agg(*[F.sum(x).alias(x) for x in ("matched", "false_alarms", "hours")])
    rate = ratio("false_alarms", "hours")
    inside = F.coalesce(rate <= budget, F.lit(False))
    best = F.struct(F.when(inside, 0).otherwise(1).alias("a"), F.when(inside, -F.col("matched")).otherwise(0).alias("b"),
                    F.coalesce(rate, F.lit(1e300)).alias("c"), F.col("cand").alias("d"))
    return c.groupBy(*by).agg(F.min_by("cand", best).alias("cand"))


def leave_one_out(per_race: DataFrame, budgets: list[float], by: list[str] = ["system"]) -> DataFrame:
    """For every race the setting is chosen on the other races: each candidate's totals minus the race's
    own row. (by, budget, race, cand, and the race's own scores under that candidate.) Holdout races are refused."""
    assert_no_holdout(per_race)
    sums = ("matched", "false_alarms", "hours")
    whole = per_race.groupBy(*by, "cand").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    rest = per_race.join(whole, [*by, "cand"]).withColumns({c: F.col(f"_{c}") - F.col(c) for c in sums})
    rest = rest.withColumn("budget", F.explode(F.array(*[F.lit(float(b)) for b in budgets])))
    picked = choose(rest.select(*by, "budget", "race", "cand", *sums), F.col("budget"), [*by, "budget", "race"])
    return picked.join(per_race, [*by, "race", "cand"])
