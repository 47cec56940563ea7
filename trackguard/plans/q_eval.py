"""Scoring against official incidents (H operators)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from trackguard.functions.stats import exact_quantile_per
from trackguard.functions.timeline import interval_join
from trackguard.operators import detectors as DE, escalation as ES, exposure as EX, flags as FL, incidents as IN, onset as ON, report as RP, risk as RI, scoring as SC
from trackguard.operators.folds import other_races, races_of
from trackguard.operators.params import BASELINE_KMH, candidate_grid
from trackguard.plans import tables as T
from trackguard.plans.registry import query, with_tables
from trackguard.plans.sqlparts import INC, NAIVE, ONSETS, OWN, PARTS, SCORES, TICKS
from trackguard.session import stored
from trackguard.sources import adapter as AD
from trackguard.sources.readers import assert_no_holdout, check_races

N = AD.SECTORS
SPAN = {"before": 1.0, "after": 0.25}


def sql(names: list[str], body: str) -> str:
    return with_tables(PARTS, names, body)


def text(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


# ---- incidents and matching

@query("h1_incident_grouping")
def _(spark, sf):
    return T.incidents(spark, sf).select("race", "incident", "t", "t_last", "top_flag", text("sectors"), "track_wide", "messages")


@query("h1_gap_incidents", sql(["grid"] + INC, """
    SELECT i.race, i.incident, i.t, i.t_last, i.top_flag, i.wide AS track_wide, i.messages,
           coalesce((SELECT string_agg(DISTINCT m.msector, ',' ORDER BY m.msector) FROM gapmsgs m WHERE m.race = i.race AND m.incident = i.incident), '') AS sectors
    FROM gapinc i"""))
def _(spark, sf):
    return T.gap_incidents(spark, sf).select("race", "incident", "t", "t_last", "top_flag", text("sectors"), "track_wide", "messages")


@query("h2_alert_match", sql(SCORES[:SCORES.index("gapsec") + 1], """
    SELECT DISTINCT i.race, i.incident, n.id FROM gapinc i JOIN gapsec s USING (race, incident)
    JOIN naive n ON n.race = i.race AND n.msector = s.msector AND n.t BETWEEN i.t - 1 AND i.t + 0.25"""))
def _(spark, sf):
    hits = T.naive(spark, sf).select("race", "id", F.col("t").alias("t_hit"), F.col("msector").alias("hit_sector"))
    return IN.match_incidents(T.gap_incidents(spark, sf), hits, N, **SPAN).select("race", "incident", "id")


@query("h3_suspended_asof", sql(TICKS + ["official"], """
    SELECT o.event_id, coalesce(k.suspended, f.s) AS suspended FROM (SELECT *, t - 0.1 AS q FROM official) o
    ASOF LEFT JOIN ticks k ON k.race = o.race AND k.t <= o.q
    JOIN (SELECT race, arg_min(suspended, t) AS s FROM ticks GROUP BY race) f ON f.race = o.race"""))
def _(spark, sf):
    off = T.official(spark, sf).withColumn("t", F.col("t") - 0.1)
    return IN.suspended_at(off, T.paces(spark, sf)).select("event_id", "suspended")


@query("h4_alert_collapse", sql(NAIVE + ["nalerts"], "SELECT race, id, t, drv, msector FROM nalerts"))
def _(spark, sf):
    return SC.alerts(T.naive(spark, sf), gap=5.0).select("race", "id", "t", F.get("drivers", F.lit(0)).alias("drv"), "msector")


def marked(spark, sf):
    return SC.false_alarms(SC.alerts(T.naive(spark, sf), gap=5.0), T.gap_incidents(spark, sf), N, before=1.0, after=0.5)


def scores(spark, sf):
    return SC.incident_scores(T.paces(spark, sf), T.gap_incidents(spark, sf), T.naive(spark, sf), N, max_hold=3.0, **SPAN)


@query("h5_false_alarms", sql([n for n in SCORES if n not in ("held", "scores", "hours")], "SELECT race, id, false_alarm FROM marked"))
def _(spark, sf):
    return marked(spark, sf).select("race", "id", "false_alarm")


@query("h6_held_stops", sql(NAIVE + ["held"], "SELECT race, id, msector, t0, t1 FROM held"))
def _(spark, sf):
    return SC.held_stops(T.paces(spark, sf), T.naive(spark, sf), max_hold=3.0)


@query("h7_incident_scores", sql([n for n in SCORES if n not in ("nalerts", "marked", "hours")],
                                 "SELECT race, incident, t_official, flag, matched, held, lead_s, our_id FROM scores"))
def _(spark, sf):
    return scores(spark, sf).drop("our_type")


@query("h8_race_hours", sql(TICKS + ["hours"], "SELECT race, round(hours, 8) AS hours FROM hours"))
def _(spark, sf):
    return SC.race_hours(T.paces(spark, sf)).withColumn("hours", F.round("hours", 8))


_PER_RACE = """perrace AS (
    SELECT s.race, s.incidents, s.matched, s.held, s.earlier, s.leads, s.median_lead_s, coalesce(a.alerts, 0) AS alerts,
           coalesce(a.false_alarms, 0) AS false_alarms, h.hours
    FROM (SELECT race, count(*) AS incidents, count(*) FILTER (matched) AS matched, count(*) FILTER (held) AS held,
                 count(*) FILTER (lead_s > 0) AS earlier, count(lead_s) AS leads, median(lead_s) AS median_lead_s FROM scores GROUP BY race) s
    LEFT JOIN (SELECT race, count(*) AS alerts, count(*) FILTER (false_alarm) AS false_alarms FROM marked GROUP BY race) a USING (race)
    JOIN hours h USING (race))"""


def race_rows(spark, sf):
    return SC.race_summary(scores(spark, sf), marked(spark, sf), SC.race_hours(T.paces(spark, sf)))


@query("h9_race_summary", sql(SCORES, "") + f""", {_PER_RACE} SELECT race, incidents, matched, held, alerts, false_alarms, earlier,
    round(median_lead_s, 4) AS median_lead_s, round(matched / incidents, 6) AS recall, round((matched - held) / incidents, 6) AS recall_window,
    round(false_alarms / hours, 4) AS fa_per_hour FROM perrace""")
def _(spark, sf):
    r = race_rows(spark, sf)
    return r.select("race", "incidents", "matched", "held", "alerts", "false_alarms", "earlier", F.round("median_lead_s", 4).alias("median_lead_s"),
                    *[F.round(c, 6).alias(c) for c in ("recall", "recall_window")], F.round("fa_per_hour", 4).alias("fa_per_hour"))


@query("h9_totals", sql(SCORES, "") + f""", {_PER_RACE} SELECT 'baseline' AS system, count(*) AS races, sum(incidents)::BIGINT AS incidents,
    sum(matched)::BIGINT AS matched, sum(held)::BIGINT AS held, sum(false_alarms)::BIGINT AS false_alarms,
    (SELECT round(median(lead_s), 4) FROM scores) AS median_lead_s, (SELECT round(avg((lead_s > 0)::INT::DOUBLE), 6) FROM scores) AS earlier_share,
    round(sum(matched) / sum(incidents), 6) AS recall, round(sum(false_alarms) / sum(hours), 4) AS fa_per_hour FROM perrace""")
def _(spark, sf):
    sys = F.lit("baseline")
    out = SC.totals(race_rows(spark, sf).withColumn("system", sys), scores(spark, sf).withColumn("system", sys), ["system"])
    return out.select("system", "races", "incidents", "matched", "held", "false_alarms", F.round("median_lead_s", 4).alias("median_lead_s"),
                      F.round("earlier_share", 6).alias("earlier_share"), F.round("recall", 6).alias("recall"),
                      F.round("fa_per_hour", 4).alias("fa_per_hour"))


def two_systems(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two systems: the baseline detector, and one that detects nothing."""
    hours = SC.race_hours(T.paces(spark, sf))
    named = lambda df, name: df.withColumn("system", F.lit(name))
    none = scores(spark, sf).withColumns({"matched": F.lit(False), "held": F.lit(False), "lead_s": F.lit(None).cast("double")})
    return (named(scores(spark, sf), "baseline").unionByName(named(none, "none")), named(marked(spark, sf), "baseline"),
            named(hours, "baseline").unionByName(named(hours, "none")))


@query("h9_h10_levels", sql(SCORES, "") + """, facts AS (
    SELECT 'baseline' AS system, race, 1 AS i, matched::INT AS m, held::INT AS h, lead_s, NULL::INT AS a, NULL::INT AS f, NULL::DOUBLE AS hours FROM scores
    UNION ALL SELECT 'none', race, 1, 0, 0, NULL, NULL, NULL, NULL FROM scores
    UNION ALL SELECT 'baseline', race, NULL, NULL, NULL, NULL, 1, false_alarm::INT, NULL FROM marked
    UNION ALL SELECT s, race, NULL, NULL, NULL, NULL, NULL, NULL, hours FROM hours, (VALUES ('baseline'), ('none')) v(s))
    SELECT CAST(GROUPING(system, race) AS INT) AS level, system, race, count(hours) AS races, coalesce(sum(i), 0)::BIGINT AS incidents, coalesce(sum(m), 0)::BIGINT AS matched,
           coalesce(sum(h), 0)::BIGINT AS held, coalesce(sum(a), 0)::BIGINT AS alerts, coalesce(sum(f), 0)::BIGINT AS false_alarms, round(sum(hours), 8) AS hours,
           round(median(lead_s), 4) AS median_lead_s, round(sum(m) / nullif(sum(i), 0), 6) AS recall, round((sum(m) - sum(h)) / nullif(sum(i), 0), 6) AS recall_window,
           round(count(*) FILTER (lead_s > 0) / nullif(count(lead_s), 0), 6) AS earlier_share, round(coalesce(sum(f), 0) / sum(hours), 4) AS fa_per_hour
    FROM facts GROUP BY ROLLUP (system, race)""")
def _(spark, sf):
    out = SC.score_levels(*two_systems(spark, sf))
    return out.select("level", "system", "race", "races", "incidents", "matched", "held", "alerts", "false_alarms", F.round("hours", 8).alias("hours"),
                      F.round("median_lead_s", 4).alias("median_lead_s"), *[F.round(c, 6).alias(c) for c in ("recall", "recall_window", "earlier_share")],
                      F.round("fa_per_hour", 4).alias("fa_per_hour"))


@query("h10_alerts_by_type", sql([n for n in SCORES if n not in ("held", "scores", "hours")], """
    SELECT 'STOPPED' AS type, race, count(*) AS alerts, count(*) FILTER (false_alarm) AS false_alarms FROM marked GROUP BY race"""))
def _(spark, sf):
    return SC.alerts_by_type(marked(spark, sf), ["race"])


@query("h10_race_by_system_pivot", sql(NAIVE + ["nalerts"], """
    SELECT race, count(*) FILTER (msector <= 5) AS first_half, count(*) FILTER (msector > 5) AS second_half FROM nalerts GROUP BY race"""))
def _(spark, sf):
    half = F.when(F.col("msector") <= 5, "first_half").otherwise("second_half")
    found = SC.alerts(T.naive(spark, sf), gap=5.0).withColumn("half", half)
    return found.groupBy("race").pivot("half", ["first_half", "second_half"]).count().fillna(0)


@query("h11_advisory_split", """SELECT event_id, event_type <> 'error' AS is_rule FROM events""")
def _(spark, sf):
    ev = AD.table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "error", "ANOMALY").otherwise("STOPPED").alias("type"))
    return (SC.rule_alerts(ev).select("event_id", F.lit(True).alias("is_rule"))
            .unionByName(SC.advisories(ev).select("event_id", F.lit(False).alias("is_rule"))))


# ---- choosing settings

_SWEEP = """sweep AS (SELECT concat('R', CAST(user_id % 4 AS VARCHAR)) AS race, CAST(event_id % 6 AS INT) AS cand,
    count(*) FILTER (event_type = 'signup') AS matched, count(*) FILTER (event_type = 'error') AS false_alarms, count(*) / 100.0::DOUBLE AS hours
    FROM events GROUP BY ALL)"""


def sweep(spark, sf):
    ev = AD.table(spark, sf, "events")
    return ev.groupBy(F.concat(F.lit("R"), (F.col("user_id") % 4).cast("string")).alias("race"), (F.col("event_id") % 6).cast("int").alias("cand")).agg(
        F.count_if(F.col("event_type") == "signup").alias("matched"), F.count_if(F.col("event_type") == "error").alias("false_alarms"),
        (F.count(F.lit(1)) / 100.0).alias("hours")).withColumn("system", F.lit("detectors"))


_BEST = "CASE WHEN fa / h <= budget THEN 0 ELSE 1 END, CASE WHEN fa / h <= budget THEN -m ELSE 0 END, fa / h, cand"


@query("h13_choose_setting", f"""WITH {_SWEEP}, c AS (SELECT cand, sum(matched) AS m, sum(false_alarms) AS fa, sum(hours) AS h, b.budget FROM sweep,
    (SELECT unnest([19.0, 20.0, 25.0])::DOUBLE AS budget) b GROUP BY ALL)
    SELECT budget, cand FROM (SELECT *, row_number() OVER (PARTITION BY budget ORDER BY {_BEST}) AS n FROM c) q WHERE n = 1""")
def _(spark, sf):
    rows = sweep(spark, sf).withColumn("budget", F.explode(F.array(*[F.lit(b) for b in (19.0, 20.0, 25.0)])))
    return SC.choose(rows, F.col("budget"), ["budget"])


@query("h14_leave_one_race_out", f"""WITH {_SWEEP}, r AS (SELECT a.race, a.cand, sum(b.matched) AS m, sum(b.false_alarms) AS fa, sum(b.hours) AS h, k.budget
    FROM sweep a JOIN sweep b ON b.cand = a.cand AND b.race <> a.race, (SELECT unnest([19.0, 20.0, 25.0])::DOUBLE AS budget) k GROUP BY ALL)
    SELECT q.budget, q.race, q.cand, s.matched, s.false_alarms FROM (SELECT *, row_number() OVER (PARTITION BY budget, race ORDER BY {_BEST}) AS n FROM r) q
    JOIN sweep s USING (race, cand) WHERE n = 1""")
def _(spark, sf):
    return SC.leave_one_out(sweep(spark, sf), [19.0, 20.0, 25.0]).select("budget", "race", "cand", "matched", "false_alarms")


BUDGETS = (600.0, 900.0, 1500.0)   # 2, 3 and 5 false alarms per hour, for races of 20 seconds instead of 100 minutes


@T.kept("setting_scores")
def setting_scores(spark, sf):
    """Every setting of the detectors and of the baseline on every race."""
    f = assert_no_holdout(T.features(spark, sf))
    grids = {"detectors": candidate_grid(), "baseline": [{"kmh": k} for k in BASELINE_KMH]}
    found = {"detectors": SC.rule_alerts(DE.detect(f, T.SCALED, N, settings=grids["detectors"])),
             "baseline": DE.naive(f, **{**T.NAIVE_SET, "kmh": BASELINE_KMH})}
    rows = [d.withColumn("system", F.lit(s)).select("system", "cand", "race", "id", "t", "drivers", "msector", "type") for s, d in found.items()]
    dets = stored(rows[0].unionByName(rows[1]))
    by = ["system", "cand", "race"]
    marked = SC.false_alarms(SC.alerts(dets, by, 5.0), T.gap_incidents(spark, sf), N, by, 1.0, 0.5)
    systems = spark.createDataFrame([(s, i) for s, g in grids.items() for i in range(len(g))], "system string, cand int")
    s = SC.incident_scores(f, T.gap_incidents(spark, sf), dets, N, by, 3.0, systems=systems, **SPAN)
    return SC.race_summary(s, marked, SC.race_hours(f), by, systems)


@query("h12_baseline_grid")
def _(spark, sf):
    """The 36 detector settings and the 4 of the baseline on every race: matches, leads and false alarms."""
    return setting_scores(spark, sf).select("system", "cand", "race", "incidents", "matched", "held", "leads", "earlier", "median_lead_s", "alerts",
                                            "false_alarms", "hours", "recall", "recall_window", "fa_per_hour")


@query("h13_tuned_setting")
def _(spark, sf):
    """The setting of each system chosen from the scores of h12, per budget."""
    rows = setting_scores(spark, sf).withColumn("budget", F.explode(F.array(*[F.lit(b) for b in BUDGETS])))
    return SC.choose(rows, F.col("budget"), ["system", "budget"])


@query("h14_tuned_leave_one_race_out")
def _(spark, sf):
    """Each race under the settings chosen from the scores of h12 on the other races."""
    return SC.leave_one_out(setting_scores(spark, sf), list(BUDGETS)).select(
        "system", "budget", "race", "cand", "incidents", "matched", "held", "leads", "median_lead_s", "false_alarms", "hours")


# ---- onset and latency

@query("h15_h16_own_reference", sql(OWN, "SELECT race, drv, tick, round(own_ref + 1e-9, 4) AS own_ref, round(own_ratio + 1e-9, 4) AS own_ratio FROM own"))
def _(spark, sf):
    o = ON.own_reference(T.features(spark, sf), AD.LENGTH, **T.LAP_RULES)
    return o.select("race", "drv", "tick", *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("own_ref", "own_ratio")])


@query("h17_onsets", sql(OWN + ["onsets"], "SELECT race, drv, tick, t, dist, msector FROM onsets"))
def _(spark, sf):
    return ON.onsets(T.own(spark, sf), **T.ONSET_SET).select("race", "drv", "tick", "t", "dist", "msector")


def cands(spark, sf):
    return ON.candidates(T.gap_incidents(spark, sf), T.onsets(spark, sf), N, 5.0, 2.0)


@query("h18_onset_candidates", sql(ONSETS[:ONSETS.index("onsetcands") + 1], "SELECT race, incident, drv AS onset_drv, t_hit FROM onsetcands"))
def _(spark, sf):
    return cands(spark, sf).select("race", "incident", "onset_drv", "t_hit")


@query("h19_pick_onset", sql([n for n in ONSETS if n != "onsetcars"], "SELECT race, incident, t_onset, onset_drv, onset_sector FROM picked"))
def _(spark, sf):
    return ON.pick_onset(cands(spark, sf), gap=1.0).select("race", "incident", "t_onset", "onset_drv", "onset_sector")


@query("h20_onset_cars", sql(ONSETS, "SELECT race, incident, cars FROM onsetcars"))
def _(spark, sf):
    c = cands(spark, sf)
    return ON.onset_cars(c, ON.pick_onset(c, gap=1.0)).select("race", "incident", text("cars"))


@query("h21_no_onset_reason", sql(OWN + INC, """
    SELECT i.race, i.incident, CASE WHEN f.st IS NULL THEN 'no data at the official time' WHEN f.lap <= 2 THEN 'lap 1 or 2: no clean reference laps yet'
           WHEN f.slow THEN 'car already slow or stopped before the window (re-flag of an earlier stoppage)'
           WHEN f.st NOT IN ('1', '2') OR coalesce(f.med < 0.8, false) THEN 'field not racing (SC, VSC, restart or procession)'
           ELSE 'no car collapsed below 50% (debris, weather, or a car that went off and kept going)' END AS reason
    FROM gapinc i LEFT JOIN (
        SELECT i.race, i.incident, arg_min(o.drv_lap, {t: o.t, d: o.drv}) AS lap, arg_min(o.track_status, {t: o.t, d: o.drv}) AS st,
               median(CASE WHEN o.speed IS NOT NULL AND NOT o.in_pit THEN o.own_ratio END) AS med,
               bool_or(coalesce(o.speed IS NOT NULL AND NOT o.in_pit AND s.msector IS NOT NULL AND (coalesce(o.own_ratio < 0.5, false) OR o.speed < 20), false)) AS slow
        FROM gapinc i JOIN own o ON o.race = i.race AND abs(o.t - i.t) < 0.13
        LEFT JOIN gapsec s ON s.race = i.race AND s.incident = i.incident AND s.msector = o.msector GROUP BY ALL) f USING (race, incident)"""))
def _(spark, sf):
    return ON.no_onset_reason(T.own(spark, sf), T.gap_incidents(spark, sf), N)


_LATENCY = """firsts AS (SELECT race, incident, flag, min(t) AS t_official FROM gapmsgs GROUP BY ALL),
alert AS (SELECT p.race, p.incident, min(n.t) AS t FROM picked p JOIN onsetcars c USING (race, incident)
    JOIN naive n ON n.race = p.race AND n.t BETWEEN p.t_onset - 10 AND p.t_onset + 180
    WHERE list_contains(string_split(c.cars, ','), n.drv) OR EXISTS (SELECT 1 FROM gapsec s WHERE s.race = p.race AND s.incident = p.incident AND s.msector = n.msector)
    GROUP BY ALL),
lat AS (SELECT p.race, p.incident, f.flag, p.t_onset, p.onset_drv AS onset_car, f.t_official, round(f.t_official - p.t_onset, 2) AS rc_latency_s,
    round(a.t - p.t_onset, 2) AS our_latency_s, round(f.t_official - a.t, 2) AS lead_s,
    EXISTS (SELECT 1 FROM grid g WHERE g.race = p.race AND g.drv = p.onset_drv AND g.in_pit AND g.t > p.t_onset AND g.t <= p.t_onset + 20) AS onset_car_pitted_20s
    FROM picked p JOIN firsts f USING (race, incident) LEFT JOIN alert a USING (race, incident))"""
_LAT_TABLES = NAIVE + [n for n in ONSETS if n not in NAIVE]


def latency(spark, sf):
    return ON.latency_events(T.own(spark, sf), T.gap_messages(spark, sf), T.gap_incidents(spark, sf), T.onsets(spark, sf), T.naive(spark, sf), N, 5.0, 2.0)


@query("h22_latency_events", sql(_LAT_TABLES, "").replace("< 1 THEN 0 ELSE 1 END AS brk", "< 10 THEN 0 ELSE 1 END AS brk") + f""", {_LATENCY}
    SELECT race, incident, flag, t_onset, onset_car, t_official, rc_latency_s, our_latency_s, lead_s, onset_car_pitted_20s FROM lat""")
def _(spark, sf):
    return latency(spark, sf).drop("cars", "our_alert_type")


@query("h23_latency_summary", sql(_LAT_TABLES, "").replace("< 1 THEN 0 ELSE 1 END AS brk", "< 10 THEN 0 ELSE 1 END AS brk") + f""", {_LATENCY}
    SELECT flag, count(*) AS events, count(our_latency_s) AS matched, round(quantile_cont(rc_latency_s, 0.25), 6) AS rc_p25_s,
           round(median(rc_latency_s), 6) AS rc_median_s, round(quantile_cont(rc_latency_s, 0.75), 6) AS rc_p75_s, round(median(our_latency_s), 6) AS ours_median_s,
           round(avg(CASE WHEN our_latency_s IS NOT NULL THEN (lead_s > 0)::INT::DOUBLE END), 6) AS earlier_share FROM lat GROUP BY flag""")
def _(spark, sf):
    s = ON.latency_summary(latency(spark, sf), "flag")
    return s.select("flag", "events", "matched", *[F.round(c, 6).alias(c) for c in ("rc_p25_s", "rc_median_s", "rc_p75_s", "ours_median_s", "earlier_share")])


# ---- escalation

_CALLS = ["grid", "calls", "levels", "escs"]


def calls(spark, sf):
    """Calls on a fixed share of the rows: recommendations that SQL can state as well."""
    g = T.grid(spark, sf).filter("event_id % 37 = 0")
    k = F.floor(F.col("event_id") / 37) % 6
    names = F.array(*[F.lit(f) for f in ("YELLOW", "DOUBLE_YELLOW", "VSC", "SC", "RED", "CLEAR")])
    clear = (k == 5) & (F.floor(F.col("event_id") / 37) % 12 < 6)
    return g.select("race", "t", F.concat(F.lit("c"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("id"), "msector",
                    F.get(names, k.cast("int")).alias("flag"), F.when(clear, "TRACK CLEAR").otherwise("call").alias("message"),
                    F.lit("call").alias("reason"))


@query("h24_escalation_recs", sql(_CALLS, "SELECT race, id, t, flag FROM escs"))
def _(spark, sf):
    return ES.escalation_recs(calls(spark, sf)).select("race", "id", "t", "flag")


@query("h25_track_flag_at", sql(["grid", "official", "calls", "levels"], """
    SELECT o.event_id, c.flag AS our_flag, c.t AS our_since, c.msector AS our_cause, c.red_since AS our_red_since FROM official o
    ASOF LEFT JOIN (SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY race, t ORDER BY id DESC) AS nth,
               CASE WHEN flag = 'RED' THEN min(CASE WHEN flag = 'RED' THEN t END) OVER (PARTITION BY race, b ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS red_since
        FROM (SELECT *, sum(CASE WHEN flag = 'RED' THEN 0 ELSE 1 END) OVER (PARTITION BY race ORDER BY t, id) AS b FROM levels) q) q WHERE nth = 1) c
    ON c.race = o.race AND c.t <= o.t"""))
def _(spark, sf):
    out = ES.track_flag_at(T.official(spark, sf), "t", ES.track_changes(calls(spark, sf)))
    return out.select("event_id", "our_flag", "our_since", "our_cause", "our_red_since")


@query("h26_official_state", sql(TICKS + ["calls"], """
    SELECT c.id, k.track_status AS status, k.track_status IN ('4', '5', '6', '7') OR k.suspended AS neutral FROM calls c
    ASOF JOIN ticks k ON k.race = c.race AND k.t <= c.t"""))
def _(spark, sf):
    return ES.official_state(calls(spark, sf), "t", T.features(spark, sf)).select("id", "status", "neutral")


_OURS = """up AS (SELECT race, incident, min(CASE WHEN flag IN ('VSC', 'SC', 'RED') THEN t END) AS up FROM gapmsgs GROUP BY ALL),
fits AS (SELECT e.race, e.id, bool_or(coalesce(e.t <= u.up + 60, false)) AS matched, bool_or(e.t <= i.t_last + 60 AND u.up IS NOT NULL) AS escalated,
         count(*) FILTER (e.t <= i.t_last + 60) AS n
    FROM escs e JOIN gapinc i ON i.race = e.race JOIN up u ON u.race = i.race AND u.incident = i.incident
    JOIN gapsec s ON s.race = i.race AND s.incident = i.incident AND s.msector = e.msector
    WHERE e.t BETWEEN i.t - 60 AND greatest(i.t_last + 60, coalesce(u.up + 60, i.t_last)) GROUP BY ALL),
ours AS (SELECT e.race, e.id, e.flag, e.t, CASE WHEN e.flag = 'RED' THEN k.track_status = '5' OR EXISTS (SELECT 1 FROM official o WHERE o.race = e.race
         AND o.flag = 'RED' AND o.t BETWEEN e.t - 60 AND e.t + 1200) END AS rc_red, coalesce(f.matched, false) AS matched,
         k.track_status IN ('4', '5', '6', '7') OR k.suspended AS neutral, coalesce(f.escalated, false) AS escalated, coalesce(f.n, 0) AS n
    FROM escs e ASOF JOIN ticks k ON k.race = e.race AND k.t <= e.t LEFT JOIN fits f ON f.race = e.race AND f.id = e.id)"""


def ours(spark, sf):
    return ES.our_side(T.features(spark, sf), T.gap_messages(spark, sf), T.gap_incidents(spark, sf), T.official(spark, sf),
                       ES.escalation_recs(calls(spark, sf)), N)


@query("h28_our_categories", sql(TICKS + INC + _CALLS[1:], "") + f""", {_OURS} SELECT race, id, flag, rc_red AS race_control_red,
    CASE WHEN matched THEN 'matched' WHEN neutral THEN CASE WHEN flag = 'RED' AND NOT rc_red THEN 'red while race control kept its SC or VSC'
         ELSE 'during an official neutralisation' END WHEN escalated THEN 'escalated incident, outside the match window'
         WHEN n > 0 THEN 'official yellows only' ELSE 'no official flag' END AS category FROM ours""")
def _(spark, sf):
    return ours(spark, sf).select("race", "id", "flag", "race_control_red", "category")


def official_rows(spark, sf):
    recs = T.recs(spark, sf)
    return ES.official_side(T.own(spark, sf), T.incident_messages(spark, sf), T.incidents(spark, sf), T.official(spark, sf), recs,
                            T.escalations(spark, sf), ES.track_changes(recs), T.onsets(spark, sf), T.detections(spark, sf), N)


@query("h27_h34_official_escalations")
def _(spark, sf):
    return official_rows(spark, sf)


@query("h29_h31_escalation_summary")
def _(spark, sf):
    return ES.official_summary(official_rows(spark, sf))


@query("h29_flag_pairs")
def _(spark, sf):
    return ES.flag_pairs(official_rows(spark, sf))


@query("h30_our_summary")
def _(spark, sf):
    own = ES.our_side(T.features(spark, sf), T.incident_messages(spark, sf), T.incidents(spark, sf), T.official(spark, sf), T.escalations(spark, sf), N)
    return ES.our_summary(own, SC.race_hours(T.features(spark, sf)))


@query("h32_stopped_offset", sql(["grid"], """
    SELECT count(*) AS stopped_rows, count(*) FILTER (abs(lat_off) <= 1) AS within_1m, count(*) FILTER (abs(lat_off) > 8) AS beyond_8m,
           count(DISTINCT CASE WHEN abs(lat_off) > 8 THEN race || drv END) AS cars_beyond_8m FROM grid WHERE speed < 5 AND NOT in_pit"""))
def _(spark, sf):
    return ES.stopped_offset(T.grid(spark, sf))


@query("h33_clears_under_neutral", sql(TICKS + ["calls"], """
    SELECT c.race, count(*) FILTER (k.track_status IN ('4', '5', '6', '7')) AS track_clears_under_neutral FROM (SELECT * FROM calls WHERE message = 'TRACK CLEAR') c
    ASOF JOIN ticks k ON k.race = c.race AND k.t <= c.t GROUP BY c.race"""))
def _(spark, sf):
    return ES.clears_under_neutral(T.features(spark, sf), calls(spark, sf))


VARIANTS = [{"red_by_time": True, "red_from_multi": True, "late_rule": False}, {"late_laps": 3}, {"late_laps": 4}, {"late_laps": 5},
            {"late_laps": 6}, {"red_by_time": True}, {"red_from_multi": True}]


@query("h36_red_rule_study")
def _(spark, sf):
    """The seven red rules on every race, all in one pass: the setting is part of the key."""
    sets = [replace(T.FLAG_SET, **v) for v in VARIANTS]
    recs = FL.recommend(T.features(spark, sf), T.detections(spark, sf), variants=sets)
    return ES.red_study(T.features(spark, sf), recs, T.official(spark, sf), before=5.0, after=1.0)


@query("h35_setting_sweep")
def _(spark, sf):
    """The escalation scorecard for several holds before a Safety Car."""
    recs = FL.recommend(T.features(spark, sf), T.detections(spark, sf), variants=[replace(T.FLAG_SET, sc_hold_s=h) for h in (0.25, 0.5, 1.0)])
    by = ["variant", "race"]
    esc = ES.escalation_recs(recs, by=by)
    off = ES.official_side(T.own(spark, sf), T.incident_messages(spark, sf), T.incidents(spark, sf), T.official(spark, sf), recs, esc,
                           ES.track_changes(recs, by=by), T.onsets(spark, sf), T.detections(spark, sf), N, by)
    return ES.official_summary(off, ["variant"])


# ---- exposure

_PLACE = """places AS (SELECT race, CAST(msector AS VARCHAR) AS place, msector * 100 - 45.0::DOUBLE AS crash_dist, msector * 0.5::DOUBLE AS t0, msector * 0.5 + 8::DOUBLE AS t1,
    min(drv) AS car FROM grid WHERE tick = 0 GROUP BY ALL),
cross0 AS (SELECT race, drv, t AS tb, lag(t) OVER w AS ta, dist AS db, lag(dist) OVER w AS da, speed AS vb, lag(speed) OVER w AS va, in_pit AS pb, lag(in_pit) OVER w AS pa,
    own_ref AS ob, lag(own_ref) OVER w AS oa FROM own WINDOW w AS (PARTITION BY race, drv ORDER BY tick)),
cross1 AS (SELECT c.*, p.place, p.t0, p.t1, ((c.db - c.da + 500) % 1000 + 1000) % 1000 - 500 AS st, ((p.crash_dist - c.da + 500) % 1000 + 1000) % 1000 - 500 AS tt
    FROM cross0 c JOIN places p ON p.race = c.race AND p.car <> c.drv WHERE c.va IS NOT NULL AND c.vb IS NOT NULL AND NOT c.pa AND NOT c.pb),
pass AS (SELECT race, place, drv AS car, t0, ta + tt / st * (tb - ta) AS tp, va + tt / st * (vb - va) AS v, coalesce(ob, oa) AS o, t1 FROM cross1
    WHERE st > 0 AND st < 150 AND tt >= 0 AND tt < st)"""


def places(spark, sf):
    g = T.grid(spark, sf).filter("tick = 0")
    s = F.col("msector")
    return g.groupBy("race", "msector").agg(F.min("drv").alias("_c")).select(
        "race", s.cast("string").alias("place"), (s * 100 - 45.0).alias("crash_dist"), (s * 0.5).cast("double").alias("t0"),
        (s * 0.5 + 8).cast("double").alias("t1"), F.array("_c").alias("cars"))


def crossings(spark, sf):
    return EX.crossings(T.own(spark, sf), places(spark, sf), AD.LENGTH)


@query("h38_crossings", sql(OWN, "") + f""", {_PLACE} SELECT race, place, car, round(tp + 1e-9, 2) AS t_pass, round(v + 1e-9, 1) AS speed_kmh
    FROM pass WHERE tp >= t0 AND tp < t1""")
def _(spark, sf):
    return crossings(spark, sf).select("race", "place", "car", "t_pass", "speed_kmh")


_FIRST = """racing AS (SELECT race, place, car, min(round(round(tp + 1e-9, 2) - t0, 2)) AS t_after FROM pass WHERE tp >= t0 AND tp < t1 AND o > 0
    AND round(100 * v / o + 1e-9, 1) >= 80 GROUP BY ALL)"""


def firsts(spark, sf):
    return EX.first_racing_passes(crossings(spark, sf))


@query("h43_first_racing_passes", sql(OWN, "") + f", {_PLACE}, {_FIRST} SELECT race, place, car, t_after FROM racing")
def _(spark, sf):
    return firsts(spark, sf)


@query("h44_delay_curve", sql(OWN, "") + f""", {_PLACE}, {_FIRST} SELECT p.race, p.place, k * 0.5::DOUBLE AS delay_s,
    (SELECT count(*) FROM racing r WHERE r.race = p.race AND r.place = p.place AND r.t_after <= k * 0.5) AS cars FROM places p, (SELECT unnest(range(121)) AS k) q""")
def _(spark, sf):
    return EX.delay_curve(firsts(spark, sf), places(spark, sf))


@query("h45_cars_by_marker", sql(OWN, "") + f""", {_PLACE}, {_FIRST} SELECT p.race, p.place, (SELECT count(*) FROM racing r WHERE r.race = p.race
    AND r.place = p.place AND r.t_after <= p.t0) AS cars_by_then FROM places p""")
def _(spark, sf):
    p = places(spark, sf)
    return EX.cars_by(firsts(spark, sf), p.withColumn("mark", F.col("t0")), "mark")


@query("h46_mean_cars_per_second", sql(OWN, "") + f""", {_PLACE}, {_FIRST} SELECT count(*) AS crashes, round(avg(n / 60.0), 6) AS cars_per_second
    FROM (SELECT p.race, p.place, (SELECT count(*) FROM racing r WHERE r.race = p.race AND r.place = p.place AND r.t_after <= 60) AS n FROM places p) q""")
def _(spark, sf):
    m = EX.mean_rate(EX.delay_curve(firsts(spark, sf), places(spark, sf)))
    return m.withColumn("cars_per_second", F.round("cars_per_second", 6))


@query("h37_rest_position", sql(["grid", "official"], """
    SELECT o.race, o.event_id, coalesce(arg_min(CASE WHEN g.speed < 5 AND NOT g.in_pit THEN g.dist END, CASE WHEN g.speed < 5 AND NOT g.in_pit THEN g.t END), any_value(o.d)) AS crash_dist
    FROM (SELECT o.race, o.event_id, o.t, g.drv, g.dist AS d FROM official o JOIN grid g USING (event_id)) o
    JOIN grid g ON g.race = o.race AND g.drv = o.drv AND g.t BETWEEN o.t AND o.t + 30 GROUP BY o.race, o.event_id"""))
def _(spark, sf):
    at = T.official(spark, sf).select("race", "event_id", F.col("t").alias("t0")).join(
        T.grid(spark, sf).select("event_id", "drv", F.col("dist").alias("onset_dist")), "event_id")
    return EX.rest_position(T.grid(spark, sf), at, ["race", "event_id"]).select("race", "event_id", "crash_dist")


@query("h39_exposure_windows")
def _(spark, sf):
    return EX.exposure_windows(T.own(spark, sf), T.marks(spark, sf), AD.LENGTH)


@query("h40_crash_timeline")
def _(spark, sf):
    return T.marks(spark, sf).withColumn("cars", F.array_join("cars", ","))


@query("h41_crash_grouping")
def _(spark, sf):
    return T.crashes(spark, sf).withColumn("cars", F.array_join("cars", ","))


@query("h42_rec_cars", sql(NAIVE, """
    SELECT n.race, n.id, array_to_string(list_sort(list_distinct([n.drv, f.drv])), ',') AS rec_cars FROM naive n
    JOIN (SELECT race, arg_min(drv, id) AS drv FROM naive GROUP BY race) f USING (race)"""))
def _(spark, sf):
    dets = T.naive(spark, sf)
    first = dets.groupBy("race").agg(F.min("id").alias("_first"))
    recs = dets.join(first, "race").select("race", "id", F.format_string("car %s stopped for 3.0 s", F.get("drivers", F.lit(0))).alias("reason"),
                                           F.array("_first").alias("source_detections"))
    return EX.rec_cars(recs, dets).withColumn("rec_cars", F.array_join("rec_cars", ","))


def message_cars(spark, sf):
    """Every official message with the car on whose row it lies, as a crash of that car."""
    cars = T.grid(spark, sf).select("event_id", F.col("drv").alias("car"))
    return T.official(spark, sf).join(cars, "event_id").select("race", F.col("event_id").alias("crash"), "car", F.col("t").alias("onset"))


_CARS = "m AS (SELECT o.race, o.event_id AS crash, o.t AS onset, g.drv AS car FROM official o JOIN grid g USING (event_id))"


@query("h47_speed_trace", sql(OWN + ["official"], "") + f""", {_CARS} SELECT m.race, m.crash, round(o.t - m.onset, 2) AS t_after_onset, round(o.speed + 1e-9, 1) AS speed_kmh,
    round(o.own_ref + 1e-9, 1) AS own_normal_kmh FROM m JOIN own o ON o.race = m.race AND o.drv = m.car AND o.t BETWEEN m.onset - 15 AND m.onset + 45""")
def _(spark, sf):
    return EX.speed_trace(T.own(spark, sf), message_cars(spark, sf))


@query("h48_listed_detections", sql(NAIVE + ["official"], "") + f""", {_CARS} SELECT * FROM (
    SELECT m.race, m.crash, round(n.t - m.onset, 2) AS t_after, n.id, CAST(row_number() OVER (PARTITION BY m.race, m.crash ORDER BY round(n.t - m.onset, 2), n.id) AS INT) AS place_in_list
    FROM m JOIN naive n ON n.race = m.race AND n.t BETWEEN m.onset - 10 AND m.onset + 180) q""")
def _(spark, sf):
    return EX.listed_detections(T.naive(spark, sf), message_cars(spark, sf))


@query("h50_race_report")
def _(spark, sf):
    """The holdout report of every race: detection, latency, risk and escalation. Scores and the high-risk line come from the other races."""
    from trackguard.plans import q_learn as L
    f, inc = T.features(spark, sf), T.incidents(spark, sf)
    races = f.select("race").distinct()
    over = L.scored(spark, sf).withColumn("anomaly_score", F.col("anomaly_score") - F.col("threshold"))
    dets = stored(DE.detect(over, T.SCALED, N, anomaly_threshold=0.0))
    systems = {"rule_alerts": SC.rule_alerts(dets), "anomaly_advisories": SC.advisories(dets), "naive_speed_threshold": T.naive(spark, sf)}
    events = ON.latency_events(T.own(spark, sf), T.incident_messages(spark, sf), inc, T.onsets(spark, sf), SC.rule_alerts(dets), N, 5.0, 2.0)
    seen = ON.pick_onset(ON.candidates(inc, T.onsets(spark, sf), N, 5.0, 2.0)).select("race", "incident")
    unseen = ON.no_onset_reason(T.own(spark, sf), inc, N).join(seen, ["race", "incident"], "left_anti")
    pred = L.predicted(spark, sf)
    others = pred.filter("y30 = 0").withColumn("fold", F.explode(other_races(races_of(pred))))
    lines = list(exact_quantile_per(others, "fold", "p30", 1 - RI.ALERT_NEG_RATES[0]).items())
    pred = pred.join(spark.createDataFrame(lines, "race string, threshold double"), "race")
    scores = {h: {"model": F.col(f"p{h}"), "anomaly_score": F.coalesce("anomaly_score", F.lit(0.0)), "speed_threshold": -F.col("speed")} for h in (10, 30)}
    ours = ES.our_side(f, T.incident_messages(spark, sf), inc, T.official(spark, sf), T.escalations(spark, sf), N)
    return RP.race_report({
        "detection": RP.detection(f, inc, systems, N, max_hold=3.0),
        "latency": RP.latency(events, unseen, races),
        "risk": RP.risk(pred, scores, races),
        "escalation": RP.escalation(official_rows(spark, sf), ours, ES.clears_under_neutral(f, T.recs(spark, sf)), SC.race_hours(f), races)})


@query("h51_check_races", sql(["grid", "official"], """
    SELECT race, count(*) AS score FROM official WHERE race <> 'R1' GROUP BY race ORDER BY score DESC, race LIMIT 2"""))
def _(spark, sf):
    off = T.official(spark, sf)
    rank = off.groupBy("race").agg(F.count(F.lit(1)).alias("score")).withColumn("error", F.lit(""))
    return check_races(rank, rank.filter("race = 'R1'"), 2).select("race", "score")
