"""Flag engine (G) and live views (V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackguard.operators import exposure as EX, flags as FL, live as LI
from trackguard.plans import tables as T
from trackguard.plans.q_eval import calls
from trackguard.plans.registry import query, with_tables
from trackguard.plans.sqlparts import PARTS, TICKS
from trackguard.sources import adapter as AD, contracts as CO

N = AD.SECTORS


def sql(names: list[str], body: str) -> str:
    return with_tables(PARTS, names, body)


# ---- flags

_ANCHORS = """live AS (SELECT race, drv, tick, t, x, y, in_pit, row_number() OVER (PARTITION BY race, drv ORDER BY tick) AS n FROM gridxy WHERE speed IS NOT NULL),
anchor AS (
    SELECT race, drv, tick, t, in_pit, n, x AS ax, y AS ay, t AS moved FROM live WHERE n = 1
    UNION ALL
    SELECT l.race, l.drv, l.tick, l.t, l.in_pit, l.n, CASE WHEN sqrt(pow(l.x - a.ax, 2) + pow(l.y - a.ay, 2)) > 3 THEN l.x ELSE a.ax END,
           CASE WHEN sqrt(pow(l.x - a.ax, 2) + pow(l.y - a.ay, 2)) > 3 THEN l.y ELSE a.ay END,
           CASE WHEN sqrt(pow(l.x - a.ax, 2) + pow(l.y - a.ay, 2)) > 3 THEN l.t ELSE a.moved END
    FROM anchor a JOIN live l ON l.race = a.race AND l.drv = a.drv AND l.n = a.n + 1)"""


@query("g1_car_anchors", with_tables(PARTS, ["grid", "gridxy"], "", recursive=True) + f""", {_ANCHORS}
    SELECT race, drv, tick, round(ax, 3) AS ax, round(ay, 3) AS ay, moved FROM anchor""")
def _(spark, sf):
    a = anchors(spark, sf)
    return a.select("race", "drv", "tick", F.round("ax", 3).alias("ax"), F.round("ay", 3).alias("ay"), "moved")


@T.kept("anchors")
def anchors(spark, sf):
    live = T.features(spark, sf).filter("speed is not null")
    return FL.car_anchors(live.select("race", "drv", "tick", "t", "x", "y", "in_pit", "msector", "speed"))


@query("g1_g17_recommendations")
def _(spark, sf):
    r = FL.recommend(T.features(spark, sf), T.detections(spark, sf), T.FLAG_SET)
    return r.withColumn("source_detections", F.array_join("source_detections", ",")).drop("epoch", "tick")


def envelopes(spark, sf):
    f = T.features(spark, sf)
    ticks = f.groupBy("race", "tick").agg(F.first("t").alias("t"), F.max("lap").alias("lap"), F.min("track_status").alias("track_status"))
    risk = f.filter("tick % 4 = 0 and speed is not null").select("race", "tick", "t", "drv", F.least(F.lit(1.0), F.col("speed") / 1000).alias("risk_10s"),
                                                                 F.least(F.lit(1.0), F.col("speed") / 500).alias("risk_30s"))
    return FL.envelopes(ticks, T.detections(spark, sf), risk, T.recs(spark, sf))


@query("g18_g19_envelopes")
def _(spark, sf):
    return envelopes(spark, sf)


@query("g20_state_at", sql(["grid"], """
    SELECT race, drv AS seq, max(tick) AS tick FROM grid WHERE t < 6 AND tick % 4 = 0 AND speed IS NOT NULL GROUP BY race, drv"""))
def _(spark, sf):
    return FL.history_at(envelopes(spark, sf), 6.0).filter("kind = 'risk'").select("race", "seq", "tick")


@query("s15_cross_references")
def _(spark, sf):
    """Rows checked and rows at fault of each message table."""
    dets, recs = T.detections(spark, sf), T.recs(spark, sf)
    faults = {"detection": [CO.violations(dets, "detection"), CO.unknown_drivers(dets, T.features(spark, sf)), CO.out_of_order(dets, "detection")],
              "rec": [CO.violations(recs, "rec"), CO.dangling_sources(recs, dets), CO.out_of_order(recs, "rec")]}
    out = None
    for kind, table in (("detection", dets), ("rec", recs)):
        found = faults[kind][0].unionByName(faults[kind][1]).unionByName(faults[kind][2])
        rows = table.select(F.lit(kind).alias("kind"), F.lit(1).alias("checked"), F.lit(0).alias("at_fault")).unionByName(
            found.select("kind", F.lit(0).alias("checked"), F.lit(1).alias("at_fault")))
        rows = rows.groupBy("kind").agg(F.sum("checked").alias("checked"), F.sum("at_fault").alias("at_fault"))
        out = rows if out is None else out.unionByName(rows)
    return out


# ---- live views

@query("v1_cars_out", sql(TICKS, """
    , asked AS (SELECT DISTINCT race, t AS t_at FROM grid WHERE tick % 8 = 7),
    live AS (SELECT *, CASE WHEN speed < 20 THEN 1 ELSE 0 END AS still FROM fieldrows WHERE speed IS NOT NULL),
    runs AS (SELECT *, CASE WHEN still = 1 THEN min(CASE WHEN still = 1 THEN t END) OVER (PARTITION BY race, drv, b ORDER BY tick) END AS still_since
             FROM (SELECT *, sum(1 - still) OVER (PARTITION BY race, drv ORDER BY tick) AS b FROM live) q),
    known AS (SELECT c.race, c.drv, a.t_at FROM (SELECT DISTINCT race, drv FROM grid) c JOIN asked a USING (race)),
    seen AS (SELECT k.*, r.t AS seen, r.still_since, r.in_pit, r.msector FROM known k ASOF LEFT JOIN runs r ON r.race = k.race AND r.drv = k.drv AND r.t <= k.t_at),
    stops AS (SELECT race, t, field_slow >= 0.5 AND field_in_pit < 0.5 AND NOT suspended AS on_track FROM ticks WHERE suspended OR field_slow >= 0.5),
    cuts AS (SELECT s.race, s.drv, s.t_at, p.t FROM seen s JOIN stops p ON p.race = s.race AND p.t >= s.still_since AND p.t < s.t_at AND (s.in_pit OR p.on_track)
             UNION ALL SELECT race, drv, t_at, still_since FROM seen WHERE still_since IS NOT NULL
             UNION ALL SELECT race, drv, t_at, t_at FROM seen WHERE still_since IS NOT NULL),
    moving AS (SELECT race, drv, t_at, max(d) AS longest FROM (SELECT race, drv, t_at, t - lag(t) OVER (PARTITION BY race, drv, t_at ORDER BY t) AS d FROM cuts) q GROUP BY ALL),
    nowt AS (SELECT a.race, a.t_at, max(l.t) AS now FROM asked a JOIN live l ON l.race = a.race AND l.t <= a.t_at GROUP BY ALL),
    why AS (SELECT s.*, CASE WHEN s.seen IS NULL AND n.now - (SELECT min(t) FROM grid g WHERE g.race = s.race) >= 1 THEN 'no data'
                WHEN n.now - s.seen >= 1 THEN 'no data' WHEN m.longest >= 1 THEN CASE WHEN s.in_pit THEN 'in the pit lane' ELSE 'stopped' END END AS why
            FROM seen s LEFT JOIN moving m USING (race, drv, t_at) LEFT JOIN nowt n USING (race, t_at))
    SELECT race, t_at, drv, why, CASE WHEN why = 'no data' THEN seen ELSE still_since END AS since, msector FROM why WHERE why IS NOT NULL""").replace("\n\n    , asked", ", asked"))
def _(spark, sf):
    f = T.features(spark, sf)
    at = f.filter("tick % 8 = 7").select("race", F.col("t").alias("t_at"))
    return LI.cars_out(f, at, out_after=1.0)


@query("v2_stoppages", sql(TICKS, "") + """,
    s AS (SELECT race, t, sum(brk) OVER (PARTITION BY race ORDER BY t) AS isl FROM (SELECT race, t, CASE WHEN t - lag(t) OVER (PARTITION BY race ORDER BY t) <= 1 THEN 0 ELSE 1 END AS brk
          FROM ticks WHERE suspended OR field_slow >= 0.5) q)
    SELECT race, min(t) AS t0, max(t) AS t1 FROM s GROUP BY race, isl HAVING max(t) - min(t) >= 0.5""")
def _(spark, sf):
    return LI.stoppages(T.features(spark, sf), min_s=0.5)


@query("v3_car_states", with_tables(PARTS, ["grid", "gridxy"], "", recursive=True) + f""", {_ANCHORS},
    st AS (SELECT *, t - moved AS still_for, count(*) FILTER (NOT in_pit AND t - moved >= 0.5) OVER p AS still, count(*) FILTER (NOT in_pit) OVER p AS on_track
           FROM anchor WINDOW p AS (PARTITION BY race, tick))
    SELECT race, drv, tick, still_for, CASE WHEN in_pit THEN 'PIT' WHEN still >= 5 AND still >= on_track / 2 THEN NULL WHEN still_for >= 2 THEN 'OUT'
           WHEN still_for >= 0.5 THEN 'STOPPED' END AS status FROM st""")
def _(spark, sf):
    return LI.car_states(T.features(spark, sf), anchors(spark, sf), stopped_after=0.5, out_after=2.0)


@query("v4_official_state", sql(["grid", "official"], """
    SELECT g.event_id, coalesce(o.flag, 'CLEAR') AS official_state FROM grid g
    ASOF LEFT JOIN (SELECT race, t, arg_max(flag, event_id) AS flag FROM official WHERE msector IS NULL GROUP BY race, t) o ON o.race = g.race AND o.t <= g.t"""))
def _(spark, sf):
    return LI.official_state_at(T.grid(spark, sf), "t", T.official(spark, sf)).select("event_id", "official_state")


_MATCH = """starts AS (SELECT o.*, coalesce((SELECT min(s.t) FROM official s WHERE s.race = o.race AND s.msector IS NOT NULL AND s.t >= o.t - 120 AND s.t < o.t), o.t) AS first
    FROM official o WHERE msector IS NULL AND flag <> 'CLEAR' UNION ALL SELECT *, t FROM official WHERE msector IS NOT NULL AND flag <> 'CLEAR'),
matched AS (SELECT s.race, s.event_id, s.t, s.first, min(c.t) AS t_ours FROM starts s LEFT JOIN calls c ON c.race = s.race AND c.flag <> 'CLEAR' AND c.t BETWEEN s.first - 1 AND s.t + 0.5
    AND CASE WHEN s.msector IS NULL THEN c.flag IN ('VSC', 'SC', 'RED') ELSE c.flag IN ('YELLOW', 'DOUBLE_YELLOW')
         AND abs((((c.msector - s.msector + 5) % 10) + 10) % 10 - 5) <= 1 END GROUP BY ALL)"""


def matched(spark, sf):
    return LI.our_match(T.official(spark, sf), calls(spark, sf), N, before=1.0, after=0.5)


@query("v5_our_first_call", sql(["grid", "official", "calls"], "") + f", {_MATCH} SELECT race, event_id, first AS start, t_ours FROM matched")
def _(spark, sf):
    return matched(spark, sf).select("race", "event_id", "start", "t_ours")


@query("v6_lead_summary", sql(TICKS + ["official", "calls"], "") + f""", {_MATCH},
    s AS (SELECT race, t, sum(brk) OVER (PARTITION BY race ORDER BY t) AS isl FROM (SELECT race, t, CASE WHEN t - lag(t) OVER (PARTITION BY race ORDER BY t) <= 1 THEN 0 ELSE 1 END AS brk
          FROM ticks WHERE suspended OR field_slow >= 0.5) q),
    st AS (SELECT race, min(t) AS t0, max(t) AS t1 FROM s GROUP BY race, isl HAVING max(t) - min(t) >= 6)
    SELECT race, count(*) AS official_flags, count(*) FILTER (t - t_ours > 0) AS earlier, median(CASE WHEN t - t_ours > 0 THEN t - t_ours END) AS median_lead_s
    FROM matched m WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.race = m.race AND m.t BETWEEN st.t0 AND st.t1 + 1) GROUP BY race""")
def _(spark, sf):
    return LI.lead_summary(matched(spark, sf), LI.stoppages(T.paces(spark, sf), min_s=6.0))


@query("v7_flag_incidents", sql(["grid", "official", "gapmsgs"], """
    SELECT race, min(t) AS t, max(t) AS t_last, count(*) AS events, string_agg(DISTINCT flag, ' ' ORDER BY flag) AS flags,
           coalesce(string_agg(DISTINCT msector, ' ' ORDER BY msector), '') AS sectors FROM gapmsgs GROUP BY race, incident"""))
def _(spark, sf):
    return LI.flag_incidents(T.official(spark, sf), 0.5).drop("incident")


@query("v8_exposure_clock")
def _(spark, sf):
    own = T.own(spark, sf)
    recs = T.recs(spark, sf)
    places = LI.clock_places(recs, EX.rec_cars(recs, T.detections(spark, sf)), T.official(spark, sf), own)
    passes = EX.crossings(own, places, AD.LENGTH).join(places.select("race", "place", "crash_dist"), ["race", "place"])
    return LI.exposure_clock(passes, own, AD.LENGTH, fallback=40.0)        # the test data's cars are slow


@query("v8_last_green_lap", sql(["grid"], """
    , ok AS (SELECT * FROM grid WHERE speed IS NOT NULL),
    laps AS (SELECT race, drv, drv_lap, bool_and(track_status = '1') AS green FROM ok GROUP BY ALL),
    refs AS (SELECT l.race, l.drv, l.drv_lap, max(g.drv_lap) AS ref_lap FROM laps l JOIN laps g ON g.race = l.race AND g.drv = l.drv AND g.green AND g.drv_lap < l.drv_lap GROUP BY ALL)
    SELECT r.race, r.drv, r.drv_lap, CAST(floor(o.dist / 50) AS BIGINT) AS bin, arg_max(o.speed, o.tick) AS v FROM refs r
    JOIN ok o ON o.race = r.race AND o.drv = r.drv AND o.drv_lap = r.ref_lap AND o.track_status = '1' GROUP BY ALL""").replace("\n\n    , ok", ", ok"))
def _(spark, sf):
    return LI.last_green_lap(T.grid(spark, sf), AD.LENGTH)


@query("v9_lead_labels", sql(["grid", "official", "calls"], """
    , ranked AS (SELECT *, CASE WHEN flag IN ('YELLOW', 'VSC') THEN 1 WHEN flag IN ('DOUBLE_YELLOW', 'SC') THEN 2 WHEN flag = 'RED' THEN 3 END AS rank FROM official WHERE flag <> 'CLEAR'),
    mine AS (SELECT *, CASE WHEN flag IN ('YELLOW', 'VSC') THEN 1 WHEN flag IN ('DOUBLE_YELLOW', 'SC') THEN 2 ELSE 3 END AS rank, flag IN ('VSC', 'SC', 'RED') AS wide FROM calls WHERE flag <> 'CLEAR'),
    firsts AS (SELECT m.race, m.id, m.t, round(min(o.t) - m.t, 2) AS d FROM mine m LEFT JOIN ranked o ON o.race = m.race AND o.rank >= m.rank AND o.t BETWEEN m.t - 120 AND m.t + 120
        AND CASE WHEN m.wide THEN o.msector IS NULL ELSE o.msector IS NOT NULL AND (((m.msector - o.msector + 5) % 10) + 10) % 10 - 5 BETWEEN -1 AND 2 END GROUP BY m.race, m.id, m.t)
    SELECT race, id, t, d AS lead_s, CASE WHEN d IS NULL THEN 'WAITING' WHEN d <= -0.05 THEN 'FIRST' WHEN d < 0.05 THEN 'LEVEL' ELSE 'AHEAD' END AS label FROM firsts""").replace("\n\n    , ranked", ", ranked"))
def _(spark, sf):
    rank = F.when(F.col("flag").isin("YELLOW", "VSC"), 1).when(F.col("flag").isin("DOUBLE_YELLOW", "SC"), 2).otherwise(3)
    mine = calls(spark, sf).filter("flag <> 'CLEAR'").withColumns({"rank": rank, "track_wide": F.col("flag").isin("VSC", "SC", "RED")})
    return LI.lead_labels(mine.select("race", "id", "t", "msector", "rank", "track_wide"), T.official(spark, sf), N)


@query("v10_call_log")
def _(spark, sf):
    return LI.call_log(T.recs(spark, sf), T.official(spark, sf), T.detections(spark, sf), N)


def card_marks(spark, sf):
    """Every official message as a crash with made-up markers, some of them missing."""
    e, t = F.col("event_id"), F.col("t")
    return T.official(spark, sf).select(
        "race", e.alias("crash"), t.alias("onset"), F.when(e % 3 > 0, t + 1.5).alias("alert"), F.lit("SPIN").alias("alert_type"),
        F.when(e % 4 > 0, t + 2.5).alias("our_esc"), F.lit("SC").alias("our_flag"), F.when(e % 5 > 0, t - 0.5).alias("yellow"),
        F.when(e % 2 > 0, t + 4.0).alias("off_esc"), F.col("flag").alias("off_flag"))


@query("v12_crash_card_events", with_tables(PARTS, ["grid", "official"], """
    SELECT race, event_id AS crash, d AS t_after, event, what, CAST(row_number() OVER (PARTITION BY race, event_id ORDER BY d, event) AS INT) AS place_in_list FROM (
        SELECT race, event_id, 0.0::DOUBLE AS d, 'onset' AS event, '' AS what FROM official
        UNION ALL SELECT race, event_id, 1.5, 'our first alert', 'SPIN' FROM official WHERE event_id % 3 > 0
        UNION ALL SELECT race, event_id, 2.5, 'our recommendation', 'SC' FROM official WHERE event_id % 4 > 0
        UNION ALL SELECT race, event_id, -0.5, 'official yellow', '' FROM official WHERE event_id % 5 > 0
        UNION ALL SELECT race, event_id, 4.0, 'official escalation', flag FROM official WHERE event_id % 2 > 0) q"""))
def _(spark, sf):
    return EX.crash_events(card_marks(spark, sf))


@query("v12_exposure_lines")
def _(spark, sf):
    return EX.exposure_lines(T.marks(spark, sf), EX.first_racing_passes(T.passes(spark, sf)))
