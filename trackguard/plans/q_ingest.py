"""Sources, alignment and reference geometry (S, A and R operators)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trackguard.functions import ring
from trackguard.operators import alignment as AL, geometry as GE
from trackguard.plans.q_features import KEY
from trackguard.plans.pipeline import align_race, field_rows
from trackguard.plans.registry import query, with_tables
from trackguard.plans.sqlparts import PARTS, TICKS
from trackguard.session import shared_dir
from trackguard.sources import adapter as AD, contracts as CO, readers as RE, sinks as SI


def scratch(spark) -> str:
    return f"{shared_dir(spark)}/trackguard/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def sql(names: list[str], body: str) -> str:
    return with_tables(PARTS, names, body)


# ---- scans, sources, sinks

_COUNTS = """counts AS (SELECT race, count(*) FILTER (flag = 'YELLOW') AS yellow, count(*) FILTER (flag = 'DOUBLE_YELLOW') AS double_yellow,
    count(*) FILTER (flag = 'SC') AS sc, count(*) FILTER (flag = 'VSC') AS vsc, count(*) FILTER (flag = 'RED') AS red FROM official GROUP BY race)"""


def ranking(spark, sf):
    return RE.count_events(AD.official(AD.grid(spark, sf)), F.col("flag")).withColumn("score", RE.score())


@query("s2_s3_event_counts_and_score", sql(["grid", "official"], "") + ", " + _COUNTS +
       " SELECT *, yellow + 2 * double_yellow + 5 * vsc + 8 * sc + 10 * red AS score FROM counts")
def _(spark, sf):
    return ranking(spark, sf)


@query("s4_top_races", sql(["grid", "official"], "") + ", " + _COUNTS +
       " SELECT race, yellow + 2 * double_yellow + 5 * vsc + 8 * sc + 10 * red AS score FROM counts ORDER BY score DESC, race LIMIT 3")
def _(spark, sf):
    return RE.top_races(ranking(spark, sf).withColumn("error", F.lit("")), 3).select("race", "score")


@query("s5_not_yet_scanned", """
    SELECT CAST(user_id AS VARCHAR) AS race FROM events GROUP BY user_id HAVING count(*) % 2 = 1""")
def _(spark, sf):
    users = AD.table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("race")).agg(F.count(F.lit(1)).alias("n"))
    known = users.withColumn("error", F.when(F.col("n") % 2 == 1, "no data").otherwise(""))
    return RE.not_yet_scanned(users.select("race"), known)


@query("s6_race_id", "SELECT p_partkey, concat(CAST(2000 + p_size AS VARCHAR), '_', replace(p_type, ' ', '_')) AS race FROM part")
def _(spark, sf):
    return AD.table(spark, sf, "part").select("p_partkey", RE.race_id(2000 + F.col("p_size"), F.concat("p_type", F.lit(" Grand Prix"))).alias("race"))


@query("s7_holdout_guard", """
    SELECT p_partkey, p_type AS race FROM part
    WHERE NOT (2020 + p_size % 10 = 2026 AND p_partkey % 7 = 0)""")
def _(spark, sf):
    races = AD.table(spark, sf, "part").select(
        "p_partkey", F.col("p_type").alias("race"), (2020 + F.col("p_size") % 10).alias("year"),
        F.when(F.col("p_partkey") % 7 == 0, " Baku").otherwise(F.col("p_brand")).alias("location"))
    return RE.without_holdout(races).select("p_partkey", "race")


@query("s8_feature_sink", sql(["grid"], "SELECT race, drv, tick, speed FROM grid"))
def _(spark, sf):
    path = scratch(spark)
    SI.write_features(AD.grid(spark, sf), path)
    return spark.read.parquet(path).select(*KEY, "speed")


@query("s9_race_meta", sql(["grid"], 'SELECT race, count(*) AS "rows", count(DISTINCT drv) AS cars, min(t) AS t_first, max(t) AS t_last FROM grid GROUP BY race'))
def _(spark, sf):
    return SI.race_meta(AD.grid(spark, sf))


@query("s10_rebuild_official", sql(["grid", "official"], "SELECT race, event_id, CASE WHEN race = 'R1' THEN 'CLEAR' ELSE flag END AS flag FROM official"))
def _(spark, sf):
    path, events = scratch(spark), AD.official(AD.grid(spark, sf))
    SI.rewrite_races(events, path)
    fixed = events.withColumn("flag", F.lit("CLEAR"))
    SI.rebuild_official(fixed, events.filter("race = 'R1'"), path)
    return spark.read.parquet(path).select("race", "event_id", "flag")


def raw_tables(spark, sf):
    """The adapter's rows as raw car and position samples: positions in 1/10 m, a few of them lost."""
    g = AD.with_xy(AD.grid(spark, sf))
    car = g.filter("speed is not null").select("race", "drv", "t", "speed", "throttle", F.col("brake").cast("double").alias("brake"), F.lit(5).alias("gear"),
                                               (F.col("speed") * 40).alias("rpm"))
    lost = F.col("event_id") % 71 == 0
    pos = g.select("race", "drv", "t", *[F.when(lost, 0.0).otherwise(F.col(c) * 10).alias(c) for c in ("x", "y")], F.when(lost, 0.0).otherwise(5.0).alias("z"))
    return g, car, pos


@query("s1_raw_scan", sql(["grid"], """SELECT race, drv, t, speed, throttle, brake::INT::DOUBLE AS brake, 5 AS gear, speed * 40 AS rpm FROM grid WHERE speed IS NOT NULL"""))
def _(spark, sf):
    path = scratch(spark)
    raw_tables(spark, sf)[1].write.option("header", True).csv(path)
    return RE.without_nan(RE.read_raw(spark, path, "raw_car", "csv"))


@query("a20_align_race")
def _(spark, sf):
    """Raw samples of all races on the grid with everything known at each tick."""
    g, car, pos = raw_tables(spark, sf)
    ref = AD.ring_reference(g)
    status = AD.official(g).groupBy("race", "t").agg((F.max("event_id") % 7).cast("string").alias("track_status"))
    pit = g.filter("event_id % 50 = 0").select("race", "x", "y")
    out = align_race(car, pos, AD.laps(g), AD.messages(g), status, ref, AD.sector_table(g), GE.speed_profile(g, ["race"], AD.LENGTH), pit, AD.LENGTH)
    return out.select("race", "drv", "tick", "lap", "track_status", "speed", "in_pit", "msector", "after_chequered", F.round("dist", 3).alias("dist"),
                      F.round("ref_speed", 3).alias("ref_speed"))


@query("s11_track_json")
def _(spark, sf):
    g = AD.grid(spark, sf)
    return SI.track_json(AD.ring_reference(g), AD.sector_table(g))


@query("s12_jsonl_envelopes", sql(["grid", "official"], "SELECT race, tick, 'official' AS kind, t, flag FROM official"))
def _(spark, sf):
    path, off = scratch(spark), AD.official(AD.grid(spark, sf))
    envs = off.select("race", "tick", F.lit(0).alias("rank"), F.col("event_id").cast("string").alias("seq"), F.lit("official").alias("kind"), "t",
                      F.to_json(F.struct("t", "flag", "msector")).alias("payload"))
    SI.write_jsonl(envs, path)
    return SI.read_jsonl(spark, path).select("race", "tick", "kind", "t", F.get_json_object("payload", "$.flag").alias("flag"))


@query("s14_result_sinks", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def _(spark, sf):
    path = scratch(spark)
    SI.write_results(AD.table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("user_id bigint, n bigint").option("header", True).csv(path)


@query("s15_contract_violations", sql(["grid"], """
    SELECT 'tick' AS kind, race, CAST(event_id AS VARCHAR) AS key, 'negative speed' AS rule FROM grid WHERE speed - 5 < 0
    UNION ALL SELECT 'risk', race, CAST(event_id AS VARCHAR), 'risk_10s outside 0..1' FROM grid WHERE speed IS NULL OR speed / 100 > 1
    UNION ALL SELECT 'risk', race, CAST(event_id AS VARCHAR), 'risk_30s outside 0..1' FROM grid WHERE speed IS NULL OR speed / 50 > 1"""))
def _(spark, sf):
    g = AD.grid(spark, sf).withColumns({"risk_10s": F.col("speed") / 100, "risk_30s": F.col("speed") / 50})
    return CO.violations(g.withColumn("speed", F.col("speed") - 5), "tick", "event_id").unionByName(CO.violations(g, "risk", "event_id"))


@query("s16_metrics_report", sql(TICKS, """
    SELECT 'grid' AS section, 'rows' AS metric, count(*)::DOUBLE AS value FROM fieldrows
    UNION ALL SELECT 'grid', 'cars', count(DISTINCT drv)::DOUBLE FROM fieldrows
    UNION ALL SELECT 'field', 'mean_slow', round(avg(field_slow) + 1e-9, 6) FROM ticks
    UNION ALL SELECT 'field', 'ticks', count(*)::DOUBLE FROM ticks"""))
def _(spark, sf):
    f = field_rows(AD.grid(spark, sf), AD.LENGTH)
    ticks = f.groupBy("race", "tick").agg(F.first("field_slow").alias("s"))
    return SI.metrics({"grid": f.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("drv").alias("cars")),
                       "field": ticks.agg(F.round(F.avg("s") + 1e-9, 6).alias("mean_slow"), F.count(F.lit(1)).alias("ticks"))})


# ---- cleaning and alignment

@query("a1_a2_valid_positions", """
    SELECT event_id, round(x * 0.1, 6) AS x, round(y * 0.1, 6) AS y
    FROM (SELECT event_id, (event_id % 10) * 10.0 AS x, (event_id % 4) * 5.0 AS y, (event_id % 3) * 1.0 AS z FROM events) e
    WHERE NOT (x = 0 AND y = 0 AND z = 0)""")
def _(spark, sf):
    e = F.col("event_id")
    pos = AD.table(spark, sf, "events").select("event_id", ((e % 10) * 10.0).cast("double").alias("x"), ((e % 4) * 5.0).cast("double").alias("y"),
                                               ((e % 3) * 1.0).cast("double").alias("z"))
    return AL.valid_positions(pos).select("event_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_SAMPLES = """samples AS (SELECT concat('R', CAST(user_id % 4 AS VARCHAR)) AS race, CAST(user_id AS VARCHAR) AS drv, event_id, value,
    (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 / 86400 AS t FROM events)"""


def samples(spark, sf):
    """Events as raw samples; a day plays the second, so the grid has a step of 6 hours."""
    t0 = F.lit("2024-01-01 00:00:00").cast("timestamp")
    ev = AD.table(spark, sf, "events")
    return ev.select(F.concat(F.lit("R"), (F.col("user_id") % 4).cast("string")).alias("race"), F.col("user_id").cast("string").alias("drv"),
                     "event_id", "value", (AL.session_seconds(F.col("ts").cast("timestamp"), t0) / 86400).alias("t"))


@query("a3_session_time", f"WITH {_SAMPLES} SELECT event_id, round(t * 86400, 3) AS t FROM samples")
def _(spark, sf):
    return samples(spark, sf).select("event_id", F.round(F.col("t") * 86400, 3).alias("t"))


_GRID6 = _SAMPLES + """, span AS (SELECT race, ceil(min(t) * 4)::INT AS a, ceil(max(t) * 4)::INT - 1 AS b FROM samples GROUP BY race),
g6 AS (SELECT s.race, c.drv, k.tick::INT AS tick, k.tick / 4.0::DOUBLE AS t FROM span s JOIN (SELECT DISTINCT race, drv FROM samples) c USING (race),
       LATERAL (SELECT unnest(range(s.a, s.b + 1)) AS tick) k)"""


@query("a4_time_grid", f"WITH {_GRID6} SELECT race, drv, tick, t FROM g6")
def _(spark, sf):
    return AL.time_grid(samples(spark, sf))


@query("a5_asof_with_staleness", f"""WITH {_GRID6} SELECT g.race, g.drv, g.tick, CASE WHEN g.t - s.t <= 1 THEN s.value END AS value
    FROM g6 g ASOF LEFT JOIN samples s ON g.race = s.race AND g.drv = s.drv AND s.t <= g.t""")
def _(spark, sf):
    s = samples(spark, sf)
    return AL.align(AL.time_grid(s), s, ["value"], max_stale=1.0, bucket=8.0).select(*KEY, "value")


@query("a6_race_window", sql(["grid", "laps", "messages"], """
    SELECT l.race, l.t_start, coalesce(m.t, l.t_end) AS t_end
    FROM (SELECT race, min(CASE WHEN lap = 1 THEN t_start END) AS t_start, max(t_end) AS t_end FROM laps GROUP BY race) l
    LEFT JOIN (SELECT race, min(t) AS t FROM messages WHERE message LIKE '%CHEQUERED FLAG%' GROUP BY race) m USING (race)"""))
def _(spark, sf):
    g = AD.grid(spark, sf)
    return AL.race_window(AD.laps(g), AD.messages(g))


_PITS = """pits AS (SELECT a.race, a.drv, a.pit_in, min(b.pit_out) AS pit_out FROM laps a
    LEFT JOIN laps b ON a.race = b.race AND a.drv = b.drv AND b.pit_out > a.pit_in WHERE a.pit_in IS NOT NULL GROUP BY ALL)"""


@query("a7_pit_intervals", sql(["grid", "laps"], "") + f", {_PITS} SELECT race, drv, pit_in, pit_out FROM pits")
def _(spark, sf):
    return AL.pit_intervals(AD.laps(AD.grid(spark, sf)))


@query("a8_in_pit", sql(["grid", "laps"], "") + f""", {_PITS}
    SELECT g.race, g.drv, g.tick, bool_or(coalesce(g.t >= p.pit_in AND (p.pit_out IS NULL OR g.t < p.pit_out), false)) AS in_pit
    FROM grid g LEFT JOIN pits p USING (race, drv) GROUP BY g.race, g.drv, g.tick""")
def _(spark, sf):
    g = AD.grid(spark, sf)
    return AL.in_pit(g.drop("in_pit"), AL.pit_intervals(AD.laps(g))).select(*KEY, "in_pit")


@query("a9_leader_lap", sql(["grid", "laps"], """
    SELECT g.race, g.tick, coalesce(max(l.lap), 1) AS lap FROM (SELECT race, tick, min(t) - 0.6 AS t FROM grid GROUP BY race, tick) g
    LEFT JOIN laps l ON l.race = g.race AND l.t_start <= g.t GROUP BY g.race, g.tick"""))
def _(spark, sf):
    g = AD.grid(spark, sf)
    ticks = g.groupBy("race", "tick").agg((F.min("t") - 0.6).alias("t"))
    return AL.leader_lap(ticks, AD.laps(g)).select("race", "tick", "lap")


@query("a10_track_status_asof", sql(["grid", "official"], """
    SELECT g.race, g.drv, g.tick, coalesce(o.code, '1') AS track_status FROM grid g
    ASOF LEFT JOIN (SELECT race, t, CAST(max(event_id) % 7 AS VARCHAR) AS code FROM official GROUP BY race, t) o ON g.race = o.race AND o.t <= g.t"""))
def _(spark, sf):
    g = AD.grid(spark, sf)
    changes = AD.official(g).groupBy("race", "t").agg((F.max("event_id") % 7).cast("string").alias("track_status"))
    return AL.status_at(g.drop("track_status"), changes).select(*KEY, "track_status")


def _pass(n: int) -> str:
    return f"""h{n} AS (SELECT race, drv, tick, speed, CASE WHEN coalesce(speed > 30 AND (((dist - p + 500) % 1000) + 1000) % 1000 - 500 < -2, false)
        THEN p ELSE dist END AS dist FROM (SELECT *, lag(dist) OVER (PARTITION BY race, drv ORDER BY tick) AS p FROM h{n - 1}) q)"""


_GLITCH = """h0 AS (SELECT race, drv, tick, speed, (((dist - CASE WHEN event_id % 5 < 2 THEN 150 ELSE 0 END) % 1000) + 1000) % 1000 AS dist FROM grid)"""


@query("a11_hold_glitches", sql(["grid"], "") + f", {_GLITCH}, {_pass(1)}, {_pass(2)}, {_pass(3)} SELECT race, drv, tick, dist FROM h3")
def _(spark, sf):
    g = AD.grid(spark, sf)
    g = g.withColumn("dist", F.pmod(F.col("dist") - F.when(F.col("event_id") % 5 < 2, 150.0).otherwise(0.0), F.lit(1000.0)))
    return AL.hold_glitches(g, F.lit(AD.LENGTH)).select(*KEY, "dist")


@query("a13_classify_messages", sql(["grid", "messages"], r"""
    SELECT event_id, CASE WHEN category = 'SafetyCar' THEN CASE WHEN message LIKE '%DEPLOYED%' AND message NOT LIKE '%ENDING%'
           THEN CASE WHEN message LIKE '%VIRTUAL%' OR regexp_matches(message, '\bVSC\b') THEN 'VSC' ELSE 'SC' END END
         WHEN flag IN ('YELLOW', 'RED', 'CLEAR') THEN flag WHEN flag = 'DOUBLE YELLOW' THEN 'DOUBLE_YELLOW' END AS kind FROM messages"""))
def _(spark, sf):
    m = AD.messages(AD.grid(spark, sf))
    return m.select("event_id", AL.classify(F.col("category"), F.col("message"), F.col("flag")).alias("kind"))


@query("a14_drivers_in_message", sql(["grid", "messages"], r"""
    SELECT event_id, array_to_string(list_concat(regexp_extract_all(message, 'CARS? (\d+)', 1), regexp_extract_all(message, 'AND (\d+) \(', 1)), ',') AS cars
    FROM messages"""))
def _(spark, sf):
    return AD.messages(AD.grid(spark, sf)).select("event_id", F.array_join(AL.drivers_in(F.col("message")), ",").alias("cars"))


@query("a15_official_events", sql(["grid", "messages"], r"""
    SELECT race, t, kind AS flag, coalesce(scope, 'Track') AS scope, sector AS msector,
           coalesce(car, array_to_string(list_concat(regexp_extract_all(message, 'CARS? (\d+)', 1), regexp_extract_all(message, 'AND (\d+) \(', 1)), ',')) AS drivers
    FROM (SELECT *, CASE WHEN category = 'SafetyCar' THEN CASE WHEN message LIKE '%DEPLOYED%' AND message NOT LIKE '%ENDING%'
           THEN CASE WHEN message LIKE '%VIRTUAL%' OR regexp_matches(message, '\bVSC\b') THEN 'VSC' ELSE 'SC' END END
         WHEN flag IN ('YELLOW', 'RED', 'CLEAR') THEN flag WHEN flag = 'DOUBLE YELLOW' THEN 'DOUBLE_YELLOW' END AS kind FROM messages) q
    WHERE kind IS NOT NULL"""))
def _(spark, sf):
    ev = AL.official_events(AD.messages(AD.grid(spark, sf)))
    return ev.select("race", "t", "flag", "scope", "msector", F.array_join("drivers", ",").alias("drivers"))


@query("a16_a17_nested_ticks", sql(["gridxy"], "").replace("gridxy AS", "grid AS (" + PARTS["grid"] + "), gridxy AS") + """
    SELECT race, tick, min(track_status) AS track_status, count(speed) AS cars, round(sum(round(speed, 1)) + 1e-9, 3) AS speed_sum,
           min(CASE WHEN speed IS NOT NULL THEN drv END) AS first_car FROM gridxy GROUP BY race, tick""")
def _(spark, sf):
    g = AL.add_gaps(AD.with_xy(AD.grid(spark, sf)), AD.LENGTH).withColumns({"gear": F.lit(5), "rpm": F.lit(10000), "lap": F.col("drv_lap")})
    n = AL.ticks_nested(g)
    total = F.aggregate("cars", F.lit(0.0), lambda a, c: a + c["speed"])
    total = F.when(F.size("cars") > 0, F.round(total + 1e-9, 3))
    return n.select("race", "tick", "track_status", F.size("cars").cast("bigint").alias("cars"), total.alias("speed_sum"), F.get("cars", F.lit(0))["drv"].alias("first_car"))


@query("a18_after_chequered", sql(["grid"], "SELECT race, drv, tick, t > CAST(substr(race, 2) AS INT) + 3 AS after_chequered FROM grid"))
def _(spark, sf):
    g = AD.grid(spark, sf)
    ends = g.select("race", (F.substring("race", 2, 5).cast("int") + 3).alias("t_end")).distinct()
    return AL.after_chequered(g, ends).select(*KEY, "after_chequered")


@query("a19_entry_list", sql(["grid"], """
    SELECT race, drv, CAST(row_number() OVER (PARTITION BY race ORDER BY CAST(drv AS INT)) AS INT) AS place FROM (SELECT DISTINCT race, drv FROM grid) q"""))
def _(spark, sf):
    return AL.entry_list(AD.grid(spark, sf))


# ---- geometry

_CLEAN = """ok AS (SELECT * FROM laps WHERE pit_in IS NULL AND pit_out IS NULL AND track_status = '1'),
strict AS (SELECT * FROM (SELECT *, min(lap_s) OVER (PARTITION BY race, drv) AS best FROM ok WHERE accurate) q WHERE lap_s <= best * 1.07),
loose AS (SELECT * FROM (SELECT *, min(lap_s) OVER (PARTITION BY race, drv) AS best FROM ok) q WHERE lap_s <= best * 1.07),
enough AS (SELECT race, drv FROM strict GROUP BY race, drv HAVING count(*) >= 3),
ref AS (SELECT race, drv, lap, lap_s FROM strict SEMI JOIN enough USING (race, drv)
        UNION ALL SELECT race, drv, lap, lap_s FROM loose ANTI JOIN enough USING (race, drv))"""


@query("r1_reference_laps", sql(["grid", "laps"], "") + f", {_CLEAN} SELECT race, drv, lap, lap_s FROM ref")
def _(spark, sf):
    return GE.reference_laps(AD.laps(AD.grid(spark, sf)), ["race", "drv"]).select("race", "drv", "lap", "lap_s")


@query("r2_fastest_lap", sql(["grid", "laps"], "") + f""", {_CLEAN.replace("race, drv)", "race)").replace("race, drv FROM", "race FROM").replace("BY race, drv H", "BY race H").replace("(PARTITION BY race, drv)", "(PARTITION BY race)")}
    SELECT race, drv, lap, lap_s FROM (SELECT *, row_number() OVER (PARTITION BY race ORDER BY lap_s, drv, lap) AS n FROM ref) q WHERE n = 1""")
def _(spark, sf):
    return GE.fastest_lap(AD.laps(AD.grid(spark, sf)), ["race"])


_LINE = """seg0 AS (SELECT race, drv, drv_lap, tick, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM gridxy WINDOW w AS (PARTITION BY race, drv, drv_lap ORDER BY tick)),
seg1 AS (SELECT * FROM seg0 WHERE px IS NULL OR sqrt((x - px) * (x - px) + (y - py) * (y - py)) > 1e-6),
seg2 AS (SELECT *, lag(x) OVER w AS qx, lag(y) OVER w AS qy FROM seg1 WINDOW w AS (PARTITION BY race, drv, drv_lap ORDER BY tick)),
seg3 AS (SELECT *, sum(coalesce(sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy)), 0)) OVER w AS c FROM seg2 WINDOW w AS (PARTITION BY race, drv, drv_lap ORDER BY tick)),
seg4 AS (SELECT *, lead(c) OVER w AS c1, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM seg3 WINDOW w AS (PARTITION BY race, drv, drv_lap ORDER BY tick)),
line AS (SELECT race, drv, drv_lap, i::INT AS i, (i * 50)::DOUBLE AS dist, x + (i * 50 - c) / (c1 - c) * (x1 - x) AS x, y + (i * 50 - c) / (c1 - c) * (y1 - y) AS y
         FROM seg4, LATERAL (SELECT unnest(range(ceil(c / 50)::INT, ceil(c1 / 50)::INT)) AS i) k WHERE c1 IS NOT NULL)"""


def lap_lines(spark, sf):
    return GE.resample_line(AD.with_xy(AD.grid(spark, sf)).select("race", "drv", "drv_lap", "tick", "x", "y"), ["race", "drv", "drv_lap"], "tick", 50.0)


@query("r3_resample_line", sql(["grid", "gridxy"], "") + f", {_LINE} SELECT race, drv, drv_lap, i, dist, round(x + 1e-9, 4) AS x, round(y + 1e-9, 4) AS y FROM line")
def _(spark, sf):
    return lap_lines(spark, sf).select("race", "drv", "drv_lap", "i", "dist", F.round(F.col("x") + 1e-9, 4).alias("x"), F.round(F.col("y") + 1e-9, 4).alias("y"))


@query("r4_closed_length", sql(["grid", "gridxy"], "") + f""", {_LINE} SELECT race, drv, drv_lap,
    round(max(dist) + sqrt(pow(arg_min(x, i) - arg_max(x, i), 2) + pow(arg_min(y, i) - arg_max(y, i), 2)) + 1e-9, 4) AS length FROM line GROUP BY race, drv, drv_lap""")
def _(spark, sf):
    out = GE.closed_length(lap_lines(spark, sf), ["race", "drv", "drv_lap"])
    return out.withColumn("length", F.round(F.col("length") + 1e-9, 4))


# positions drift 20 m around the ring, so the nearest piece of the line is not always the car's own
_REF = """ref AS (SELECT i, i * 5.0::DOUBLE AS dist, CASE WHEN i < 50 THEN i * 5.0 WHEN i < 100 THEN 250 WHEN i < 150 THEN 750 - i * 5.0 ELSE 0 END::DOUBLE AS x,
    CASE WHEN i < 50 THEN 0 WHEN i < 100 THEN i * 5.0 - 250 WHEN i < 150 THEN 250 ELSE 1000 - i * 5.0 END::DOUBLE AS y FROM (SELECT unnest(range(200)) AS i) r),
refn AS (SELECT a.*, b.x AS nx, b.y AS ny FROM ref a JOIN ref b ON b.i = (a.i + 1) % 200),
near AS (SELECT g.race, g.drv, g.tick, g.x, g.y, arg_min(r, {d: sqrt((r.x - g.x) * (r.x - g.x) + (r.y - g.y) * (r.y - g.y)), i: r.i}) AS r
         FROM (SELECT *, x + 0.31 AS x0 FROM gridxy) g, refn r GROUP BY g.race, g.drv, g.tick, g.x, g.y),
proj AS (SELECT *, sqrt((r.nx - r.x) * (r.nx - r.x) + (r.ny - r.y) * (r.ny - r.y)) + 1e-9 AS n FROM near)"""


@query("r5_project", sql(["grid", "gridxy"], "") + f""", {_REF} SELECT race, drv, tick,
    round((((r.dist + ((x - r.x) * (r.nx - r.x) + (y - r.y) * (r.ny - r.y)) / n) % 1000) + 1000) % 1000 + 1e-6, 4) AS dist,
    round(((r.nx - r.x) * (y - r.y) - (r.ny - r.y) * (x - r.x)) / n + 1e-6, 4) AS lat_off FROM proj""")
def _(spark, sf):
    g = AD.grid(spark, sf)
    out = GE.project(AD.with_xy(g).select(*KEY, "x", "y"), AD.ring_reference(g), ["race"], F.lit(AD.LENGTH))
    return out.select(*KEY, F.round(F.col("dist") + 1e-6, 4).alias("dist"), F.round(F.col("lat_off") + 1e-6, 4).alias("lat_off"))


@query("r6_project_path")
def _(spark, sf):
    g = AD.grid(spark, sf)
    out = GE.project_path(AD.with_xy(g).select(*KEY, "x", "y"), AD.ring_reference(g), AD.LENGTH)
    return out.select(*KEY, F.round("dist", 3).alias("dist"), F.round("lat_off", 3).alias("lat_off"))


_MARK = "mark AS (SELECT race, CAST(drv AS INT) AS id, dist FROM grid WHERE tick = 0)"


@query("r7_marshal_sectors", sql(["grid"], "") + f""", {_MARK} SELECT race, id, dist AS start_dist,
    coalesce(lead(dist) OVER w, first_value(dist) OVER w) AS end_dist FROM mark WINDOW w AS (PARTITION BY race ORDER BY dist, id)""")
def _(spark, sf):
    marks = AD.grid(spark, sf).filter("tick = 0").select("race", F.col("drv").cast("int").alias("id"), "dist")
    return GE.marshal_sectors(marks, ["race"])


@query("r8_sectors_in_order", sql(["grid"], "") + f""", {_MARK} SELECT race, sum((nxt <= id)::INT) <= 1 AS in_order
    FROM (SELECT *, coalesce(lead(id) OVER w, first_value(id) OVER w) AS nxt FROM mark WINDOW w AS (PARTITION BY race ORDER BY dist, id)) q GROUP BY race""")
def _(spark, sf):
    marks = AD.grid(spark, sf).filter("tick = 0").select("race", F.col("drv").cast("int").alias("id"), "dist")
    return GE.sectors_in_order(GE.marshal_sectors(marks, ["race"]), ["race"])


@query("r9_sector_lookup", sql(["grid"], "SELECT race, drv, tick, CAST(1 + ((dist - 30 + 1000)::INT % 1000) // 100 AS INT) AS msector FROM grid"))
def _(spark, sf):
    g = AD.grid(spark, sf)
    return GE.sector_at(g.drop("msector"), AD.sector_table(g), ["race"]).select(*KEY, "msector")


_PROFILE = """med AS (SELECT race, least(floor(dist / 10), 99)::INT AS bin, quantile_cont(speed, 0.5) AS v FROM grid
    WHERE speed IS NOT NULL GROUP BY ALL),
full_bins AS (SELECT r.race, b.bin::INT AS bin, m.v FROM (SELECT DISTINCT race FROM med) r CROSS JOIN (SELECT unnest(range(100)) AS bin) b
    LEFT JOIN med m ON m.race = r.race AND m.bin = b.bin),
filled AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN bin END IGNORE NULLS) OVER (PARTITION BY race ORDER BY bin) AS ba,
    last_value(v IGNORE NULLS) OVER (PARTITION BY race ORDER BY bin) AS va,
    last_value(CASE WHEN v IS NOT NULL THEN bin END IGNORE NULLS) OVER (PARTITION BY race ORDER BY bin DESC) AS bz,
    last_value(v IGNORE NULLS) OVER (PARTITION BY race ORDER BY bin DESC) AS vz FROM full_bins),
prof AS (SELECT race, bin, coalesce(v, CASE WHEN bz > ba THEN va + (bin - ba) / (bz - ba) * (vz - va) END, va, vz) AS ref_speed FROM filled)"""


def speed_profile(spark, sf):
    return GE.speed_profile(AD.grid(spark, sf), ["race"], AD.LENGTH)


@query("r10_speed_profile", sql(["grid"], "") + f", {_PROFILE} SELECT race, bin, round(ref_speed + 1e-9, 6) AS ref_speed FROM prof")
def _(spark, sf):
    return speed_profile(spark, sf).withColumn("ref_speed", F.round(F.col("ref_speed") + 1e-9, 6))


@query("r11_reference_speed", sql(["grid"], "") + f""", {_PROFILE} SELECT g.race, g.drv, g.tick, round(p.ref_speed + 1e-9, 6) AS ref_speed
    FROM grid g JOIN prof p ON g.race = p.race AND p.bin = least(floor(g.dist / 10), 99)""")
def _(spark, sf):
    out = GE.reference_speed(AD.grid(spark, sf).drop("ref_speed"), speed_profile(spark, sf), ["race"], AD.LENGTH)
    return out.select(*KEY, F.round(F.col("ref_speed") + 1e-9, 6).alias("ref_speed"))


def pit_points(spark, sf):
    g = AD.with_xy(AD.grid(spark, sf))
    laps = AD.laps(g)
    laps = laps.withColumns({"pit_in": F.col("pit_in") + GE.PIT_ROAD_S - 0.5, "pit_out": F.lit(None).cast("double")})
    return g, laps


@query("r12_pit_lane_points", sql(["grid", "gridxy", "laps"], "") + f""", {_REF},
spans AS (SELECT race, drv, pit_in - 0.5 AS lo, pit_in - 0.5 + 68 AS hi FROM laps WHERE pit_in IS NOT NULL)
SELECT DISTINCT p.race, round_even(p.x, 0) AS x, round_even(p.y, 0) AS y
FROM (SELECT race, drv, tick, x, y, ((r.nx - r.x) * (y - r.y) - (r.ny - r.y) * (x - r.x)) / n AS lat FROM proj) p
JOIN grid g USING (race, drv, tick)
WHERE abs(lat) > 7 AND EXISTS (SELECT 1 FROM spans s WHERE s.race = p.race AND s.drv = p.drv AND g.t BETWEEN s.lo AND s.hi)""")
def _(spark, sf):
    g, laps = pit_points(spark, sf)
    return GE.pit_lane_points(g.select(*KEY, "t", "x", "y"), laps, AD.ring_reference(g), F.lit(AD.LENGTH))


@query("r13_near_pit", sql(["grid", "gridxy"], """
    SELECT g.race, g.drv, g.tick, abs(g.lat_off) > 7 AND EXISTS (
        SELECT 1 FROM gridxy p WHERE p.race = g.race AND p.event_id % 50 = 0 AND sqrt(pow(p.x - g.x, 2) + pow(p.y - g.y, 2)) < 4) AS near_pit FROM gridxy g"""))
def _(spark, sf):
    g = AD.with_xy(AD.grid(spark, sf))
    return GE.near_pit(g, g.filter("event_id % 50 = 0").select("race", "x", "y"), ["race"]).select(*KEY, "near_pit")


@query("r14_corners", "SELECT event_id, round(value * 100 * 0.1, 1) AS x, round(value * 50 * 0.1, 1) AS y FROM events")
def _(spark, sf):
    raw = AD.table(spark, sf, "events").select("event_id", (F.col("value") * 100).alias("x"), (F.col("value") * 50).alias("y"))
    return GE.corners(raw)


@query("r15_r16_r17_ring_functions", sql(["grid"], """
    SELECT race, drv, tick, (((dist - 437 + 500) % 1000) + 1000) % 1000 - 500 AS circ,
           CAST((((msector - CAST(event_id % 10 AS INT) - 1 + 5) % 10) + 10) % 10 - 5 AS INT) AS off,
           (((msector - CAST(event_id % 10 AS INT) - 1 + 5) % 10) + 10) % 10 - 5 BETWEEN -1 AND 2 AS matches,
           abs((((msector - CAST(event_id % 10 AS INT) - 1 + 5) % 10) + 10) % 10 - 5) <= 1 AS near FROM grid"""))
def _(spark, sf):
    flagged, n = (F.col("event_id") % 10 + 1).cast("int"), F.lit(10)
    return AD.grid(spark, sf).select(*KEY, ring.circ(F.col("dist") - 437, F.lit(1000.0)).alias("circ"),
                                     ring.sector_offset("msector", flagged, n).alias("off"),
                                     ring.sector_matches("msector", flagged, n).alias("matches"), ring.near_sector("msector", flagged, n).alias("near"))


@query("r18_race_laps", """SELECT o_orderkey, CAST(CASE WHEN o_totalprice / 20 >= 1000 THEN
    ceil(CASE WHEN o_orderpriority = '1-URGENT' THEN 260000 ELSE 305000 END / (o_totalprice / 20)) END AS INT) AS laps FROM orders""")
def _(spark, sf):
    o = AD.table(spark, sf, "orders")
    return o.select("o_orderkey", ring.race_laps(F.col("o_totalprice") / 20, F.col("o_orderpriority") == "1-URGENT").alias("laps"))
