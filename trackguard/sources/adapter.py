"""Race-shaped tables derived from the driver's tables.

The same definitions exist as SQL text (`GRID_SQL`, `OFFICIAL_SQL`), which the oracles use.
Each user of `events` is a car, its events in order are the 250 ms ticks; four races, a 1000 m
ring with 10 marshal sectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trackguard.functions.timeline import running

LENGTH = 1000.0
SECTORS = 10
DAY_S = 86400.0

GRID_SQL = """
SELECT concat('R', CAST(user_id % 4 AS VARCHAR)) AS race, CAST(user_id AS VARCHAR) AS drv,
       CAST(k * 0.25 AS DOUBLE) AS t, CAST(k AS INT) AS tick,
       CAST((60 * k + 137 * user_id) % 1000 AS DOUBLE) AS dist,
       CAST(1 + floor((60 * k + 137 * user_id) / 1000) AS INT) AS drv_lap,
       CAST(1 + floor(((60 * k + 137 * user_id) % 1000) / 100) AS INT) AS msector,
       CAST(CASE WHEN event_id % 53 = 0 THEN NULL ELSE value END AS DOUBLE) AS speed,
       CAST(40 + 10 * (((60 * k + 137 * user_id) % 1000) % 7) AS DOUBLE) AS ref_speed,
       CAST((event_id * 13) % 101 AS DOUBLE) AS throttle,
       event_type = 'error' AS brake, event_type = 'signup' AND event_id % 3 = 0 AS in_pit,
       CAST(((event_id * 7) % 2001 - 1000) / 100.0 AS DOUBLE) AS lat_off,
       CASE CAST(floor(k / 16) AS INT) % 5 WHEN 1 THEN '2' WHEN 2 THEN '4' WHEN 3 THEN '6' ELSE '1' END AS track_status,
       event_id
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events) e
"""

OFFICIAL_SQL = """
SELECT race, t, tick, event_id,
  CASE (event_id % 6) WHEN 0 THEN 'YELLOW' WHEN 1 THEN 'DOUBLE_YELLOW' WHEN 2 THEN 'VSC' WHEN 3 THEN 'SC'
       WHEN 4 THEN 'RED' ELSE 'CLEAR' END AS flag,
  CASE WHEN event_id % 6 IN (0, 1, 5) THEN msector END AS msector
FROM grid WHERE event_id % 41 = 0
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (race, drv, tick). A car's ticks are numbered per day and offset by the
    counts of its earlier days, so no task sorts a whole car."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value",
                                               F.col("ts").cast("timestamp").alias("ts"))
    sec = F.unix_micros("ts") / F.lit(1e6)
    ev = running(ev, ["user_id"], F.floor(sec / DAY_S), ["ts", "event_id"], sums={"_n": F.lit(1).cast("bigint")})
    k, eid = F.col("_n") - 1, F.col("event_id")
    run = 60 * k + 137 * F.col("user_id")
    pos = run % 1000
    phase = F.floor(k / 16).cast("int") % 5
    return ev.select(
        F.concat(F.lit("R"), (F.col("user_id") % 4).cast("string")).alias("race"),
        F.col("user_id").cast("string").alias("drv"), (k * 0.25).cast("double").alias("t"), k.cast("int").alias("tick"),
        pos.cast("double").alias("dist"), (1 + F.floor(run / 1000)).cast("int").alias("drv_lap"),
        (1 + F.floor(pos / 100)).cast("int").alias("msector"),
        F.when(eid % 53 != 0, F.col("value")).alias("speed"),
        (40 + 10 * (pos % 7)).cast("double").alias("ref_speed"),
        ((eid * 13) % 101).cast("double").alias("throttle"), (F.col("event_type") == "error").alias("brake"),
        ((F.col("event_type") == "signup") & (eid % 3 == 0)).alias("in_pit"),
        (((eid * 7) % 2001 - 1000) / 100.0).cast("double").alias("lat_off"),
        F.when(phase == 1, "2").when(phase == 2, "4").when(phase == 3, "6").otherwise("1").alias("track_status"),
        "event_id")


def official(g: DataFrame) -> DataFrame:
    """Race control messages: about 1 in 41 grid rows."""
    m = F.col("event_id") % 6
    flag = (F.when(m == 0, "YELLOW").when(m == 1, "DOUBLE_YELLOW").when(m == 2, "VSC").when(m == 3, "SC")
            .when(m == 4, "RED").otherwise("CLEAR"))
    return g.filter(F.col("event_id") % 41 == 0).select(
        "race", "t", "tick", "event_id", flag.alias("flag"), F.when(m.isin(0, 1, 5), F.col("msector")).alias("msector"))


def ring_xy(dist, lat=0.0):
    """Position on the adapter's track, a square of 250 m sides, `lat` metres to its left."""
    d, lat = (F.col(dist) if isinstance(dist, str) else dist), (F.col(lat) if isinstance(lat, str) else F.lit(lat))
    x = F.when(d < 250, d).when(d < 500, 250 - lat).when(d < 750, 750 - d).otherwise(lat)
    y = F.when(d < 250, lat).when(d < 500, d - 250).when(d < 750, 250 - lat).otherwise(1000 - d)
    return x.cast("double"), y.cast("double")


RING_SQL = """
CASE WHEN dist < 250 THEN dist WHEN dist < 500 THEN 250 - lat_off WHEN dist < 750 THEN 750 - dist ELSE lat_off END AS x,
CASE WHEN dist < 250 THEN lat_off WHEN dist < 500 THEN dist - 250 WHEN dist < 750 THEN 250 - lat_off ELSE 1000 - dist END AS y
"""


def with_xy(g: DataFrame) -> DataFrame:
    x, y = ring_xy("dist", "lat_off")
    return g.withColumns({"x": x, "y": y})


def ring_reference(g: DataFrame, step: float = 5.0) -> DataFrame:
    """Reference points (race, i, dist, x, y) of every race in `g`."""
    at = g.select("race").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(int(LENGTH / step) - 1))))
    at = at.withColumn("dist", (F.col("i") * step).cast("double"))
    x, y = ring_xy("dist")
    return at.withColumns({"x": x, "y": y})


def sector_table(g: DataFrame) -> DataFrame:
    """The ten marshal sectors of every race, shifted so that the last one wraps at the line."""
    at = g.select("race").distinct().withColumn("id", F.explode(F.sequence(F.lit(1), F.lit(SECTORS))))
    start = (F.col("id") - 1) * 100 + 30
    return at.select("race", "id", (start % 1000).cast("double").alias("start_dist"), ((start + 100) % 1000).cast("double").alias("end_dist"))


LAPS_SQL = """
SELECT race, drv, drv_lap AS lap, min(t) AS t_start, max(t) + 0.25 AS t_end, max(t) + 0.25 - min(t) AS lap_s,
       CASE WHEN (drv_lap * 7 + CAST(drv AS INT)) % 5 = 0 THEN min(t) + 1.0 END AS pit_in,
       CASE WHEN (drv_lap * 3 + CAST(drv AS INT)) % 4 = 0 THEN min(t) + 0.5 END AS pit_out,
       min(track_status) AS track_status, max(event_id) % 3 > 0 AS accurate,
       CASE max(event_id) % 4 WHEN 0 THEN 'SOFT' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HARD' END AS compound,
       CAST(max(event_id) % 30 AS DOUBLE) AS tyre_life, CAST(1 + floor(drv_lap / 2) AS INT) AS stint
FROM grid GROUP BY race, drv, drv_lap
"""


def laps(g: DataFrame) -> DataFrame:
    """Lap times of the grid's cars, with made-up stops and tyres."""
    lap, car, last = F.col("drv_lap"), F.col("drv").cast("int"), F.max("event_id")
    return g.groupBy("race", "drv", "drv_lap").agg(
        F.min("t").alias("t_start"), (F.max("t") + 0.25).alias("t_end"), (F.max("t") + 0.25 - F.min("t")).alias("lap_s"),
        F.min("track_status").alias("track_status"), last.alias("_e")).select(
        "race", "drv", lap.alias("lap"), "t_start", "t_end", "lap_s",
        F.when((lap * 7 + car) % 5 == 0, F.col("t_start") + 1.0).alias("pit_in"),
        F.when((lap * 3 + car) % 4 == 0, F.col("t_start") + 0.5).alias("pit_out"),
        "track_status", (F.col("_e") % 3 > 0).alias("accurate"),
        F.when(F.col("_e") % 4 == 0, "SOFT").when(F.col("_e") % 4 == 1, "MEDIUM").when(F.col("_e") % 4 == 2, "HARD").alias("compound"),
        (F.col("_e") % 30).cast("double").alias("tyre_life"), (1 + F.floor(lap / 2)).cast("int").alias("stint"))


MESSAGES_SQL = """
SELECT race, t, event_id, CASE WHEN event_id % 7 < 3 THEN 'SafetyCar' WHEN event_id % 7 = 3 THEN 'Drs' ELSE 'Flag' END AS category,
       CASE event_id % 11 WHEN 0 THEN 'SAFETY CAR DEPLOYED' WHEN 1 THEN 'VIRTUAL SAFETY CAR DEPLOYED' WHEN 2 THEN 'VSC DEPLOYED'
            WHEN 3 THEN 'VIRTUAL SAFETY CAR ENDING' WHEN 4 THEN 'CHEQUERED FLAG'
            WHEN 5 THEN concat('TURN 4 INCIDENT INVOLVING CARS ', drv, ' (AAA) AND ', CAST(tick AS VARCHAR), ' (BBB) NOTED')
            ELSE concat('CAR ', drv, ' (AAA) TIME ', CAST(t AS VARCHAR), ' DELETED') END AS message,
       CASE event_id % 9 WHEN 0 THEN 'YELLOW' WHEN 1 THEN 'DOUBLE YELLOW' WHEN 2 THEN 'RED' WHEN 3 THEN 'CLEAR' WHEN 4 THEN 'BLUE' END AS flag,
       CASE WHEN event_id % 2 = 0 THEN 'Sector' END AS scope, CASE WHEN event_id % 2 = 0 THEN msector END AS sector,
       CASE WHEN event_id % 13 = 0 THEN drv END AS car
FROM grid
"""


def messages(g: DataFrame) -> DataFrame:
    """Race control messages in the feed's own shape, one per grid row."""
    e = F.col("event_id")

    def case(m: int, values: dict[int, Column | str]) -> Column:
        out = F
        for k, v in values.items():
            out = out.when(e % m == k, v)
        return out
    text = case(11, {0: "SAFETY CAR DEPLOYED", 1: "VIRTUAL SAFETY CAR DEPLOYED", 2: "VSC DEPLOYED", 3: "VIRTUAL SAFETY CAR ENDING",
                     4: "CHEQUERED FLAG"})
    pair = F.concat(F.lit("TURN 4 INCIDENT INVOLVING CARS "), "drv", F.lit(" (AAA) AND "), F.col("tick").cast("string"), F.lit(" (BBB) NOTED"))
    lone = F.concat(F.lit("CAR "), "drv", F.lit(" (AAA) TIME "), F.col("t").cast("string"), F.lit(" DELETED"))
    return g.select(
        "race", "t", "event_id", F.when(e % 7 < 3, "SafetyCar").when(e % 7 == 3, "Drs").otherwise("Flag").alias("category"),
        text.when(e % 11 == 5, pair).otherwise(lone).alias("message"),
        case(9, {0: "YELLOW", 1: "DOUBLE YELLOW", 2: "RED", 3: "CLEAR", 4: "BLUE"}).alias("flag"),
        F.when(e % 2 == 0, "Sector").alias("scope"), F.when(e % 2 == 0, F.col("msector")).alias("sector"),
        F.when(e % 13 == 0, F.col("drv")).alias("car"))


def weather(g: DataFrame) -> DataFrame:
    """Weather samples: about one grid row in 97."""
    e = F.max("event_id")
    w = g.filter(F.col("event_id") % 97 == 0).groupBy("race", "t").agg(e.alias("_e"))
    return w.select("race", "t", (20 + F.col("_e") % 10).cast("double").alias("air_temp"),
                    (30 + F.col("_e") % 20).cast("double").alias("track_temp"), (F.col("_e") % 2).cast("double").alias("rainfall"))
