"""Features on the grid (D1-D22)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackguard.operators import alignment as AL, features as FE
from trackguard.plans import pipeline
from trackguard.plans.registry import query, with_tables
from trackguard.plans.sqlparts import FEATURES, PARTS
from trackguard.sources import adapter as AD

KEY = ["race", "drv", "tick"]


def field_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Grid rows with gaps, own features and field state."""
    return pipeline.field_rows(AD.grid(spark, sf), AD.LENGTH)


def features(spark: SparkSession, sf: str) -> DataFrame:
    """The window features over the adapter's grid."""
    return FE.windows(FE.previous_lap(field_rows(spark, sf), AD.LENGTH))


def rounded(df: DataFrame, cols: list[str], nd: int = 6) -> DataFrame:
    """Rounded for comparison; the small offset settles exact halves the same way everywhere."""
    return df.select(*KEY, *[F.round(F.col(c) + 1e-9, nd).alias(c) for c in cols])


def pick(names: list[str], cols: list[str], nd: int = 6) -> str:
    return with_tables(PARTS, names, "SELECT race, drv, tick, " + ", ".join(f"round({c} + 1e-9, {nd}) AS {c}" for c in cols)
                       + f" FROM {names[-1]}")


UPTO = {n: FEATURES[:FEATURES.index(n) + 1] for n in FEATURES}

_D1 = ["speed_dev", "speed_ratio"]


@query("d1_speed_vs_reference", pick(UPTO["rowfeat"], _D1))
def _(spark, sf):
    return rounded(FE.per_row(AD.grid(spark, sf)), _D1)


_A12 = ["gap_ahead_m", "gap_behind_m"]


@query("a12_neighbour_gaps", with_tables(PARTS, ["grid", "gaps"],
                                         "SELECT race, drv, tick, gap_ahead_m, gap_behind_m, ahead_drv FROM gaps"))
def _(spark, sf):
    return AL.add_gaps(AD.grid(spark, sf), AD.LENGTH).select(*KEY, *_A12, "ahead_drv")


_D14 = ["field_in_pit", "field_slow", "field_ratio", "rel_ratio"]


@query("d14_field_state", with_tables(PARTS, UPTO["fieldrows"], "SELECT race, drv, tick, suspended, "
                                      + ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in _D14) + " FROM fieldrows"))
def _(spark, sf):
    return field_rows(spark, sf).select(*KEY, "suspended", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in _D14])


_D8 = ["race_dist", "prev_lap_speed", "lap_ratio"]


@query("d8_previous_lap", pick(UPTO["laprows"], _D8))
def _(spark, sf):
    return rounded(FE.previous_lap(field_rows(spark, sf), AD.LENGTH), _D8)


_D2 = ["dspeed_1s", "closing_rate", "lat_off_std_2s", "throttle_std_2s", "ratio_min_2s", "dspeed_min_2s", "lat_abs_max_2s",
       "brake_throttle_2s"]


@query("d2_car_dynamics", pick(FEATURES, _D2))
def _(spark, sf):
    return rounded(features(spark, sf), _D2)


_D19 = ["lap_ratio_min_2s", "rel_ratio_min_2s", "rel_ratio_min_5s", "lap_ratio_mean_5s", "lap_ratio_min_5s", "lat_off_std_5s",
        "throttle_std_5s", "brake_throttle_5s", "dspeed_min_5s", "closing_rate_max_5s"]


@query("d19_long_windows", pick(FEATURES, _D19))
def _(spark, sf):
    return rounded(features(spark, sf), _D19)


@query("d10_gap_seconds", with_tables(PARTS, UPTO["rowfeat"], """
    SELECT race, drv, tick, round(gap_ahead_s, 6) AS gap_ahead_s, round(gap_behind_s, 6) AS gap_behind_s,
           CAST(coalesce(gap_ahead_s < 1, false) AS INT) + CAST(coalesce(gap_behind_s < 1, false) AS INT) AS cars_within_1s
    FROM rowfeat"""))
def _(spark, sf):
    df = FE.gap_seconds(AL.add_gaps(AD.grid(spark, sf), AD.LENGTH))
    return df.select(*KEY, F.round("gap_ahead_s", 6).alias("gap_ahead_s"), F.round("gap_behind_s", 6).alias("gap_behind_s"),
                     "cars_within_1s")


_HEAD = """ringrows AS (SELECT g.*, greatest(ceil(dist / 5) - 1, 0) AS i FROM gridxy g),
refrows AS (SELECT *, CASE WHEN i < 50 THEN i * 5.0 WHEN i < 100 THEN 250 WHEN i < 150 THEN 750 - i * 5.0 ELSE 0 END::DOUBLE AS rx,
    CASE WHEN i < 50 THEN 0 WHEN i < 100 THEN i * 5.0 - 250 WHEN i < 150 THEN 250 ELSE 1000 - i * 5.0 END::DOUBLE AS ry FROM ringrows),
steps AS (SELECT race, drv, tick, x - lag(x, 4) OVER w AS dx, y - lag(y, 4) OVER w AS dy, rx - lag(rx, 4) OVER w AS ex, ry - lag(ry, 4) OVER w AS ey
    FROM refrows WINDOW w AS (PARTITION BY race, drv ORDER BY tick))
SELECT race, drv, tick, CASE WHEN sqrt(dx * dx + dy * dy) >= 4 AND sqrt(ex * ex + ey * ey) >= 4 THEN round(degrees(acos(greatest(-1, least(1,
    (dx * ex + dy * ey) / (sqrt(dx * dx + dy * dy) * sqrt(ex * ex + ey * ey) + 1e-9))))) + 1e-9, 4) END AS heading_err FROM steps"""


@query("d7_heading_error", with_tables(PARTS, ["grid", "gridxy"], "") + ", " + _HEAD)
def _(spark, sf):
    g = AD.grid(spark, sf)
    df = FE.reference_point(FE.per_row(AD.with_xy(g)), AD.ring_reference(g), ["race"])
    return rounded(FE.windows(df), ["heading_err"], 4)


@query("d11_lap_info", with_tables(PARTS, ["grid", "laps"], """
    SELECT g.race, g.drv, g.tick, l.lap AS drv_lap, coalesce(l.compound, 'UNKNOWN') AS compound, l.tyre_life, l.stint, l.lap - l.f AS laps_since_pit
    FROM (SELECT *, t - 0.3 AS q FROM grid) g
    ASOF LEFT JOIN (SELECT *, min(lap) OVER (PARTITION BY race, drv, stint) AS f FROM laps) l ON g.race = l.race AND g.drv = l.drv AND l.t_start <= g.q"""))
def _(spark, sf):
    g = AD.grid(spark, sf)
    df = FE.lap_features(g.withColumn("t", F.col("t") - 0.3), AD.laps(g))
    return df.select(*KEY, "drv_lap", "compound", "tyre_life", "stint", "laps_since_pit")


@query("d12_last_lap_delta", with_tables(PARTS, ["grid", "laps"], """
    SELECT g.race, g.drv, g.tick, round(l.d + 1e-9, 6) AS last_lap_delta FROM grid g
    ASOF LEFT JOIN (SELECT race, drv, t_end, lap_s / median(lap_s) OVER (PARTITION BY race, drv ORDER BY lap ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) - 1 AS d
                    FROM laps) l ON g.race = l.race AND g.drv = l.drv AND l.t_end <= g.t"""))
def _(spark, sf):
    g = AD.grid(spark, sf)
    return rounded(FE.lap_features(g, AD.laps(g)), ["last_lap_delta"])


@query("d13_weather", with_tables(PARTS, ["grid"], """
    SELECT g.race, g.drv, g.tick, w.air_temp, w.track_temp, w.rainfall FROM grid g
    ASOF LEFT JOIN (SELECT race, t, 20 + max(event_id) % 10 * 1.0::DOUBLE AS air_temp, 30 + max(event_id) % 20 * 1.0::DOUBLE AS track_temp,
                           (max(event_id) % 2)::DOUBLE AS rainfall FROM grid WHERE event_id % 97 = 0 GROUP BY race, t) w
    ON g.race = w.race AND w.t <= g.t"""))
def _(spark, sf):
    g = AD.grid(spark, sf)
    return FE.weather(g, AD.weather(g)).select(*KEY, "air_temp", "track_temp", "rainfall")


_D16 = ["rel_ratio", "rel_ratio_min_2s"]


@query("d15_d16_suspended_and_relative_pace", with_tables(PARTS, FEATURES, "SELECT race, drv, tick, suspended, "
                                                          + ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in _D16) + " FROM features"))
def _(spark, sf):
    df = FE.windows(field_rows(spark, sf))
    return df.select(*KEY, "suspended", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in _D16])


@query("d17_d18_race_context", with_tables(PARTS, ["grid"], """
    SELECT g.race, g.drv, g.tick, g.t - e.t_end AS t_since_restart, CAST(g.drv_lap = 1 AS INT) AS is_lap1 FROM grid g
    JOIN (SELECT race, tick, max(CASE WHEN ended THEN t END) OVER (PARTITION BY race ORDER BY tick) AS t_end
          FROM (SELECT race, tick, t, coalesce(lag(n) OVER (PARTITION BY race ORDER BY tick), false) AND NOT n AS ended
                FROM (SELECT race, tick, min(t) AS t, min(track_status) IN ('4', '5', '6', '7') AS n FROM grid GROUP BY race, tick) q) q) e USING (race, tick)"""))
def _(spark, sf):
    return FE.race_context(AD.grid(spark, sf)).select(*KEY, "t_since_restart", FE.is_lap1().alias("is_lap1"))


@query("d20_feature_profile", with_tables(PARTS, UPTO["rowfeat"], " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}) + 1e-9, 6) AS mean, round(min({c}) + 1e-9, 6) AS low, round(max({c}) + 1e-9, 6) AS high FROM rowfeat"""
    for c in ["speed", "speed_ratio", "lat_off_abs", "gap_ahead_m"])))
def _(spark, sf):
    df = FE.profile(FE.per_row(AL.add_gaps(AD.grid(spark, sf), AD.LENGTH)), ["speed", "speed_ratio", "lat_off_abs", "gap_ahead_m"])
    return df.select("column", "n", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("mean", "low", "high")])


@query("d21_flag_alignment", with_tables(PARTS, ["grid", "official", "gaps", "rowfeat", "field", "fieldrows", "ticks"], """
    SELECT race, count(*) FILTER (hit) AS hits, count(*) AS total FROM (
        SELECT o.race, EXISTS (SELECT 1 FROM fieldrows f WHERE f.race = o.race AND f.speed_ratio < 0.6 AND NOT f.in_pit AND f.msector > 0
                               AND f.t BETWEEN o.t - 20 AND o.t + 2 AND (((f.msector - o.msector + 5) % 10) + 10) % 10 - 5 BETWEEN -1 AND 2) AS hit
        FROM official o ASOF JOIN ticks k ON k.race = o.race AND k.t <= o.t
        WHERE o.flag IN ('YELLOW', 'DOUBLE_YELLOW') AND o.msector IS NOT NULL AND k.t >= o.t - 1
          AND k.track_status NOT IN ('4', '5', '6', '7') AND NOT k.suspended AND k.field_slow < 0.5) q GROUP BY race"""))
def _(spark, sf):
    return FE.flag_alignment(field_rows(spark, sf), AD.official(AD.grid(spark, sf)), AD.SECTORS)


@query("d22_feature_pipeline")
def _(spark, sf):
    g = AD.grid(spark, sf)
    df = pipeline.build_features(AD.with_xy(g), AD.laps(g), AD.weather(g), AD.ring_reference(g), AD.LENGTH)
    nums = [c for c, t in df.dtypes if t == "double" and c not in ("t",)]
    return df.select(*KEY, "compound", *[F.round(c, 4).alias(c) for c in nums])
