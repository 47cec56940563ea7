"""Raw session tables and the ranking of races to build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# fixed values: columns of the landed tables, times in seconds of the session
SCHEMAS = {
    "raw_car": "race string, drv string, t double, speed double, throttle double, brake double, gear int, rpm double",
    "raw_pos": "race string, drv string, t double, x double, y double, z double",
    "laps": "race string, drv string, lap int, t_start double, t_end double, lap_s double, pit_in double, pit_out double, "
            "compound string, tyre_life double, stint int, track_status string, accurate boolean",
    "rc_messages": "race string, time timestamp, category string, message string, flag string, scope string, sector int, car string",
    "track_status": "race string, t double, track_status string",
    "weather": "race string, t double, air_temp double, track_temp double, rainfall double",
}
# fixed values: races no training or tuning may read
HOLDOUT = [(2026, "Baku"), (2026, "Madrid")]
HOLDOUT_IDS = ["2026_Azerbaijan", "2026_Spanish"]


class HoldoutError(RuntimeError):
    """Training or tuning asked for a holdout race."""


def read_raw(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    """One landed table with its declared schema; no inference pass over the data."""
    reader = spark.read.schema(SCHEMAS[name])
    return (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path)


def without_nan(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating column: comparisons and windows skip missing values."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def count_events(messages: DataFrame, flag: Column | None = None) -> DataFrame:
    """Per race: yellow, double_yellow, sc, vsc and red messages."""
    from trackguard.operators.alignment import classify
    kind = flag if flag is not None else classify(F.col("category"), F.col("message"), F.col("flag"))
    names = {"yellow": "YELLOW", "double_yellow": "DOUBLE_YELLOW", "sc": "SC", "vsc": "VSC", "red": "RED"}
    return messages.groupBy("race").agg(*[F.count_if(kind == v).alias(k) for k, v in names.items()])


def score() -> Column:
    """Rarer and bigger events weigh more."""
    return F.col("yellow") + 2 * F.col("double_yellow") + 5 * F.col("vsc") + 8 * F.col("sc") + 10 * F.col("red")


def top_races(ranking: DataFrame, n: int) -> DataFrame:
    """The n races with the highest score, rows with an error left out (ties by race)."""
    ok = ranking.filter(F.coalesce("error", F.lit("")) == "")
    return ok.orderBy(F.desc("score"), "race").limit(n)


def not_yet_scanned(season: DataFrame, ranking: DataFrame) -> DataFrame:
    """Races of the season without a good row in the ranking."""
    return season.join(ranking.filter(F.coalesce("error", F.lit("")) == "").select("race"), "race", "left_anti")


def race_id(year: Column, event: Column) -> Column:
    """'2024_Las_Vegas' from 2024 and 'Las Vegas Grand Prix'."""
    name = F.replace(F.trim(F.replace(event, F.lit("Grand Prix"), F.lit(""))), F.lit(" "), F.lit("_"))
    return F.concat(year.cast("string"), F.lit("_"), name)


def is_holdout(year: Column, location: Column, race: Column) -> Column:
    pairs = F.lit(False)
    for y, place in HOLDOUT:
        pairs = pairs | ((year == y) & (F.trim(location) == place))
    return race.isin(HOLDOUT_IDS) | F.coalesce(pairs, F.lit(False))


def without_holdout(races: DataFrame) -> DataFrame:
    """Races (race, year, location) fit for training and tuning."""
    return races.filter(~is_holdout(F.col("year"), F.col("location"), F.col("race")))


def assert_no_holdout(df: DataFrame) -> DataFrame:
    """Raises when a holdout race is among the rows; called on top of training and tuning."""
    if not df.filter(F.col("race").isin(HOLDOUT_IDS)).isEmpty():
        raise HoldoutError("refusing to train or tune on a holdout race")
    return df


def check_races(ranking: DataFrame, training: DataFrame, n: int = 20) -> DataFrame:
    """The next n races of the ranking that are neither training nor holdout races."""
    fresh = ranking.filter(~F.col("race").isin(HOLDOUT_IDS)).join(training.select("race"), "race", "left_anti")
    return top_races(fresh, n)
