"""Feature tables, race metadata, track sidecars, message streams and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def write_features(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per race. Rows are spread by (race, chunk of time) so that a long race is written by
    many tasks, and sorted so that readers of a car or a time range skip row groups."""
    chunk = F.floor(F.col("tick") / 65536)
    (df.repartition("race", chunk).sortWithinPartitions("race", "drv", "tick").write.mode(mode).partitionBy("race").parquet(path))


def rewrite_races(df: DataFrame, path: str) -> None:
    """Replaces only the races present in `df`."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("race").parquet(path)


def rebuild_official(events: DataFrame, built: DataFrame, path: str) -> None:
    """Rewrites the official events of races already built; features stay as they are."""
    rewrite_races(events.join(built.select("race").distinct(), "race", "left_semi"), path)


def race_meta(df: DataFrame, window: DataFrame | None = None, length: DataFrame | None = None, sectors: DataFrame | None = None,
              alignment: DataFrame | None = None) -> DataFrame:
    """One row per race: rows, cars, time span, and what the other tables say about it."""
    out = df.groupBy("race").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("drv").alias("cars"), F.min("t").alias("t_first"),
                                 F.max("t").alias("t_last"))
    for other in (window, length, sectors, alignment):
        if other is not None:
            out = out.join(other, "race", "left")
    return out


def track_json(ref: DataFrame, sectors: DataFrame, corners: DataFrame | None = None) -> DataFrame:
    """(race, track): every second reference point, the sectors and the corners as one JSON text."""
    def packed(df: DataFrame, cols: list[str], name: str) -> DataFrame:
        return df.groupBy("race").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    line = ref.filter("i % 2 = 0").withColumns({"x": F.round("x", 1), "y": F.round("y", 1)})
    out = packed(line, ["i", "x", "y"], "_l").select("race", F.transform("_l", lambda p: F.array(p["x"], p["y"])).alias("ref_line"))
    out = out.join(packed(sectors, ["id", "start_dist", "end_dist"], "msectors"), "race", "left")
    if corners is not None:
        out = out.join(packed(corners, ["number", "x", "y"], "corners"), "race", "left")
    return out.select("race", F.to_json(F.struct("*")).alias("track"))


ENVELOPE = "race string, tick int, rank int, seq string, kind string, t double, payload string"


def write_jsonl(envs: DataFrame, path: str) -> None:
    """Envelopes as JSON lines, every file ordered in time within its race."""
    envs.repartition("race", F.floor(F.col("tick") / 4096)).sortWithinPartitions("race", "tick", "rank", "seq").write.mode(
        "overwrite").partitionBy("race").json(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENVELOPE).json(path)


def write_results(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A metrics table as markdown text. It is meant for report tables; a longer one is refused, not cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report table has at most {limit} rows")
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)]) + "\n"


def metrics(parts: dict[str, DataFrame], by: list[str] = []) -> DataFrame:
    """Result tables of one row each (per `by`), as (by, section, metric, value)."""
    out = None
    for section, df in parts.items():
        nums = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in by]
        items = F.array(*[F.struct(F.lit(section).alias("section"), F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in nums])
        rows = df.select(*by, F.explode(items).alias("_m")).select(*by, "_m.*")
        out = rows if out is None else out.unionByName(rows)
    return out
