"""Checks of the message tables: required values, ranges, names, order and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trackguard.functions.timeline import chunk_of, running

# fixed values: names the contracts allow
TYPES = ["STOPPED", "IMPACT", "SPIN", "DROPOUT", "MULTI", "ANOMALY"]
FLAGS = ["CLEAR", "YELLOW", "DOUBLE_YELLOW", "VSC", "SC", "RED"]
STATUSES = ["1", "2", "4", "5", "6", "7"]


def _share(c: str) -> Column:
    return F.col(c).isNull() | ~F.col(c).between(0.0, 1.0)


def rules(kind: str) -> dict[str, Column]:
    """What a row of each contract must not be."""
    if kind == "tick":
        return {"t missing": F.col("t").isNull(), "unknown status": ~F.col("track_status").isin(STATUSES),
                "negative speed": F.coalesce(F.col("speed") < 0, F.lit(False))}
    if kind == "detection":
        return {"id missing": F.col("id").isNull(), "unknown type": ~F.col("type").isin(TYPES),
                "no drivers": F.size("drivers") < 1, "severity outside 0..1": _share("severity")}
    if kind == "risk":
        return {"risk_10s outside 0..1": _share("risk_10s"), "risk_30s outside 0..1": _share("risk_30s")}
    if kind == "rec":
        return {"unknown flag": ~F.col("flag").isin(FLAGS), "confidence outside 0..1": _share("confidence"),
                "no message": F.col("message").isNull()}
    return {"unknown flag": ~F.col("flag").isin(FLAGS), "t missing": F.col("t").isNull()}


def violations(df: DataFrame, kind: str, key: str = "id") -> DataFrame:
    """(kind, race, key, rule) for every row that breaks a rule of its contract."""
    broken = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules(kind).items()]), lambda r: r.isNotNull())
    return df.select(F.lit(kind).alias("kind"), "race", F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule"))


def out_of_order(df: DataFrame, kind: str, key: str = "id") -> DataFrame:
    """Rows whose time lies before an earlier id's time."""
    late = running(df.withColumn("_n", F.regexp_extract(F.col(key).cast("string"), r"(\d+)$", 1).cast("bigint")), ["race"],
                   chunk_of("_n", 65536), ["_n"], maxs={"_max": F.col("t")})
    return late.filter("t < _max").select(F.lit(kind).alias("kind"), "race", F.col(key).cast("string").alias("key"), F.lit("time goes back").alias("rule"))


def dangling_sources(recs: DataFrame, dets: DataFrame) -> DataFrame:
    """Recommendations naming a detection that does not exist."""
    named = recs.select("race", "id", F.explode("source_detections").alias("_d"))
    lost = named.join(dets.select("race", F.col("id").alias("_d")), ["race", "_d"], "left_anti")
    return lost.select(F.lit("rec").alias("kind"), "race", F.col("id").alias("key"), F.lit("unknown source detection").alias("rule")).distinct()


def unknown_drivers(dets: DataFrame, df: DataFrame) -> DataFrame:
    """Detections of cars that no tick has."""
    named = dets.select("race", "id", F.explode("drivers").alias("drv"))
    lost = named.join(df.select("race", "drv").distinct(), ["race", "drv"], "left_anti")
    return lost.select(F.lit("detection").alias("kind"), "race", F.col("id").alias("key"), F.lit("unknown driver").alias("rule")).distinct()
