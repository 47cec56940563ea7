"""Rows that meet the models of their own fold: models that were learnt without the race that they score."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

PART_ROWS = 50_000       # rows of a fold that one task scores


def races_of(rows: DataFrame) -> list[str]:
    """The names of the races, the only thing about them that comes to the driver."""
    return [r["race"] for r in rows.select("race").distinct().orderBy("race").collect()]


def other_races(races: Sequence[str]) -> Column:
    """The folds that a row may be learnt in: all but its own race."""
    return F.filter(F.array(*[F.lit(r) for r in races]), lambda r: r != F.col("race"))


def scored_by_fold(rows: DataFrame, models: DataFrame, key: Sequence[str], score: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, part_rows: int | None = None) -> DataFrame:
    """What score(rows, models) gives for the rows of each fold and the models of that fold. rows and models have a column fold; a fold's
    rows are dealt by their key into parts of about part_rows, each of which gets the fold's models. Rows without a model go to score
    with an empty table of models."""
    parts = rows.groupBy("fold").agg(F.ceil(F.count("*") / (part_rows or PART_ROWS)).alias("_parts"))
    held = models.join(parts.withColumnRenamed("fold", "_fold"), F.col("fold") == F.col("_fold")).withColumn("_part", F.explode(F.expr("sequence(0L, _parts - 1)"))).drop("_fold", "_parts")
    held = held.select(F.col("fold").alias("_of"), *[c for c in held.columns if c != "fold"])
    asked = rows.join(parts.withColumnsRenamed({"fold": "_fold"}), F.col("fold") == F.col("_fold")).drop("_fold")
    asked = asked.withColumn("_part", F.pmod(F.xxhash64(*key), F.col("_parts"))).drop("_parts")
    return asked.groupBy("fold", "_part").cogroup(held.groupBy("_of", "_part")).applyInPandas(score, schema)
