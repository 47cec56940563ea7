"""Folds and bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """True for rows that no model may learn from: crc32 of the id's text divisible by FOLDS. Rows without an id are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def sampled(ids: DataFrame, label: str, per_label: int) -> DataFrame:
    """About per_label ids of each label, chosen by the hash of the id; ids is (doc_id, label), one row per id. Nothing is collected:
    a label's share follows from its count."""
    counts = ids.groupBy(label).agg(F.count("*").alias("_n"))
    coin = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(71)), F.lit(1 << 30)).cast("double") / (1 << 30)
    return ids.join(counts, label).filter(coin * F.col("_n") < per_label).drop("_n")


def one_text_each(rows: DataFrame) -> DataFrame:
    """(doc_id, text, label) with one row per id: of several texts the one with the smallest hash, so that reruns agree."""
    return rows.groupBy("doc_id").agg(F.min_by("text", F.md5("text")).alias("text"), F.min("label").alias("label"))
