"""Mixing sources to target weights, with DataFrame operations only.

Sizes are summed per source, every source gets a target, and target / size is its repetition rate. A document is emitted
floor(rate) times, and once more if its hash-seeded coin, whose probability is the fraction of the rate, says so.

The coin of a document is a number of 48 bits from the MD5 of its id (of its text where the id is null), shifted by its source's
offset. Of OFFSETS offsets a source takes the one under which its documents come nearest to the target (the smallest, if
several do); each offset is a fair draw, and the choice needs one more aggregation of a few numbers per source.

Defined results: null text has size 0; null is a source of its own, after all others; sources are ordered by code point and take
the weights in turn; a source of size 0 has target 0 and rate 1; repeated rows are documents of their own (rows that
repeat an id share its coin); an empty table gives an empty mix. Nothing is shuffled but per-source sums: the documents
themselves are only mapped, against a table with one row per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trackguard.session import stored

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)          # all targets together: 150 % of all sizes
LIMIT = 2               # no target above so many times its source's size
OFFSETS = 64
_COIN = 1 << 48


def size_of(text: Column) -> Column:
    """Words between white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def coin_of(doc_id: Column, text: Column) -> Column:
    seed = F.coalesce(F.concat(F.lit("id:"), doc_id.cast("string")), F.concat(F.lit("text:"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(seed), 1, 12), 16, 10).cast("long")


def taken_coin(coin: Column, offset: Column, fraction: Column) -> Column:
    """Whether the shifted coin falls below the fraction."""
    return F.pmod(coin + offset, F.lit(_COIN)).cast("double") < fraction * float(_COIN)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, limit: int = LIMIT) -> DataFrame:
    """From (source, source_size), one row per source: target and rate. The sources that the limit holds back are those with the
    smallest limit per weight; the others share what is left by weight."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = by_room.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    t = sizes.withColumn("weight", turn).withColumn("cap", F.col("source_size") * limit)
    t = (t.withColumn("left_twice", F.sum("source_size").over(whole) * share[0] - F.coalesce(F.sum("cap").over(before), F.lit(0)) * share[1])
         .withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    level = F.col("left_twice") / (F.col("left_weight") * share[1])
    t = t.withColumn("held", F.col("cap") <= level * F.col("weight"))
    # the first source that has room sets the level for all that have
    t = t.withColumn("level", F.min(F.when(~F.col("held"), F.struct(F.col("cap") / F.col("weight"), "source", level.alias("level")))).over(whole)["level"])
    target = F.when(F.col("held"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0)
    return t.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def rates(measured: DataFrame, offsets: int = OFFSETS, **more) -> DataFrame:
    """From (source, size, coin), one row per source: source_size, target, copies, fraction and the offset of its coins."""
    per = targets(measured.groupBy("source").agg(F.sum("size").alias("source_size")), **more)
    per = per.select("source", "source_size", "target", F.floor("rate").alias("copies"), (F.col("rate") - F.floor("rate")).alias("fraction"))
    shifts = [k * (_COIN // offsets) for k in range(offsets)]
    drawn = (with_rates(measured, per).groupBy("source")
             .agg(*[F.sum(F.when(taken_coin(F.col("coin"), F.lit(s), F.col("fraction")), F.col("size")).otherwise(0)).alias(f"draw{k}") for k, s in enumerate(shifts)]))
    miss = F.array(*[F.struct(F.abs(F.col("source_size") * F.col("copies") + F.col(f"draw{k}") - F.col("target")).alias("miss"), F.lit(s).alias("offset")) for k, s in enumerate(shifts)])
    return with_rates(drawn, per).select("source", "source_size", "target", "copies", "fraction", F.array_min(miss)["offset"].alias("offset"))


def with_rates(rows: DataFrame, per: DataFrame) -> DataFrame:
    """Joins per-source rows; null is a source like others. The planner broadcasts per where its measured size allows."""
    per = per.withColumnRenamed("source", "_source")
    return rows.join(per, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), size_of(F.col(text)).alias("size"),
                       coin_of(F.col(doc_id), F.col(text)).alias("coin"))


def mix_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **more) -> DataFrame:
    """Per document: its size, its source's size and target, and the words that the mix takes of it."""
    rows = stored(measured(docs, doc_id, text, source))
    copies = F.col("copies") + taken_coin(F.col("coin"), F.col("offset"), F.col("fraction")).cast("long")
    return with_rates(rows, stored(rates(rows, **more))).select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **more) -> DataFrame:
    """The mixed corpus: docs' columns, every row as often as the mix takes it. A source without words is kept as it is."""
    per = stored(rates(stored(measured(docs, doc_id, text, source)), **more))
    carried = [F.col(c).alias(f"_own_{i}") for i, c in enumerate(docs.columns)]
    own = docs.select(*carried, F.col(source).cast("string").alias("source"), coin_of(F.col(doc_id), F.col(text)).alias("coin"))
    times = F.col("copies") + taken_coin(F.col("coin"), F.col("offset"), F.col("fraction")).cast("long")
    out = with_rates(own, per).withColumn("_copy", F.explode(F.array_repeat(F.lit(1), times.cast("int"))))
    return out.select(*[F.col(f"_own_{i}").alias(c) for i, c in enumerate(docs.columns)])
