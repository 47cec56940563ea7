"""Windows over long time lines without one task holding a whole key.

A key (a race, a car) can hold any share of the data, so no helper here partitions by the
key alone. Rows are cut into time chunks and windows run inside (key, chunk):

* bounded look-back: the last ticks of a chunk are copied into the next one (`with_history`);
* unbounded look-back: each chunk is reduced to one summary row, the summaries are scanned,
  and the result is carried into the following chunk (`running`).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CHUNK_TICKS = 4096


def chunk_of(value: Column | str, size: float) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value / F.lit(size)).cast("bigint")


def with_history(df: DataFrame, back: float, size: float = CHUNK_TICKS, on: str = "tick") -> DataFrame:
    """Adds `_chunk`, repeating rows in every later chunk that looks `back` ticks into the past."""
    return df.withColumn("_chunk", F.explode(F.sequence(chunk_of(on, size), chunk_of(F.col(on) + F.lit(back), size))))


def own_rows(df: DataFrame, size: float = CHUNK_TICKS, on: str = "tick", keep_chunk: bool = False) -> DataFrame:
    """Drops the copies `with_history` made. With `keep_chunk` the chunk stays, so that a `running`
    over F.col("_chunk") reuses the partitioning."""
    df = df.filter(F.col("_chunk") == chunk_of(on, size))
    return df if keep_chunk else df.drop("_chunk")


def in_chunk(keys: Sequence[str], order: str | Sequence[str] = "tick"):
    order = [order] if isinstance(order, str) else list(order)
    return W.partitionBy(*keys, "_chunk").orderBy(*order)


def running(df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str], *,
            starts: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None,
            lasts_before: dict[str, Column] | None = None, nexts: dict[str, Column] | None = None,
            sums: dict[str, Column] | None = None, maxs: dict[str, Column] | None = None) -> DataFrame:
    """Running values over the whole time line of each key, computed chunk by chunk.

    starts        first order value of the run a row is in. The column given is the run state:
                  True is inside, False ends the run, NULL leaves it as it is. NULL outside runs.
    lasts         latest non-null value up to and including the row
    lasts_before  latest non-null value strictly before the row
    nexts         first non-null value strictly after the row
    sums, maxs    running sum and running maximum, row included
    """
    starts, lasts, lasts_before, nexts = starts or {}, lasts or {}, lasts_before or {}, nexts or {}
    sums, maxs = sums or {}, maxs or {}
    names = [*starts, *lasts, *lasts_before, *nexts, *sums, *maxs]
    group = [*keys, "_ck"]
    values = {**starts, **lasts, **lasts_before, **nexts, **sums, **maxs}
    base = df.withColumns({"_ck": chunk, **{f"_v_{n}": c for n, c in values.items()}})
    spec = W.partitionBy(*group).orderBy(*order)
    upto, before = spec.rowsBetween(W.unboundedPreceding, 0), spec.rowsBetween(W.unboundedPreceding, -1)
    # looking ahead is looking back in reverse order: a frame that only grows
    after = W.partitionBy(*group).orderBy(*[F.desc(o) for o in order]).rowsBetween(W.unboundedPreceding, -1)
    pos, at = F.col(order[0]), F.struct(*order)

    if starts:
        base = base.withColumns({f"_p_{n}": F.last(f"_v_{n}", ignorenulls=True).over(before) for n in starts})
        base = base.withColumns({f"_b_{n}": F.when(F.col(f"_v_{n}") & ~F.coalesce(f"_p_{n}", F.lit(False)), pos)
                                 for n in starts})
    local, tails, carry, final = {}, [], {}, {}
    by_chunk = W.partitionBy(*keys).orderBy("_ck")
    earlier = by_chunk.rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy(*keys).orderBy(F.desc("_ck")).rowsBetween(W.unboundedPreceding, -1)
    for n in names:
        v, mine, tail, came = F.col(f"_v_{n}"), F.col(f"_l_{n}"), F.col(f"_t_{n}"), F.col(f"_c_{n}")
        if n in starts:
            local[f"_open_{n}"] = F.coalesce(F.min(v).over(upto), F.lit(True))
            local[f"_l_{n}"] = F.when(F.last(v, ignorenulls=True).over(upto),
                                      F.last(f"_b_{n}", ignorenulls=True).over(upto))
            tails += [F.coalesce(F.bool_or(~v), F.lit(False)).alias(f"_brk_{n}"), F.max_by(f"_l_{n}", at).alias(f"_t_{n}")]
            final[n] = F.when(F.col(f"_open_{n}") & came.isNotNull(), came).otherwise(mine)
        elif n in sums:
            local[f"_l_{n}"], carry[n] = F.sum(v).over(upto), F.sum(tail).over(earlier)
            tails.append(F.sum(v).alias(f"_t_{n}"))
            final[n] = F.coalesce(mine, F.lit(0)) + F.coalesce(came, F.lit(0))
        elif n in maxs:
            local[f"_l_{n}"], carry[n] = F.max(v).over(upto), F.max(tail).over(earlier)
            tails.append(F.max(v).alias(f"_t_{n}"))
            final[n] = F.greatest(mine, came)
        elif n in nexts:
            local[f"_l_{n}"], carry[n] = F.last(v, ignorenulls=True).over(after), F.last(tail, ignorenulls=True).over(later)
            tails.append(F.min_by(v, F.when(v.isNotNull(), at)).alias(f"_t_{n}"))
            final[n] = F.coalesce(mine, came)
        else:
            local[f"_l_{n}"] = F.last(v, ignorenulls=True).over(upto if n in lasts else before)
            carry[n] = F.last(tail, ignorenulls=True).over(earlier)
            tails.append(F.max_by(v, F.when(v.isNotNull(), at)).alias(f"_t_{n}"))
            final[n] = F.coalesce(mine, came)
    ends = (base.withColumns(local) if starts else base).groupBy(*group).agg(*tails)
    if starts:
        # a run open at the end of a chunk began at the first start since the last chunk with a break
        ends = ends.withColumns({f"_g_{n}": F.count(F.when(F.col(f"_brk_{n}"), 1)).over(by_chunk) for n in starts})
        ends = ends.withColumns({f"_o_{n}": F.first(f"_t_{n}", ignorenulls=True).over(
            W.partitionBy(*keys, f"_g_{n}").orderBy("_ck").rowsBetween(W.unboundedPreceding, 0)) for n in starts})
        carry |= {n: F.lag(f"_o_{n}").over(by_chunk) for n in starts}
    carried = ends.select(*[F.col(k).alias(f"_k_{k}") for k in group], *[carry[n].alias(f"_c_{n}") for n in names])
    cond = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_k_{k}") for k in group])
    out = base.withColumns(local).join(carried, cond, "left")
    keep = [c for c in df.columns if c not in final]
    return out.select(*keep, *[final[n].alias(n) for n in names])


def numbered(df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str], name: str) -> DataFrame:
    """row_number over the whole key: the count inside the chunk plus the rows of earlier chunks."""
    return running(df, keys, chunk, order, sums={name: F.lit(1).cast("bigint")})


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_t: str, right_t: str,
              values: Sequence[str], bucket: float, max_stale: float | None = None,
              tie: Sequence[str] = ()) -> DataFrame:
    """Left rows with the values of the latest right row at or before them (NULL when there is
    none, or when it is older than `max_stale`). Both sides are cut into time buckets."""
    keep = [c for c in left.columns if c not in by]
    lrow = left.select(*by, F.col(left_t).cast("double").alias("_t"), F.lit(1).alias("_side"),
                       F.struct(*keep).alias("_left"))
    pay = F.struct(F.col(right_t).cast("double").alias("_rt"), *[F.col(v).alias(f"_r{i}") for i, v in enumerate(values)])
    rank = F.struct(*[F.col(c) for c in tie]) if tie else F.struct(F.lit(0).alias("z"))
    rrow = right.filter(F.col(right_t).isNotNull()).select(
        *by, F.col(right_t).cast("double").alias("_t"), F.lit(0).alias("_side"), pay.alias("_right"), rank.alias("_tie"))
    both = lrow.unionByName(rrow, allowMissingColumns=True)
    order = ["_t", "_side", "_tie"]
    if max_stale is not None:
        span = F.when(F.col("_side") == 0, F.lit(float(max_stale))).otherwise(F.lit(0.0))
        both = both.withColumn("_chunk", F.explode(F.sequence(chunk_of("_t", bucket),
                                                              chunk_of(F.col("_t") + span, bucket))))
        spec = in_chunk(by, order).rowsBetween(W.unboundedPreceding, 0)
        both = both.withColumn("_hit", F.last("_right", ignorenulls=True).over(spec)).filter("_side = 1")
        fresh = (F.col("_t") - F.col("_hit._rt")) <= F.lit(float(max_stale))
        both = both.withColumn("_hit", F.when(fresh, F.col("_hit")))
    else:
        both = running(both, by, chunk_of("_t", bucket), order, lasts={"_hit": F.col("_right")}).filter("_side = 1")
    taken = [F.col(f"_hit._r{i}").alias(v) for i, v in enumerate(values)]
    return both.select(*by, *[F.col(f"_left.{c}").alias(c) for c in keep if c not in values], *taken)


def interval_join(points: DataFrame, spans: DataFrame, on: Sequence[str], t: str, lo: str, hi: str,
                  bucket: float, how: str = "inner", extra: Column | None = None,
                  closed: bool = True) -> DataFrame:
    """Points joined to the spans holding them. The spans are listed in every time bucket they
    touch, so the join stays an equi-join on (keys, bucket) with the exact test as residual."""
    p = points.withColumn("_bk", chunk_of(t, bucket))
    s = spans.withColumn("_bk", F.explode(F.sequence(chunk_of(lo, bucket), chunk_of(hi, bucket))))
    s = reduce(lambda d, k: d.withColumnRenamed(k, f"_s_{k}"), [*on, "_bk"], s)
    cond = reduce(lambda a, b: a & b, [p[k] == s[f"_s_{k}"] for k in [*on, "_bk"]])
    cond &= (p[t] >= s[lo]) & ((p[t] <= s[hi]) if closed else (p[t] < s[hi]))
    if extra is not None:
        cond &= extra
    out = p.join(s, cond, how)
    return out.drop("_bk", *[f"_s_{k}" for k in [*on, "_bk"]])


def gap_islands(df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str], gap: float,
                name: str = "island", closed: bool = True) -> DataFrame:
    """Numbers the islands of each key: a new one starts after a gap of more than `gap`
    (`closed=False`: of `gap` or more)."""
    t = order[0]
    df = running(df, keys, chunk, order, lasts_before={"_prev_t": F.col(t)})
    wide = (F.col(t) - F.col("_prev_t") > gap) if closed else (F.col(t) - F.col("_prev_t") >= gap)
    new = F.when(F.col("_prev_t").isNull() | wide, 1).otherwise(0)
    return running(df, keys, chunk, order, sums={name: new.cast("bigint")}).drop("_prev_t")


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Adds the columns of a one-row table (a total) to every row, by a join on a constant key."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one")
