"""Exact statistics that never gather a whole column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from trackguard.functions.timeline import running
from trackguard.session import stored

SLOTS = 4096
SLICES = 256
SMALL = 100_000


def exact_quantiles_of(df: DataFrame, cols: Sequence[str], qs: Sequence[float]) -> dict[str, list[float]]:
    """Quantiles of every column, with linear interpolation between order statistics. Each round counts
    the values per slot of the range an order statistic lies in, for all of them in one pass, and goes
    on inside the slot that holds it; ranges of at most SMALL values are settled by sorting. A column without
    values has no quantiles: None."""
    df = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    first = df.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    empty, cols = [c for c in cols if not first[f"n_{c}"]], [c for c in cols if first[f"n_{c}"]]
    rank = {(c, q): (first[f"n_{c}"] - 1) * q for c in cols for q in qs}
    want = {}                                   # (column, k) -> [k inside the range, low, high]
    for (c, _), r in rank.items():
        for k in {int(r), min(int(r) + 1, first[f"n_{c}"] - 1)}:
            want[c, k] = [k, first[f"lo_{c}"], first[f"hi_{c}"], first[f"n_{c}"]]
    while True:
        wide = {t: w for t, w in want.items() if w[1] < w[2] and w[3] > SMALL}
        if not wide:
            break
        parts = []
        for i, ((c, _), (_, lo, hi, _)) in enumerate(wide.items()):
            slot = F.least(F.floor((F.col(c) - lo) / ((hi - lo) / SLOTS)), F.lit(SLOTS - 1))
            parts.append(F.when(F.col(c).between(lo, hi), F.struct(F.lit(i).alias("i"), slot.alias("s"), F.col(c).alias("v"))))
        hits = df.select(F.explode(F.array(*parts)).alias("h")).filter("h is not null").select("h.*")
        found = hits.groupBy("i", "s").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("z")).orderBy("i", "s")
        slots = found.collect()                  # at most SLOTS rows per order statistic
        for i, t in enumerate(wide):
            k = want[t][0]
            for row in (r for r in slots if r["i"] == i):
                if k < row["n"]:
                    want[t] = [k, row["a"], row["z"], row["n"]]
                    break
                k -= row["n"]
    last = {t: w for t, w in want.items() if w[1] < w[2]}
    values = {t: w[1] for t, w in want.items()}
    if last:
        inside = [F.sort_array(F.collect_list(F.when(F.col(c).between(lo, hi), F.col(c)))) for (c, _), (_, lo, hi, _) in last.items()]
        row = df.agg(*[F.get(a, F.lit(w[0])).alias(f"v{i}") for i, (a, w) in enumerate(zip(inside, last.values()))]).first()
        values |= {t: row[f"v{i}"] for i, t in enumerate(last)}
    out: dict[str, list[float | None]] = {c: [None] * len(qs) for c in empty}
    for c in cols:
        out[c] = []
        for q in qs:
            r = rank[c, q]
            a, z = values[c, int(r)], values[c, min(int(r) + 1, first[f"n_{c}"] - 1)]
            out[c].append(a + (z - a) * (r - int(r)))
    return out


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float]) -> list[float]:
    return exact_quantiles_of(df, [col], qs)[col]


def exact_quantile_per(df: DataFrame, key: str, col: str, q: float) -> dict[object, float]:
    """One quantile for every key, as exact_quantiles has it. The keys are few (they come to the driver); a key's rows may be many: every
    round counts them per slot of the range that holds the order statistic, for all keys in one pass."""
    df = df.select(F.col(key).alias("_k"), F.col(col).cast("double").alias("_v")).filter("_v is not null")
    want, share = {}, {}
    for r in df.groupBy("_k").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).collect():
        rank = (r["n"] - 1) * q
        share[r["_k"]] = rank - int(rank)
        for i, k in enumerate((int(rank), min(int(rank) + 1, r["n"] - 1))):
            want[r["_k"], i] = [k, r["lo"], r["hi"], r["n"]]
    schema = f"_k {df.schema['_k'].dataType.simpleString()}, _i int, _lo double, _hi double"
    while True:
        open_ = {t: w for t, w in want.items() if w[1] < w[2]}
        if not open_:
            break
        bounds = F.broadcast(df.sparkSession.createDataFrame([(k, i, w[1], w[2]) for (k, i), w in open_.items()], schema))
        # slots of a range so narrow that it has no middle are its two ends
        slot = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * SLOTS), F.lit(SLOTS - 1))
        found = df.join(bounds, "_k").filter("_v between _lo and _hi").groupBy("_k", "_i", slot.alias("_s")).agg(F.count("*").alias("n"), F.min("_v").alias("a"), F.max("_v").alias("z"))
        before = F.sum("n").over(W.partitionBy("_k", "_i").orderBy("_s").rowsBetween(W.unboundedPreceding, -1))
        found = found.withColumn("before", F.coalesce(before, F.lit(0)))
        target = F.broadcast(df.sparkSession.createDataFrame([(k, i, w[0]) for (k, i), w in open_.items()], f"{schema.split(', _lo')[0]}, _r long"))
        for r in found.join(target, ["_k", "_i"]).filter("_r >= before and _r < before + n").collect():
            want[r["_k"], r["_i"]] = [r["_r"] - r["before"], r["a"], r["z"], r["n"]]
    return {k: want[k, 0][1] + (want[k, 1][1] - want[k, 0][1]) * part for k, part in share.items()}


def average_precision(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the precision-recall steps, ties in score taken together: (by, pr_auc, base_rate, n).
    Rows are counted per score first; the running counts go slice by slice down the score range, whose slices
    hold about equally many different scores."""
    by = list(by)
    keys = by or ["_all"]
    df = df.filter(F.col(score).isNotNull()).withColumn("_all", F.lit(0))
    each = df.groupBy(*keys, (-F.col(score).cast("double")).alias("_s")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("bigint")).alias("_pos"))
    each = stored(each)
    bounds = each.agg(F.percentile_approx("_s", [k / SLICES for k in range(1, SLICES)], 10 * SLICES)).first()[0] or []
    slices = F.size(F.filter(F.array(*[F.lit(float(b)) for b in sorted(set(bounds))]), lambda b: b < F.col("_s"))) if bounds else F.lit(0)
    run = running(each, keys, slices, ["_s"], sums={"_cn": F.col("_n"), "_cp": F.col("_pos")})
    whole = each.groupBy(*keys).agg(F.sum("_pos").alias("_p"), F.sum("_n").alias("_all_n"))
    out = run.join(whole, keys).groupBy(*keys).agg(
        F.sum(F.try_divide("_pos", "_p") * F.col("_cp") / F.col("_cn")).alias("pr_auc"),
        F.first(F.col("_p") / F.col("_all_n")).alias("base_rate"), F.first("_all_n").alias("n"))
    return out if by else out.drop("_all")
