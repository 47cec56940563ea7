"""The anomaly score: an isolation forest on normal racing rows (Liu, Ting and Zhou, 2008).

Each tree sees 512 rows, so growing it is a small task; the trees grow side by side. The finished
forest has a fixed size (trees x nodes) and is broadcast to score any number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trackguard.functions.stats import exact_quantile_per, exact_quantiles, exact_quantiles_of
from trackguard.operators.folds import other_races, races_of, scored_by_fold
from trackguard.session import stored
from trackguard.sources.readers import assert_no_holdout

# fixed values: the score's input columns
FEATURES = ["rel_ratio", "rel_ratio_min_2s", "lap_ratio", "lap_ratio_min_2s", "dspeed_1s", "dspeed_min_2s",
            "lat_abs_max_2s", "lat_off_std_2s", "throttle_std_2s", "brake_throttle_2s", "heading_err"]
KEY = ["race", "drv", "tick"]
TREES, ROWS_PER_TREE = 200, 512
QUANTILES = (0.999, 0.9995, 0.9999, 0.99995, 0.99999)
THRESHOLD_Q = 0.99995


def with_inputs(df: DataFrame) -> DataFrame:
    """Score inputs present; a car that hardly moved has no direction, so its heading error is 0."""
    heading = F.col("heading_err") if "heading_err" in df.columns else F.lit(None).cast("double")
    return df.withColumn("heading_err", F.coalesce(heading, F.lit(0.0)))


def is_normal(df: DataFrame, crawl: float = 0.1) -> Column:
    """Green racing rows with every input known, while less than `crawl` of the field crawls."""
    ok = ((F.col("track_status") == "1") & ~F.col("in_pit") & ~F.col("suspended") & (F.col("field_slow") < crawl)
          & (F.col("speed") > 60))
    for c in FEATURES[:-1]:
        ok = ok & F.col(c).isNotNull()
    return ok & F.col("x").isNotNull() if "x" in df.columns else ok


def normal_rows(df: DataFrame, crawl: float = 0.1) -> DataFrame:
    """All normal rows: medians and alert thresholds are taken over them, and the trees draw from them."""
    return with_inputs(df).filter(is_normal(df, crawl)).select("race", "drv", "tick", *FEATURES)


def tree_rows(rows: DataFrame, n: int, trees: int, per_tree: int, seed: int) -> DataFrame:
    """(tree, _r, ...): `per_tree` of the n rows for each tree (all, if there are fewer). A row draws by hash, a
    share a little above the need, and a tree keeps the first of its rows in hash order, so what is ranked does
    not grow with the data. With many rows one draw gives a row its tree, or none; with few, a row may be in
    several trees and draws for each."""
    share, big = min(1.0, (per_tree + 10 * math.sqrt(per_tree)) / max(n, 1)), float(1 << 40)
    if share * trees <= 1:
        one = F.pmod(F.xxhash64("race", "drv", "tick", F.lit(seed)), F.lit(1 << 40))
        rows = rows.withColumn("tree", F.floor(one / (share * big)).cast("int")).filter(F.col("tree") < trees)
    else:
        drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64("race", "drv", "tick", t, F.lit(seed)), F.lit(1 << 40)) < share * big)
        rows = rows.withColumn("tree", F.explode(drawn))
    order = W.partitionBy("tree").orderBy(F.xxhash64("race", "drv", "tick", "tree", F.lit(seed)), "race", "drv", "tick")
    return rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= per_tree)


def medians(df: DataFrame) -> dict[str, float]:
    """Of every input; an input without any value counts as 0."""
    return {c: 0.0 if v[0] is None else v[0] for c, v in exact_quantiles_of(df, FEATURES, [0.5]).items()}


def path_norm(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def grow_tree(x: np.ndarray, seed: int, limit: int) -> list[tuple[int, int, float, float]]:
    """Nodes (place, feature, cut, path) of one tree; place i has children 2i+1 and 2i+2, leaves feature -1."""
    rng, nodes, todo = np.random.default_rng(seed), [], [(0, np.arange(len(x)), 0)]
    while todo:
        place, rows, depth = todo.pop()
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            nodes.append((place, -1, 0.0, depth + path_norm(len(rows))))
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(lo[f], hi[f]))
        cut = cut if cut < hi[f] else float(lo[f])     # neighbouring doubles: the draw may round up to hi, and nothing would go right
        left = x[rows, f] <= cut
        nodes.append((place, f, cut, 0.0))
        todo += [(2 * place + 1, rows[left], depth + 1), (2 * place + 2, rows[~left], depth + 1)]
    return nodes


@dataclass
class Forest:
    """The trees as arrays (tree, place), what fills missing inputs, and the alert thresholds."""

    feature: np.ndarray
    cut: np.ndarray
    path: np.ndarray
    rows: int
    fill: dict[str, float]
    quantiles: dict[float, float]

    def threshold(self, q: float = THRESHOLD_Q) -> float:
        return self.quantiles[q]


def forest_score(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, path: np.ndarray, rows: int) -> np.ndarray:
    """Score of each row: all rows walk down one tree after the other."""
    total, who = np.zeros(len(x)), np.arange(len(x))
    for t in range(len(feature)):
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            f = feature[t, at]
            inner = f >= 0
            if not inner.any():
                break
            down = 2 * at + 1 + (x[who, np.maximum(f, 0)] > cut[t, at])
            at = np.where(inner, down, at)
        total += path[t, at]
    return 2.0 ** (-total / len(feature) / path_norm(rows))


def train(normal: DataFrame, trees: int = TREES, per_tree: int = ROWS_PER_TREE, seed: int = 0,
          quantiles: tuple[float, ...] = QUANTILES) -> Forest:
    """Grows the forest. `per_tree` rows a tree is the published algorithm; everything else sees all rows.
    Holdout races are refused."""
    normal = assert_no_holdout(stored(normal))
    n = normal.count()
    if not n:
        raise ValueError("no normal rows to learn from")
    fill = medians(normal)
    limit = max(1, math.ceil(math.log2(max(2, min(per_tree, n)))))
    rows = tree_rows(normal.fillna(fill), n, trees, per_tree, seed).select("tree", "_r", *FEATURES)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values("_r")[FEATURES].to_numpy(float)
        nodes = pd.DataFrame(grow_tree(x, seed * 1_000_003 + tree, limit), columns=["place", "feature", "cut", "path"])
        return nodes.assign(tree=tree, n=len(x))[["tree", "place", "feature", "cut", "path", "n"]]

    nodes = rows.groupBy("tree").applyInPandas(grow, "tree int, place int, feature int, cut double, path double, n int").toPandas()
    size = 2 ** (limit + 1) - 1                        # trees x size nodes, whatever the data
    shape = (trees, size)
    feature, cut, path = np.full(shape, -1, dtype=np.int16), np.zeros(shape), np.zeros(shape)
    at = (nodes["tree"].to_numpy(), nodes["place"].to_numpy())
    feature[at], cut[at], path[at] = nodes["feature"], nodes["cut"], nodes["path"]
    forest = Forest(feature, cut, path, int(nodes["n"].max()), fill, {})
    scored = stored(attach_scores(normal, forest).select("anomaly_score"))
    forest.quantiles = dict(zip(quantiles, exact_quantiles(scored, "anomaly_score", quantiles)))
    return forest


def attach_scores(df: DataFrame, forest: Forest) -> DataFrame:
    """Adds anomaly_score (higher is stranger). A row's inputs only look back, so the score is causal."""
    # plain arrays: what is broadcast must load on executors that do not have this package
    model = df.sparkSession.sparkContext.broadcast((forest.feature, forest.cut, forest.path, forest.rows))

    @F.pandas_udf("double")
    def strange(cols: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        f = model.value
        for pdf in cols:
            yield pd.Series(forest_score(pdf.to_numpy(float), *f))

    df = with_inputs(df)
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(float(forest.fill[c]))).alias(c) for c in FEATURES]
    return df.withColumn("anomaly_score", strange(F.struct(*filled)))


def leave_one_race_out(df: DataFrame, crawl: float = 0.1, trees: int = TREES, per_tree: int = ROWS_PER_TREE, seed: int = 0, q: float = max(QUANTILES)) -> DataFrame:
    """Every race scored by a forest grown on the other races; adds anomaly_score and the threshold of that forest (its quantile q over the
    other races' normal rows). The trees of all forests grow side by side, keyed by (fold, tree). Holdout races are refused."""
    normal = assert_no_holdout(stored(normal_rows(df, crawl=crawl)))
    folds = other_races(races_of(df))
    each = normal.withColumn("fold", F.explode(folds))
    sizes = each.groupBy("fold").agg(F.count("*").alias("n"), *[F.percentile_approx(c, 0.5, 10_000).alias(f"fill_{c}") for c in FEATURES])
    sizes = stored(sizes)                               # one row per race
    least = sizes.agg(F.min("n")).first()[0]
    if not least:
        raise ValueError("no normal rows to learn from")
    limit = max(1, math.ceil(math.log2(max(2, min(per_tree, least)))))
    share = F.least(F.lit(1.0), F.lit(per_tree + 10 * math.sqrt(per_tree)) / F.col("n"))
    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64("race", "drv", "tick", "fold", t, F.lit(seed)), F.lit(1 << 40)) < share * float(1 << 40))
    rows = each.join(F.broadcast(sizes.select("fold", "n")), "fold").withColumn("tree", F.explode(drawn))
    order = W.partitionBy("fold", "tree").orderBy(F.xxhash64("race", "drv", "tick", "fold", "tree", F.lit(seed)), "race", "drv", "tick")
    rows = rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= per_tree).select("fold", "tree", "_r", *FEATURES)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values("_r")[FEATURES].to_numpy(float)
        nodes = grow_tree(x, seed * 1_000_003 + tree, limit)
        return pd.DataFrame({"fold": [pdf["fold"].iloc[0]], "tree": [tree], "n": [len(x)], "nodes": [np.array(nodes, float).tobytes()]})
    grown = rows.repartition(min(trees, 200), "fold", "tree").groupBy("fold", "tree").applyInPandas(grow, "fold string, tree int, n int, nodes binary")
    forests = stored(grown.groupBy("fold").agg(F.collect_list(F.struct("tree", "n", "nodes")).alias("trees")).join(sizes.drop("n"), "fold"))    # trees x nodes a fold

    def score(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = pdf[["fold", *KEY]].copy()
        out["anomaly_score"] = np.nan
        for m in own.itertuples():
            shape = (trees, 2 ** (limit + 1) - 1)
            feature, cut, path = np.full(shape, -1, np.int16), np.zeros(shape), np.zeros(shape)
            for t in m.trees:
                place, f, c, p = np.frombuffer(t["nodes"]).reshape(-1, 4).T
                feature[t["tree"], place.astype(int)], cut[t["tree"], place.astype(int)], path[t["tree"], place.astype(int)] = f, c, p
            x = pdf[FEATURES].fillna({c: getattr(m, f"fill_{c}") for c in FEATURES}).to_numpy(float)
            out["anomaly_score"] = forest_score(x, feature, cut, path, max(t["n"] for t in m.trees))
        return out
    schema = "fold string, race string, drv string, tick int, anomaly_score double"
    wanted = [*KEY, *[F.col(c).cast("double").alias(c) for c in FEATURES]]
    own = scored_by_fold(with_inputs(df).select(F.col("race").alias("fold"), *wanted), forests, KEY, score, schema).drop("fold")
    learnt = stored(scored_by_fold(each.select("fold", *wanted), forests, KEY, score, schema).select("fold", "anomaly_score"))
    limits = list(exact_quantile_per(learnt, "fold", "anomaly_score", q).items())
    limits = df.sparkSession.createDataFrame(limits, "race string, threshold double")
    return with_inputs(df).drop("anomaly_score").join(own, KEY, "left").join(F.broadcast(limits), "race", "left")
