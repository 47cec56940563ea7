"""Forecast of each car's risk: labels, features, boosted trees, and how good the forecast is."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from trackguard.functions.stats import average_precision, exact_quantiles
from trackguard.functions.timeline import beside, chunk_of, interval_join, running
from trackguard.operators import boosting
from trackguard.operators.boosting import Growth, Trees
from trackguard.operators.folds import other_races, races_of, scored_by_fold
from trackguard.sources.readers import assert_no_holdout
from trackguard.session import stored
from trackguard.operators.incidents import MATCH_AFTER_S, MATCH_BEFORE_S, in_sectors, match_incidents

CAR = ["race", "drv"]
HORIZONS = (10, 20, 30)
AMBIGUOUS_S, NEG_PER_MILLE, EARLY_S, EPISODE_GAP_S = 30.0, 30, 3.0, 5.0
ALERT_NEG_RATES = (0.005, 0.002, 0.001)
TICK_S = 0.25
# fixed values: the model's input columns
NUMERIC = [
    "rel_ratio", "rel_ratio_min_2s", "rel_ratio_min_5s", "lap_ratio", "lap_ratio_min_2s", "lap_ratio_mean_5s",
    "lap_ratio_min_5s", "last_lap_delta", "speed", "ref_speed",
    "dspeed_1s", "dspeed_min_2s", "dspeed_min_5s", "lat_off_abs", "lat_abs_max_2s", "lat_off_std_2s",
    "lat_off_std_5s", "heading_err", "heading_max_5s", "throttle", "throttle_std_2s", "throttle_std_5s",
    "brake_throttle_2s", "brake_throttle_5s",
    "gap_ahead_s", "gap_behind_s", "closing_rate", "closing_rate_max_5s", "cars_within_1s",
    "tyre_life", "laps_since_pit", "drv_lap", "is_lap1", "t_since_restart", "track_temp", "air_temp",
    "rainfall", "field_ratio", "anomaly_score",
]
# fixed values: tyre codes
COMPOUNDS = {"SOFT": 0, "MEDIUM": 1, "HARD": 2, "INTERMEDIATE": 3, "WET": 4}
OUTSIDE, CODED = {"track_temp", "air_temp"}, ["compound_code", "status_code"]


def input_names(anomaly: bool = True) -> list[str]:
    """The model's inputs in a fixed order: the numbers but for the air and track temperature, then the codes."""
    left_out = OUTSIDE if anomaly else OUTSIDE | {"anomaly_score"}
    return [*(c for c in NUMERIC if c not in left_out), *CODED]


ACTIVE, WITHOUT_ANOMALY = input_names(), input_names(anomaly=False)
KEY = [*CAR, "tick"]


def is_racing(df: DataFrame) -> Column:
    """Rows a forecast makes sense for: live, on track, race running, not on the grid."""
    ok = F.col("speed").isNotNull() & ~F.col("in_pit") & ~F.col("suspended") & (F.col("field_slow") < 0.5)
    return ok & F.col("x").isNotNull() if "x" in df.columns else ok


def model_inputs(df: DataFrame) -> dict[str, Column]:
    """The model's inputs by name; what the data lacks is NULL."""
    have = set(df.columns)
    code = F.coalesce(*[F.when(F.col("compound") == k, F.lit(float(v))) for k, v in COMPOUNDS.items()], F.lit(-1.0)) if "compound" in have else F.lit(-1.0)
    return {**{c: (F.col(c) if c in have else F.lit(None)).cast("double") for c in NUMERIC},
            "compound_code": code, "status_code": F.coalesce(F.expr("try_cast(track_status AS double)"), F.lit(1.0))}


def feature_matrix(df: DataFrame) -> DataFrame:
    """Adds the model's inputs."""
    return df.withColumns(model_inputs(df))


def with_inputs(df: DataFrame, features: list[str]) -> DataFrame:
    """Adds the inputs as columns `in_...` of their own, NULL where unknown; the caller's columns stay as they are."""
    given = model_inputs(df)
    return df.withColumns({f"in_{c}": given[c] for c in features})


# ---- labels

def incident_times(incidents: DataFrame, dets: DataFrame, n: int, before: float = MATCH_BEFORE_S,
                   after: float = MATCH_AFTER_S) -> tuple[DataFrame, DataFrame]:
    """((race, drv, t_inc): each car's first crash detection that matches an incident, incidents without one)."""
    crash = dets.filter(F.col("type").isin("IMPACT", "STOPPED", "SPIN")).select(
        "race", F.get("drivers", F.lit(0)).alias("drv"), F.col("t").alias("t_hit"), F.col("msector").alias("hit_sector"))
    hits = match_incidents(incidents.select("race", "incident", "t", "sectors"), crash, n, before, after)
    first = hits.groupBy(*CAR).agg(F.min("t_hit").alias("t_inc"))
    alone = incidents.join(hits.select("race", "incident").distinct(), ["race", "incident"], "left_anti")
    return first, alone


def label(df: DataFrame, first: DataFrame, unattributed: DataFrame, n: int, horizons: tuple[int, ...] = HORIZONS,
          ambiguous_s: float = AMBIGUOUS_S) -> DataFrame:
    """Racing rows with y10, y20, y30: the car's incident comes within so many seconds. A car's rows
    from its incident on are dropped, and so are rows that an unattributed incident may be about."""
    rows = df.filter(is_racing(df)).join(first, CAR, "left").filter("t_inc is null or t < t_inc")
    spans = unattributed.select("race", F.col("t").alias("hi"), (F.col("t") - ambiguous_s).alias("lo"), "sectors")
    rows = interval_join(rows, spans, ["race"], "t", "lo", "hi", 64.0, how="left_anti",
                         extra=in_sectors(F.col("msector"), F.col("sectors"), n))
    near = {f"y{h}": F.when(F.col("t") >= F.col("t_inc") - h, 1).otherwise(0) for h in horizons}
    return rows.withColumns({k: F.when(F.col("t_inc").isNull(), 0).otherwise(c) for k, c in near.items()})


def train_keep(df: DataFrame, per_mille: int = NEG_PER_MILLE) -> DataFrame:
    """Adds train_keep: every positive and 3% of the negatives, by a hash of the row's key."""
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", "race", "drv", F.col("tick").cast("string"))), 1, 7), 16, 10).cast("bigint")
    return df.withColumn("train_keep", (F.col("y30") == 1) | (digest % 1000 < per_mille))


# ---- the model

@dataclass
class RiskModel:
    """The trees, and the share of the negatives they were trained on."""

    trees: Trees
    neg_share: float


def _kept_share(rows: DataFrame, y: str) -> Column:
    """The share of the negatives that are kept for training; 1 without negatives."""
    return F.coalesce(F.avg(F.when(F.col(y) == 0, F.col("train_keep").cast("double"))), F.lit(1.0))


def _key(df: DataFrame) -> list[str]:
    return [c for c in KEY if c in df.columns]


def fit(train: DataFrame, horizon: int, features: list[str] = ACTIVE, iterations: int = 300, min_rows: int = 100, seed: int = 0) -> RiskModel:
    """Boosted trees on all kept rows. The share of negatives kept is measured here, so that the
    correction cannot disagree with the training. Holdout races are refused."""
    return fit_horizons(train, (horizon,), features, iterations, min_rows, seed)[0]


def fit_horizons(train: DataFrame, horizons: tuple[int, ...], features: list[str] = ACTIVE, iterations: int = 300, min_rows: int = 100,
                 seed: int = 0) -> list[RiskModel]:
    """A model per horizon, from the same rows and side by side in one job."""
    if "race" in train.columns:
        assert_no_holdout(train)
    shares = train.agg(*[_kept_share(train, f"y{h}") for h in horizons]).first()
    rows = with_inputs(train.filter("train_keep"), features)
    rows = rows.withColumn("_m", F.explode(F.array(*[F.struct(F.lit(i).alias("_model"), F.col(f"y{h}").alias("_y")) for i, h in enumerate(horizons)])))
    rows = rows.select(*_key(train), *[f"in_{c}" for c in features], "_m.*")
    made = boosting.fit_each(rows, ["_model"], "_y", [f"in_{c}" for c in features], _key(train), Growth(iterations, min_rows=min_rows, seed=seed), len(horizons))
    found = {r["_model"]: Trees.unpacked(r["trees"]) for r in made.collect()}
    empty = Trees(0.0, np.zeros(0, boosting.NODE), np.zeros(1, np.int64))
    return [RiskModel(found.get(i, empty), share) for i, share in enumerate(shares)]


def correct(p: Column, neg_share: float) -> Column:
    """Undoes the downsampling of negatives: true odds are the model's odds times the share kept."""
    odds = p / F.greatest(1 - p, F.lit(1e-9)) * neg_share
    return odds / (1 + odds)


def predict(df: DataFrame, model: RiskModel, name: str, features: list[str] = ACTIVE) -> DataFrame:
    """Adds the corrected probability as `name`."""
    sent = df.sparkSession.sparkContext.broadcast(model.trees.packed())

    @F.pandas_udf("double")
    def likely(cols: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        trees = Trees.unpacked(sent.value)
        for pdf in cols:
            yield pd.Series(boosting.probability(boosting.margin(pdf.to_numpy(float), trees)))
    packed = F.struct(*[F.col(f"in_{c}") for c in features])
    return with_inputs(df, features).withColumn(name, correct(likely(packed), model.neg_share)).select(*[c for c in df.columns if c != name], name)


def forecast(df: DataFrame, model10: RiskModel, model30: RiskModel, features: list[str] = ACTIVE, top_k: int = 2) -> DataFrame:
    """One forecast per racing car and whole second: risk_10s, risk_30s and the features that raise the
    latter most. Rows between whole seconds are dropped before any model runs."""
    due = df.filter((F.col("tick") % 4 == 0) & is_racing(df))
    rows = predict(predict(due, model10, "_p10", features), model30, "_p30", features)
    rows = top_features(rows, model30, features, top_k)
    return rows.select(*CAR, "tick", "t", F.round("_p10", 4).alias("risk_10s"), F.round(F.greatest("_p30", "_p10"), 4).alias("risk_30s"), "top_features")


def top_features(df: DataFrame, model: RiskModel, features: list[str] = ACTIVE, top_k: int = 2) -> DataFrame:
    """Adds top_features: the inputs with the largest positive contributions (Shapley values) to a row's score."""
    sent = df.sparkSession.sparkContext.broadcast(model.trees.packed())
    names = list(features)

    @F.pandas_udf("array<string>")
    def strongest(cols: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        trees = Trees.unpacked(sent.value)
        for pdf in cols:
            push = boosting.contributions(pdf.to_numpy(float), trees)
            best = np.argsort(-push, axis=1, kind="stable")[:, :top_k]
            yield pd.Series([[names[j] for j in row if push[i, j] > 0] for i, row in enumerate(best)])

    packed = F.struct(*[F.col(f"in_{c}") for c in names])
    return with_inputs(df, names).withColumn("top_features", strongest(packed)).select(*df.columns, "top_features")


def importance(model: RiskModel, df: DataFrame, features: list[str] = ACTIVE) -> DataFrame:
    """Normalised gain per input, highest first: one row per input."""
    gain = boosting.gains(model.trees, len(features))
    rows = sorted(zip(features, (gain / max(gain.sum(), 1e-12)).tolist()), key=lambda r: (-r[1], r[0]))
    return df.sparkSession.createDataFrame([(i + 1, f, g) for i, (f, g) in enumerate(rows)], "rank int, feature string, gain double")


def fold_models(rows: DataFrame, horizons: tuple[int, ...] = HORIZONS, iterations: int = 300, min_rows: int = 100, variants: dict[str, list[str]] | None = None) -> DataFrame:
    """(fold, h, variant, trees, neg_share): for every race, horizon and variant a model of the other races, all fitted in one job. rows is a
    stored table of labelled rows."""
    assert_no_holdout(rows)
    variants = variants or {"": ACTIVE, "_noanom": WITHOUT_ANOMALY}
    columns = list(dict.fromkeys(f for feats in variants.values() for f in feats))
    races = races_of(rows)
    folds = other_races(races)
    kept = with_inputs(rows.filter("train_keep"), columns)
    kinds = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(v).alias("variant")) for h in horizons for v in variants])
    label = F.coalesce(*[F.when(F.col("h") == h, F.col(f"y{h}")) for h in horizons])
    # an input that a variant does not use is missing in all its rows, so no tree can ask for it
    used = {f"in_{c}": F.when(F.col("variant").isin(*[v for v, feats in variants.items() if c in feats]), F.col(f"in_{c}")) for c in columns}
    each = kept.withColumn("fold", F.explode(folds)).withColumn("_k", F.explode(kinds)).select(*KEY, "fold", "_k.*", *[f"in_{c}" for c in columns], *[f"y{h}" for h in horizons])
    each = each.withColumns(used).withColumn("label", label.cast("double"))
    models = boosting.fit_each(each, ["fold", "h", "variant"], "label", [f"in_{c}" for c in columns], KEY, Growth(iterations, min_rows=min_rows), len(races) * len(horizons) * len(variants))
    parts = [F.struct(F.lit(h).alias("h"), F.sum((F.col(f"y{h}") == 0).cast("long")).alias("n"), F.sum(((F.col(f"y{h}") == 0) & F.col("train_keep")).cast("long")).alias("k")) for h in horizons]
    shares = rows.groupBy("race").agg(F.array(*parts).alias("_s")).withColumn("fold", F.explode(folds)).select("fold", F.explode("_s").alias("s"))
    shares = shares.groupBy("fold", "s.h").agg(F.coalesce(F.try_divide(F.sum("s.k"), F.sum("s.n")), F.lit(1.0)).alias("neg_share"))
    return models.join(shares, ["fold", "h"])


def cross_validate(rows: DataFrame, horizons: tuple[int, ...] = HORIZONS, iterations: int = 300, min_rows: int = 100, variants: dict[str, list[str]] | None = None) -> DataFrame:
    """Labelled rows with predictions p{h}, each race scored by models fitted on the other races. rows is a stored table. """
    variants = variants or {"": ACTIVE, "_noanom": WITHOUT_ANOMALY}
    columns = list(dict.fromkeys(f for feats in variants.values() for f in feats))
    models = stored(fold_models(rows, horizons, iterations, min_rows, variants))
    asked = with_inputs(rows, columns).select(*KEY, F.col("race").alias("fold"), *[f"in_{c}" for c in columns])
    names = [f"p{h}{v}" for h in horizons for v in variants]

    def score(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        x, out = pdf[[f"in_{c}" for c in columns]].to_numpy(float), pdf[KEY].copy()
        for name in names:
            out[name] = np.nan
        for m in own.itertuples():
            p = boosting.probability(boosting.margin(x, Trees.unpacked(m.trees)))
            odds = p / np.maximum(1 - p, 1e-9) * m.neg_share
            out[f"p{m.h}{m.variant}"] = odds / (1 + odds)
        return out
    schema = ", ".join([f"{k} {rows.schema[k].dataType.simpleString()}" for k in KEY] + [f"{n} double" for n in names])
    return rows.join(scored_by_fold(asked, models, KEY, score, schema), KEY)


# ---- how good it is

def with_incident_end(pred: DataFrame, y: str = "y30") -> DataFrame:
    """Adds t_end (the car's incident: one tick after its last positive row) and precursor (not in the
    last 3 s before it)."""
    ends = pred.filter(F.col(y) == 1).groupBy(*CAR).agg((F.max("t") + TICK_S).alias("t_end"))
    out = pred.join(ends, CAR, "left")
    last = (F.col("t") >= F.col("t_end") - EARLY_S) & (F.col("t") < F.col("t_end"))
    return out.withColumn("precursor", ~F.coalesce(last, F.lit(False)))


def score_table(pred: DataFrame, scores: dict[str, Column], y: str) -> DataFrame:
    """PR-AUC of every score column: pooled, precursor rows only, and the mean over races with positives."""
    pred = with_incident_end(pred)
    items = F.array(*[F.struct(F.lit(k).alias("model"), c.cast("double").alias("_s")) for k, c in scores.items()])
    long = pred.withColumn("_m", F.explode(items)).select("race", "precursor", y, "_m.*")
    pooled = average_precision(long, y, "_s", ["model"])
    pre = average_precision(long.filter("precursor"), y, "_s", ["model"]).select("model", F.col("pr_auc").alias("pr_auc_precursor"))
    each = average_precision(long, y, "_s", ["model", "race"]).filter("base_rate > 0")
    mean = each.groupBy("model").agg(F.avg("pr_auc").alias("pr_auc_mean_per_race"))
    return pooled.select("model", "pr_auc", "base_rate").join(pre, "model", "left").join(mean, "model", "left")


def racing_hours(pred: DataFrame, by: list[str] = []) -> DataFrame:
    """Racing time of the whole field: rows / 4 / 3600 / the mean number of cars per race."""
    per = pred.groupBy("race").agg(F.count(F.lit(1)).alias("_n"), F.countDistinct("drv").alias("_c"))
    return per.groupBy(*by).agg((F.sum("_n") / 4.0 / 3600.0 / F.avg("_c")).alias("hours"))


def thresholds(pred: DataFrame, col: str, rates: tuple[float, ...] = ALERT_NEG_RATES) -> list[float]:
    """Scores exceeded by the given shares of the rows without an incident ahead."""
    return exact_quantiles(pred.filter("y30 = 0"), col, [1 - r for r in rates])


def early_warning(pred: DataFrame, limits: list[float] | None, col: str = "p30", by: list[str] = []) -> DataFrame:
    """Per limit: car incidents, the share flagged 3 s or more before, the median seconds before, and
    false high-risk episodes per racing hour. Without limits the rows bring their own as `threshold`; `by` is
    nothing or the race."""
    pred = with_incident_end(pred)
    if limits is not None:
        pred = pred.withColumn("threshold", F.explode(F.array(*[F.lit(float(v)) for v in limits])))
    keys = [*by, "threshold"]
    over = F.col(col) >= F.col("threshold")
    cars = pred.filter("y30 = 1").groupBy("threshold", *CAR).agg(
        F.min(F.when(over & (F.col("t") <= F.col("t_end") - EARLY_S), F.col("t"))).alias("_t"), F.first("t_end").alias("t_end"))
    seen = cars.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("car_incidents"), F.avg(F.col("_t").isNotNull().cast("double")).alias("flagged_3s_before"),
        F.percentile(F.col("t_end") - F.col("_t"), 0.5).alias("median_s_before"))
    eps = episodes(pred.filter(over & (F.col("y30") == 0)), ["threshold", *CAR]).groupBy(*keys).agg(F.sum("new").alias("false_episodes"))
    hours = racing_hours(pred.drop("threshold").select(*CAR, "tick").distinct(), by)
    out = seen.join(eps, keys, "left").fillna(0, ["false_episodes"])
    out = out.join(hours, by) if by else beside(out, hours)
    return out.withColumn("false_episodes_per_hour", F.try_divide("false_episodes", "hours"))


def episodes(rows: DataFrame, keys: list[str], gap: float = EPISODE_GAP_S) -> DataFrame:
    """Adds new: 1 on the first row after more than `gap` seconds without one."""
    rows = running(rows, keys, chunk_of("t", 1024.0), ["t"], lasts_before={"_p": F.col("t")})
    return rows.withColumn("new", F.when(F.col("_p").isNull() | (F.col("t") - F.col("_p") > gap), 1).otherwise(0)).drop("_p")
