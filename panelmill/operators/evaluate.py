"""Forecast metrics on the long prediction table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .distributed import attach_stats, null_safe
from .folds import HORIZONS

# Weight of each horizon in the weighted MAE.
HORIZON_WEIGHTS = {1: 0.5, 2: 0.3, 4: 0.2}


def metric_columns(actual: str = "actual", predicted: str = "predicted") -> dict[str, Column]:
    """MAE, RMSE, MSE, MAPE, R², bias and n as one hash aggregation."""
    y, p = F.col(actual), F.col(predicted)
    e = y - p
    ss_tot = F.regr_syy(y, y)
    return {
        "mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e)), "mse": F.avg(e * e),
        "mape": F.avg(F.abs(e / F.when(y + F.lit(1e-10) != 0, y + F.lit(1e-10)))) * 100,
        "r2": F.when(ss_tot == 0, F.lit(0.0)).otherwise(1 - F.sum(e * e) / F.nullif(ss_tot, F.lit(0.0))),
        "bias": F.avg(p - y), "n": F.count(F.lit(1))}


def forecast_metrics(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    done = preds.where(F.col("actual").isNotNull() & F.col("predicted").isNotNull())
    return done.groupBy(*by).agg(*[c.alias(n) for n, c in metric_columns().items()])


def metrics_by_horizon(preds: DataFrame, horizons: Sequence[int] = HORIZONS, by: Sequence[str] = ()) -> DataFrame:
    """Metrics per horizon; a horizon without rows gives zeros."""
    found = forecast_metrics(preds, [*by, "horizon"])
    groups = preds.select(*by).distinct() if by else preds.sparkSession.range(1).select()
    grid = groups.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    out = null_safe(grid, found.withColumn("horizon", F.col("horizon").cast("int")), [*by, "horizon"], "left")
    measured = [c for c in out.columns if c not in (*by, "horizon")]   # keys are left as they are, null ones too
    return out.na.fill(0, measured)


def stability(preds: DataFrame, by: Sequence[str] = (), fold: str = "fold_id") -> DataFrame:
    """Spread of the fold MAEs (population std)."""
    per = forecast_metrics(preds, [*by, fold])
    return per.groupBy(*by).agg(
        F.avg("mae").alias("error_mean"), F.stddev_pop("mae").alias("error_std"), F.min("mae").alias("error_min"),
        F.max("mae").alias("error_max"), (F.max("mae") - F.min("mae")).alias("error_range"),
        (1 / (1 + F.stddev_pop("mae"))).alias("stability_score"), F.max("mae").alias("worst_fold_error"),
        F.count(F.lit(1)).alias("n_folds"))


def horizon_weight(weights: Mapping[int, float], col: str = "horizon") -> Column:
    out = F.lit(0.0)
    for h, w in weights.items():
        out = F.when(F.col(col) == h, F.lit(float(w))).otherwise(out)
    return out


def weighted_mae(horizon_metrics: DataFrame, weights: Mapping[int, float] = HORIZON_WEIGHTS, by: Sequence[str] = ()) -> DataFrame:
    return horizon_metrics.groupBy(*by).agg(F.sum(horizon_weight(weights) * F.col("mae")).alias("weighted_mae"))


def evaluation_summary(preds: DataFrame, by: Sequence[str], weights: Mapping[int, float] = HORIZON_WEIGHTS,
                       horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """One wide row per model: weighted MAE, stability, and metrics per horizon."""
    per = metrics_by_horizon(preds, horizons, by)
    wide = per.groupBy(*by).agg(
        F.sum(horizon_weight(weights) * F.col("mae")).alias("weighted_mae"),
        *[F.max(F.when(F.col("horizon") == h, F.col(m))).alias(f"{m}_h{h}") for h in horizons for m in ("mae", "rmse", "mape", "r2")])
    stab = stability(preds, by).select(*by, "stability_score", "error_std", "worst_fold_error")
    return null_safe(wide, stab, list(by))


def compare_models(summary: DataFrame) -> DataFrame:
    return summary.orderBy("weighted_mae", *[c for c in summary.columns if c in ("model", "fs_option")])


def pivot_model_by_option(summary: DataFrame, options: Sequence[str], value: str = "weighted_mae", model: str = "model", option: str = "fs_option") -> DataFrame:
    return summary.groupBy(model).pivot(option, list(options)).agg(F.first(value, True))


def best_per_group(df: DataFrame, by: Sequence[str], score: str, tie: Sequence[str] = (), largest: bool = False) -> DataFrame:
    """The whole best row of each group; ties by name. An aggregation, no sort."""
    key = -F.col(score) if largest else F.col(score)
    pick = df.where(F.col(score).isNotNull()).groupBy(*by).agg(
        F.min(F.struct(key.alias("__k"), *[F.col(t).alias(f"__t_{t}") for t in tie],
                       *[F.col(c) for c in df.columns if c not in by])).alias("s"))
    return pick.select(*by, *[F.col("s")[c].alias(c) for c in df.columns if c not in by])


def option_summary(summary: DataFrame, by: str = "fs_option", value: str = "weighted_mae", extra: Sequence[str] = ("n_features",)) -> DataFrame:
    have = [e for e in extra if e in summary.columns]
    return summary.groupBy(by).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"),
        F.count(F.lit(1)).alias("n_models"), *[F.first(e, True).alias(e) for e in have])


def predictions_by_date(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    out = preds.groupBy(*by, "period").agg(F.avg("actual").alias("actual"), F.avg("predicted").alias("predicted"))
    return out.withColumn("residual", F.col("actual") - F.col("predicted"))


def minmax_normalise(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), costs: Sequence[str] = (), suffix: str = "_norm") -> DataFrame:
    """0–1 per criterion (1 = best), 0.5 where all are equal."""
    stats = {}
    for c in cols:
        stats[f"__lo_{c}"], stats[f"__hi_{c}"] = F.min(c).cast("double"), F.max(c).cast("double")
    out = attach_stats(df, stats, by)
    norm = []
    for c in cols:
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        z = (F.col(c) - lo) / F.nullif(hi - lo, F.lit(0.0))
        norm.append(F.coalesce((1 - z) if c in costs else z, F.when(F.col(c).isNotNull(), F.lit(0.5))).alias(c + suffix))
    return out.select(*df.columns, *norm)


def top_n(df: DataFrame, n: int, score: str, by: Sequence[str] = (), tie: Sequence[str] = (), largest: bool = True) -> DataFrame:
    """The n best rows, overall or per group.

    Per group Spark cuts each input partition to n rows before the shuffle
    (WindowGroupLimit, n up to 1,000), so a group that holds most of the table
    does not reach one task.
    """
    order = [F.desc_nulls_last(score) if largest else F.asc_nulls_last(score), *tie]
    if not by:
        return df.orderBy(*order).limit(n)
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def merge_metrics(quarterly: DataFrame, annual: DataFrame, on: Sequence[str] = ("fs_option", "model")) -> DataFrame:
    """Quarterly metrics left-joined to annual ones; clashing names get suffixes."""
    clash = [c for c in annual.columns if c in quarterly.columns and c not in on]
    left = quarterly.select(*[F.col(c).alias(f"{c}_quarterly") if c in clash else F.col(c) for c in quarterly.columns])
    right = annual.select(*[F.col(c).alias(f"{c}_annual") if c in clash else F.col(c) for c in annual.columns])
    return null_safe(left, right, list(on), "left").withColumn("model_id", F.concat_ws("/", *on))
