"""Do fine-grained forecasts add up to sound yearly totals?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .distributed import null_safe
from .evaluate import forecast_metrics
from .features import inverse_transform

BASELINES = ("naive", "mean", "linear")


def annualise_predictions(preds: DataFrame, by: Sequence[str] = (), transform: str = "log", dedupe: str = "mean_by_date",
                          unit: Sequence[str] = (), require_complete: int | None = None) -> DataFrame:
    """Back-transformed yearly totals per group.

    A period is tested once per horizon, so its predictions are first averaged
    (``dedupe='mean_by_date'``, per ``unit`` series); ``'none'`` adds every row.
    ``require_complete`` keeps years with that many periods.
    """
    rows = preds.where(F.col("actual").isNotNull() & F.col("predicted").isNotNull()).withColumn(
        "actual", inverse_transform(F.col("actual"), transform)).withColumn(
        "predicted", inverse_transform(F.col("predicted"), transform))
    if dedupe == "mean_by_date":
        rows = rows.groupBy(*by, *[u for u in unit if u not in by], "period").agg(
            F.avg("actual").alias("actual"), F.avg("predicted").alias("predicted"))
    elif dedupe != "none":
        raise ValueError("dedupe is mean_by_date or none")
    out = rows.groupBy(*by, F.year("period").alias("year")).agg(
        F.sum("actual").alias("actual_annual"), F.sum("predicted").alias("predicted_annual"),
        F.count_distinct("period").alias("n_periods"))
    if require_complete is not None:
        out = out.where(F.col("n_periods") >= require_complete)
    return out


def annual_consistency(annual: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    m = forecast_metrics(annual.withColumnsRenamed({"actual_annual": "actual", "predicted_annual": "predicted"}), by)
    means = annual.groupBy(*by).agg(F.avg("actual_annual").alias("__mean"))
    out = null_safe(m, means, list(by)) if by else m.withColumn("__mean", means.scalar())
    return out.select(
        *by, F.col("mae").alias("annual_mae"), F.col("mape").alias("annual_mape"), F.col("bias").alias("annual_bias"),
        (F.try_divide("bias", "__mean") * 100).alias("annual_bias_pct"), F.col("n").alias("n_years"),
        F.greatest(F.lit(0.0), 1 - F.col("mape") / 100).alias("consistency_score"))


def year_errors(annual: DataFrame) -> DataFrame:
    error = F.col("actual_annual") - F.col("predicted_annual")
    return annual.withColumn("error", error).withColumn("error_pct", F.try_divide(error, F.col("actual_annual")) * 100)


def annual_baselines(yearly: DataFrame, keys: Sequence[str] = (), methods: Sequence[str] = BASELINES) -> DataFrame:
    """Long ``(keys…, year, value, method, predicted)`` of simple yearly forecasts.

    naive: last year's value. mean: mean of the past. linear: least-squares line
    through the past, one step ahead. ar1: last value plus φ times the last
    change, φ by least squares on past changes. The first year repeats itself.
    Input is one row per key and year, so a series is at most a few hundred rows.
    """
    w = W.partitionBy(*keys).orderBy("year")
    past = w.rowsBetween(W.unboundedPreceding, -1)
    y = F.col("value")
    t = yearly.select(*keys, "year", F.col("value").cast("double").alias("value")).withColumn("__i", F.row_number().over(w) - 1)
    prev = F.lag(y).over(w)
    t = t.withColumn("__d", y - prev).withColumn("__prev", prev)
    t = t.withColumn("__dprev", F.lag("__d").over(w))
    n = F.count(y).over(past)
    slope = F.regr_slope(y, F.col("__i")).over(past)
    line = F.avg(y).over(past) + slope * (F.col("__i") - F.avg("__i").over(past))
    phi = F.try_divide(F.sum(F.col("__d") * F.col("__dprev")).over(past),
                       F.sum(F.when(F.col("__dprev").isNotNull(), F.col("__dprev") * F.col("__dprev"))).over(past))
    forms = {
        "naive": F.coalesce("__prev", y),
        "mean": F.coalesce(F.avg(y).over(past), y),
        "linear": F.when(n == 0, y).when(n == 1, F.avg(y).over(past)).otherwise(F.coalesce(line, F.avg(y).over(past))),
        "ar1": F.when(n < 3, F.coalesce("__prev", y)).otherwise(F.col("__prev") + F.coalesce(phi, F.lit(0.0)) * F.coalesce("__dprev", F.lit(0.0))),
    }
    wide = t.select(*keys, "year", "value", *[forms[m].alias(m) for m in methods])
    return wide.unpivot([*keys, "year", "value"], list(methods), "method", "predicted")


def compare_baselines(annual: DataFrame, yearly: DataFrame, keys: Sequence[str] = (), by: Sequence[str] = (), methods: Sequence[str] = BASELINES) -> DataFrame:
    """Model against each yearly baseline on the common years: one row per model.

    ``annual`` has the models' yearly totals per ``keys`` and ``by``; ``yearly``
    the true yearly values per ``keys``. Groups of the result are keys and ``by``.
    """
    keys, by = list(keys), list(by)
    base = annual_baselines(yearly, keys, methods)
    truth = yearly.select(*keys, "year", F.col("value").alias("actual"))
    model = null_safe(annual.select(*keys, *by, "year", F.col("predicted_annual").alias("predicted")), truth, [*keys, "year"])
    mm = model.groupBy(*keys, *by).agg(
        F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("model_mae"),
        (F.avg(F.abs((F.col("actual") - F.col("predicted")) / (F.col("actual") + F.lit(1e-10)))) * 100).alias("model_mape"),
        F.avg(F.col("predicted") - F.col("actual")).alias("model_bias"), F.count(F.lit(1)).alias("n_years"))
    rows = null_safe(model.select(*keys, *by, "year"), base, [*keys, "year"])
    bm = rows.groupBy(*keys, *by, "method").agg(F.avg(F.abs(F.col("value") - F.col("predicted"))).alias("mae"))
    per = bm.groupBy(*keys, *by).agg(
        *[F.max(F.when(F.col("method") == m, F.col("mae"))).alias(f"mae_{m}") for m in methods],
        F.min(F.struct("mae", "method"))["method"].alias("best_baseline"), F.min("mae").alias("__best"))
    if keys or by:
        out = null_safe(mm, per, [*keys, *by])
    else:
        one = per.select(F.struct(*per.columns).alias("s"))
        out = mm.withColumn("s", one.scalar()).select(*mm.columns, "s.*")
    return out.withColumn("beats_all", F.col("model_mae") < F.col("__best")).withColumn(
        "improvement", F.col("__best") - F.col("model_mae")).drop("__best")
