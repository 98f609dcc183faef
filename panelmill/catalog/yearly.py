"""Annual-consistency safeguards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annual as A
from ..operators.calendar import coarsen
from ..plans.panels import naive_predictions, nation_panel
from .common import NAIVE_PREDICTIONS, NATION_QUARTER, query

BASE = "WITH " + NAIVE_PREDICTIONS
DEDUPED = "dd AS (SELECT model, n_name, period, avg(exp(actual)) AS actual, avg(exp(predicted)) AS predicted FROM preds GROUP BY 1, 2, 3)"
ANNUAL = "an AS (SELECT model, n_name, year(period) AS year, sum(actual) AS actual_annual, sum(predicted) AS predicted_annual, count(DISTINCT period) AS n_periods FROM dd GROUP BY 1, 2, 3)"
KEY = ["model", "n_name"]


def annual(spark, sf, **kw):
    return A.annualise_predictions(naive_predictions(spark, sf), KEY, **kw)


SPEC = "model:s n_name:s year:i actual_annual:2 predicted_annual:2 n_periods:i"


@query("a1_annualise_predictions", SPEC, f"{BASE}, {DEDUPED}, {ANNUAL} SELECT * FROM an")
def a1(spark, sf):
    return annual(spark, sf)


@query("a1_annualise_every_row", SPEC, f"{BASE}, {DEDUPED.replace('avg(exp(actual))', 'sum(exp(actual))').replace('avg(exp(predicted))', 'sum(exp(predicted))')}, {ANNUAL} SELECT * FROM an")
def a1b(spark, sf):
    return annual(spark, sf, dedupe="none")


@query("a1_complete_years", SPEC, f"{BASE}, {DEDUPED}, {ANNUAL} SELECT * FROM an WHERE n_periods >= 12")
def a1c(spark, sf):
    return annual(spark, sf, require_complete=12)


@query("a2_annual_consistency", "model:s n_name:s annual_mae:4 annual_mape:6 annual_bias:4 annual_bias_pct:6 n_years:i consistency_score:8", f"""
{BASE}, {DEDUPED}, {ANNUAL} SELECT model, n_name, avg(abs(actual_annual-predicted_annual)) AS annual_mae, avg(abs((actual_annual-predicted_annual)/(actual_annual+1e-10)))*100 AS annual_mape,
 avg(predicted_annual-actual_annual) AS annual_bias, avg(predicted_annual-actual_annual)/avg(actual_annual)*100 AS annual_bias_pct, count(*) AS n_years,
 greatest(0.0, 1 - avg(abs((actual_annual-predicted_annual)/(actual_annual+1e-10)))) AS consistency_score FROM an GROUP BY 1, 2""")
def a2(spark, sf):
    return A.annual_consistency(annual(spark, sf), KEY)


@query("a3_year_errors", "model:s n_name:s year:i error:2 error_pct:6", f"{BASE}, {DEDUPED}, {ANNUAL} SELECT model, n_name, year, actual_annual-predicted_annual AS error, (actual_annual-predicted_annual)/actual_annual*100 AS error_pct FROM an")
def a3(spark, sf):
    return A.year_errors(annual(spark, sf))


YEARLY = "yr AS (SELECT n_name, year(period) AS year, sum(y) AS value, row_number() OVER (PARTITION BY n_name ORDER BY year(period)) - 1 AS i FROM nq GROUP BY 1, 2)"
PAST = "(PARTITION BY n_name ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
BASELINES = f"""{YEARLY},
df AS (SELECT *, lag(value) OVER k AS pv, value - lag(value) OVER k AS d FROM yr WINDOW k AS (PARTITION BY n_name ORDER BY year)),
d2 AS (SELECT *, lag(d) OVER k AS dp FROM df WINDOW k AS (PARTITION BY n_name ORDER BY year)),
bl AS (SELECT n_name, year, value, coalesce(pv, value) AS naive, coalesce(avg(value) OVER p, value) AS mean,
 CASE WHEN i = 0 THEN value WHEN i = 1 THEN pv ELSE avg(value) OVER p + (covar_pop(value, i) OVER p / var_pop(i) OVER p)*(i - avg(i) OVER p) END AS linear,
 CASE WHEN i < 3 THEN coalesce(pv, value) ELSE pv + (sum(d*dp) OVER p / sum(CASE WHEN dp IS NOT NULL THEN dp*dp END) OVER p)*dp END AS ar1
 FROM d2 WINDOW p AS {PAST})"""


def yearly(spark, sf):
    y = coarsen(nation_panel(spark, sf, "quarter"), ["n_name"], ["y"], "year")
    return y.select("n_name", F.year("period").alias("year"), F.col("y").alias("value"))


def _baseline(method):
    def run(spark, sf):
        return A.annual_baselines(yearly(spark, sf), ["n_name"], [method])

    return run


for _id, _m in (("a4_baseline_naive", "naive"), ("a5_baseline_mean", "mean"), ("a6_baseline_linear", "linear"), ("a7_baseline_ar1_diff", "ar1")):
    query(_id, "n_name:s year:i predicted:2" if _m == "naive" else "n_name:s year:i predicted:4",
          f"WITH {NATION_QUARTER}, {BASELINES} SELECT n_name, year, {_m} AS predicted FROM bl")(_baseline(_m))


@query("a8_compare_baselines", "model:s n_name:s model_mae:-2 n_years:i mae_naive:-2 mae_mean:-2 mae_linear:-2 best_baseline:s beats_all:b improvement:-2", f"""
{BASE}, {DEDUPED}, {ANNUAL}, {NATION_QUARTER}, {BASELINES},
j AS (SELECT an.model, bl.*, predicted_annual FROM an JOIN bl ON an.n_name = bl.n_name AND an.year = bl.year),
s AS (SELECT model, n_name, avg(abs(value - predicted_annual)) AS model_mae, count(*) AS n_years, avg(abs(value-naive)) AS mae_naive, avg(abs(value-mean)) AS mae_mean, avg(abs(value-linear)) AS mae_linear FROM j GROUP BY 1, 2)
SELECT *, CASE WHEN mae_linear <= least(mae_mean, mae_naive) THEN 'linear' WHEN mae_mean <= mae_naive THEN 'mean' ELSE 'naive' END AS best_baseline,
 model_mae < least(mae_naive, mae_mean, mae_linear) AS beats_all, least(mae_naive, mae_mean, mae_linear) - model_mae AS improvement FROM s""")
def a8(spark, sf):
    return A.compare_baselines(annual(spark, sf), yearly(spark, sf), ["n_name"], ["model"])
