"""Evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annual as A
from ..operators import evaluate as V
from ..plans.panels import naive_predictions, supplier_alternatives, table
from .common import NAIVE_PREDICTIONS, SUPPLIERS, query

M = ("avg(abs(actual-predicted)) AS mae, sqrt(avg((actual-predicted)**2)) AS rmse, avg((actual-predicted)**2) AS mse, avg(abs((actual-predicted)/(actual+1e-10)))*100 AS mape, "
     "CASE WHEN var_pop(actual) = 0 THEN 0.0 ELSE 1 - sum((actual-predicted)**2)/(var_pop(actual)*count(*)) END AS r2, avg(predicted-actual) AS bias, count(*) AS n")
MS = "mae:8 rmse:8 mse:8 mape:6 r2:6 bias:8 n:i"
BASE = "WITH " + NAIVE_PREDICTIONS
HM = f"hm AS (SELECT model, n_name, horizon, {M} FROM preds GROUP BY 1, 2, 3)"
WGT = "CASE horizon WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 WHEN 4 THEN 0.2 ELSE 0 END"
FM = "fm AS (SELECT model, n_name, fold_id, avg(abs(actual-predicted)) AS mae FROM preds GROUP BY 1, 2, 3)"


@query("v1_forecast_metrics", "model:s n_name:s " + MS, f"{BASE} SELECT model, n_name, {M} FROM preds GROUP BY 1, 2")
def v1(spark, sf):
    return V.forecast_metrics(naive_predictions(spark, sf), ["model", "n_name"])


@query("v1_forecast_metrics_rows", "l_returnflag:s mae:6 rmse:6 mse:2 mape:6 r2:6 bias:6 n:i", """
WITH p AS (SELECT l_returnflag, l_extendedprice AS actual, 1000*l_quantity AS predicted FROM lineitem) SELECT l_returnflag, """ + M + " FROM p GROUP BY 1")
def v1b(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("actual"), (1000 * F.col("l_quantity")).alias("predicted"))
    return V.forecast_metrics(rows, ["l_returnflag"])


@query("v2_metrics_by_horizon", "model:s horizon:i " + MS, f"""
{BASE}, m AS (SELECT model, horizon, {M} FROM preds GROUP BY 1, 2)
SELECT g.model, h.horizon, coalesce(mae,0) AS mae, coalesce(rmse,0) AS rmse, coalesce(mse,0) AS mse, coalesce(mape,0) AS mape, coalesce(r2,0) AS r2, coalesce(bias,0) AS bias, coalesce(n,0) AS n
FROM (SELECT DISTINCT model FROM preds) g CROSS JOIN (VALUES (1),(2),(4),(8)) AS h(horizon) LEFT JOIN m ON m.model = g.model AND m.horizon = h.horizon""")
def v2(spark, sf):
    return V.metrics_by_horizon(naive_predictions(spark, sf), (1, 2, 4, 8), ["model"])


STAB = "avg(mae) AS error_mean, stddev_pop(mae) AS error_std, min(mae) AS error_min, max(mae) AS error_max, max(mae)-min(mae) AS error_range, 1/(1+stddev_pop(mae)) AS stability_score, max(mae) AS worst_fold_error, count(*) AS n_folds"


@query("v3_stability", "model:s n_name:s error_mean:8 error_std:8 error_min:8 error_max:8 error_range:8 stability_score:8 worst_fold_error:8 n_folds:i", f"{BASE}, {FM} SELECT model, n_name, {STAB} FROM fm GROUP BY 1, 2")
def v3(spark, sf):
    return V.stability(naive_predictions(spark, sf), ["model", "n_name"])


@query("v4_weighted_mae", "model:s n_name:s weighted_mae:8", f"{BASE}, {HM} SELECT model, n_name, sum({WGT}*mae) AS weighted_mae FROM hm GROUP BY 1, 2")
def v4(spark, sf):
    per = V.metrics_by_horizon(naive_predictions(spark, sf), by=["model", "n_name"])
    return V.weighted_mae(per, by=["model", "n_name"])


WIDE = ", ".join(f"coalesce(max({m}) FILTER (horizon = {h}), 0) AS {m}_h{h}" for h in (1, 2, 4) for m in ("mae", "rmse", "mape", "r2"))
SUMMARY = f"""{FM}, {HM}, su AS (SELECT hm.model, hm.n_name, sum({WGT}*mae) AS weighted_mae, {WIDE}, any_value(s.stability_score) AS stability_score, any_value(s.error_std) AS error_std, any_value(s.worst_fold_error) AS worst_fold_error
 FROM hm JOIN (SELECT model, n_name, {STAB} FROM fm GROUP BY 1, 2) s ON s.model = hm.model AND s.n_name = hm.n_name GROUP BY 1, 2)"""
SUM_SPEC = "model:s n_name:s weighted_mae:8 stability_score:8 error_std:8 worst_fold_error:8 " + " ".join(f"{m}_h{h}:6" for h in (1, 2, 4) for m in ("mae", "rmse", "mape", "r2"))


def summary(spark, sf):
    return V.evaluation_summary(naive_predictions(spark, sf), ["model", "n_name"])


@query("v5_evaluation_summary", SUM_SPEC, f"{BASE}, {SUMMARY} SELECT * FROM su")
def v5(spark, sf):
    return summary(spark, sf)


@query("v6_compare_models", "n_name:s model:s weighted_mae:8 position:i", f"{BASE}, {SUMMARY} SELECT n_name, model, weighted_mae, row_number() OVER (PARTITION BY n_name ORDER BY weighted_mae, model) AS position FROM su")
def v6(spark, sf):
    from pyspark.sql import Window as W

    ordered = V.compare_models(summary(spark, sf))
    return ordered.withColumn("position", F.row_number().over(W.partitionBy("n_name").orderBy("weighted_mae", "model")))


@query("v7_pivot_model_by_option", "n_name:s naive:8 seasonal:8", f"{BASE}, {SUMMARY} SELECT n_name, max(weighted_mae) FILTER (model='naive') AS naive, max(weighted_mae) FILTER (model='seasonal') AS seasonal FROM su GROUP BY 1")
def v7(spark, sf):
    return V.pivot_model_by_option(summary(spark, sf), ["naive", "seasonal"], model="n_name", option="model")


@query("v8_best_per_group", "n_name:s model:s weighted_mae:8", f"{BASE}, {SUMMARY} SELECT n_name, arg_min(model, weighted_mae) AS model, min(weighted_mae) AS weighted_mae FROM su GROUP BY 1")
def v8(spark, sf):
    return V.best_per_group(summary(spark, sf), ["n_name"], "weighted_mae", ["model"])


@query("v9_option_summary", "model:s mean:8 std:8 min:8 n_models:i", f"{BASE}, {SUMMARY} SELECT model, avg(weighted_mae) AS mean, stddev_samp(weighted_mae) AS std, min(weighted_mae) AS min, count(*) AS n_models FROM su GROUP BY 1")
def v9(spark, sf):
    return V.option_summary(summary(spark, sf), "model")


@query("v10_predictions_by_date", "model:s period:d actual:8 predicted:8 residual:8", f"{BASE} SELECT model, period, avg(actual) AS actual, avg(predicted) AS predicted, avg(actual) - avg(predicted) AS residual FROM preds GROUP BY 1, 2")
def v10(spark, sf):
    return V.predictions_by_date(naive_predictions(spark, sf), ["model"])


@query("v11_minmax_normalise", "l_suppkey:i revenue_norm:6 discount_norm:6 lines_norm:6", f"""
WITH {SUPPLIERS} SELECT l_suppkey, (revenue - min(revenue) OVER ())/(max(revenue) OVER () - min(revenue) OVER ()) AS revenue_norm,
 1 - (discount - min(discount) OVER ())/(max(discount) OVER () - min(discount) OVER ()) AS discount_norm, (lines - min(lines) OVER ())/(max(lines) OVER () - min(lines) OVER ()) AS lines_norm FROM sa""")
def v11(spark, sf):
    return V.minmax_normalise(supplier_alternatives(spark, sf), ["revenue", "discount", "lines"], costs=["discount"])


@query("v12_top_n", "l_orderkey:i l_linenumber:i l_extendedprice:2", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def v12(spark, sf):
    return V.top_n(table(spark, sf, "lineitem"), 25, "l_extendedprice", tie=["l_orderkey", "l_linenumber"])


@query("v12_top_n_by_group", "l_shipdate_month:d l_orderkey:i l_extendedprice:2 rank:i", """
SELECT * FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS l_shipdate_month, l_orderkey, l_extendedprice,
 row_number() OVER (PARTITION BY date_trunc('month', l_shipdate) ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 3""")
def v12b(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("l_shipdate_month", F.to_date(F.date_trunc("month", "l_shipdate")))
    return V.top_n(rows, 3, "l_extendedprice", ["l_shipdate_month"], ["l_orderkey", "l_linenumber", "l_partkey"])


@query("v13_merge_metrics", "n_name:s model:s weighted_mae:8 annual_mape:6 n_years:i model_id:s", f"""
{BASE}, {SUMMARY},
dd AS (SELECT model, n_name, period, avg(exp(actual)) AS actual, avg(exp(predicted)) AS predicted FROM preds GROUP BY 1, 2, 3),
an AS (SELECT model, n_name, year(period) AS year, sum(actual) AS a, sum(predicted) AS p FROM dd GROUP BY 1, 2, 3),
ac AS (SELECT model, n_name, avg(abs((a-p)/(a+1e-10)))*100 AS annual_mape, count(*) AS n_years FROM an GROUP BY 1, 2)
SELECT su.n_name, su.model, weighted_mae, annual_mape, n_years, su.n_name || '/' || su.model AS model_id FROM su LEFT JOIN ac ON ac.model = su.model AND ac.n_name = su.n_name""")
def v13(spark, sf):
    preds = naive_predictions(spark, sf)
    yearly = A.annual_consistency(A.annualise_predictions(preds, ["n_name", "model"]), ["n_name", "model"])
    return V.merge_metrics(V.evaluation_summary(preds, ["n_name", "model"]), yearly, ["n_name", "model"])
