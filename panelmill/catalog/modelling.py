"""Models, backtests and search (M1–M6, H1–H4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as V
from ..operators import modelling as M
from ..operators import sweep as H
from ..operators.features import lag_features, season_sincos
from ..operators.folds import fold_plan, period_axis
from ..plans.panels import LINE_FEATURES, line_rows, nation_aligned, region_quarter
from .common import LINE_ROWS, REGION_QUARTER, folds_sql, query
from .selecting import line_plan

RIDGE1 = f"""{LINE_ROWS}, r1 AS (SELECT count(*) AS n, avg(l_quantity) AS mx, avg(target) AS my, covar_pop(l_quantity, target) AS sxy, var_pop(l_quantity) AS sxx FROM lr)"""


@query("m1_ridge_one_feature", "n:i intercept:8 beta:8 beta_std:8", f"""
WITH {RIDGE1}, b AS (SELECT n, mx, my, n*sxy/(sxx*(n + 1)) AS beta, n*sxy/(sqrt(sxx)*(n + 1)) AS beta_std FROM r1) SELECT n, my - beta*mx AS intercept, beta, beta_std FROM b""")
def m1(spark, sf):
    fit = M.fit_final_ridge(line_rows(spark, sf), "target", ["l_quantity"])
    return fit.select("n", "intercept", F.col("beta")[0].alias("beta"), F.col("beta_std")[0].alias("beta_std"))


@query("m1_ridge_two_features_by_brand", "p_brand:s n:i intercept:6 b_quantity:8 b_price:8", f"""
WITH {LINE_ROWS}, s AS (SELECT p_brand, count(*) AS n, avg(target) AS my, avg(l_quantity) AS m1, avg(unit_price) AS m2, stddev_pop(l_quantity) AS s1, stddev_pop(unit_price) AS s2,
 covar_pop(l_quantity, target)*count(*)/stddev_pop(l_quantity) AS c1, covar_pop(unit_price, target)*count(*)/stddev_pop(unit_price) AS c2, corr(l_quantity, unit_price)*count(*) AS r FROM lr GROUP BY 1),
b AS (SELECT *, (c1*(n+10) - c2*r)/((n+10)*(n+10) - r*r)/s1 AS b1, (c2*(n+10) - c1*r)/((n+10)*(n+10) - r*r)/s2 AS b2 FROM s)
SELECT p_brand, n, my - b1*m1 - b2*m2 AS intercept, b1 AS b_quantity, b2 AS b_price FROM b""")
def m1b(spark, sf):
    fit = M.fit_final_ridge(line_rows(spark, sf), "target", ["l_quantity", "unit_price"], alpha=10.0, by=["p_brand"])
    return fit.select("p_brand", "n", "intercept", F.col("beta")[0].alias("b_quantity"), F.col("beta")[1].alias("b_price"))


METRICS = "mae:6 rmse:6 mse:6 mape:6 r2:6 bias:6 n:i"


def tree_metrics(spark, sf, kind, **params):
    rows = line_rows(spark, sf)
    return V.forecast_metrics(M.backtest_tree(rows, "target", LINE_FEATURES, line_plan(rows), kind, **params), ["model", "horizon"])


@query("m2_random_forest", "model:s horizon:i " + METRICS)
def m2(spark, sf):
    return tree_metrics(spark, sf, "random_forest")


@query("m3_gbt", "model:s horizon:i " + METRICS)
def m3(spark, sf):
    return tree_metrics(spark, sf, "gbt")


@query("m3_gbt_shallow", "model:s horizon:i " + METRICS)
def m3c(spark, sf):
    """Five rounds of depth 3 over all windows."""
    return tree_metrics(spark, sf, "gbt", rounds=5, depth=3)


AGG = ("avg(abs(actual-predicted)) AS mae, sqrt(avg((actual-predicted)**2)) AS rmse, avg((actual-predicted)**2) AS mse, avg(abs((actual-predicted)/(actual+1e-10)))*100 AS mape, "
       "1 - sum((actual-predicted)**2)/(var_pop(actual)*count(*)) AS r2, avg(predicted-actual) AS bias, count(*) AS n")


# the best cut of quantity for each train window, by the fall of squared error; cuts at 5.5, 10.5, ... 45.5
CUTS = [5.5 + 5 * k for k in range(9)]
STUMP = f"""{LINE_ROWS}, {folds_sql('lr', 40)}, cu AS (SELECT unnest({CUTS!r})::DOUBLE AS cut),
wi AS (SELECT DISTINCT train_start_ord, train_end_ord FROM pl),
wt AS (SELECT train_end_ord, count(*) AS n, sum(target) AS s FROM lr JOIN wi ON ord BETWEEN train_start_ord AND train_end_ord GROUP BY 1),
wc AS (SELECT train_end_ord, cut, count(*) AS nl, sum(target) AS sl FROM lr JOIN wi ON ord BETWEEN train_start_ord AND train_end_ord JOIN cu ON l_quantity <= cut GROUP BY 1, 2),
st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY train_end_ord ORDER BY sl*sl/nl + (s-sl)*(s-sl)/(n-nl) DESC, cut) AS r FROM wc JOIN wt USING (train_end_ord) WHERE n > nl) WHERE r = 1)"""


def stump_metrics(spark, sf, kind, **params):
    rows = line_rows(spark, sf)
    preds = M.backtest_tree(rows, "target", ["l_quantity"], line_plan(rows), kind, cuts=[CUTS], depth=1, **params)
    return V.forecast_metrics(preds, ["horizon"])


@query("m2_forest_stump", "horizon:i " + METRICS, f"""
WITH {STUMP}, p AS (SELECT horizon, target AS actual, CASE WHEN l_quantity <= cut THEN sl/nl ELSE (s-sl)/(n-nl) END AS predicted FROM lr JOIN pl ON ord BETWEEN test_start_ord AND test_end_ord JOIN st USING (train_end_ord))
SELECT horizon, {AGG} FROM p GROUP BY 1""")
def m2b(spark, sf):
    """One tree of one split on all rows, refitted for each train window."""
    return stump_metrics(spark, sf, "random_forest", trees=1, share=1.0, bootstrap=False)


@query("m3_gbt_stump", "horizon:i " + METRICS, f"""
WITH {STUMP}, p AS (SELECT horizon, target AS actual, s/n + .1*(CASE WHEN l_quantity <= cut THEN sl/nl ELSE (s-sl)/(n-nl) END - s/n) AS predicted FROM lr JOIN pl ON ord BETWEEN test_start_ord AND test_end_ord JOIN st USING (train_end_ord))
SELECT horizon, {AGG} FROM p GROUP BY 1""")
def m3b(spark, sf):
    """One round of one split, shrunk by the rate."""
    return stump_metrics(spark, sf, "gbt", rounds=1)


@query("m3_gbt_stump_by_region", "r_name:s horizon:i " + METRICS, f"""
WITH {REGION_QUARTER}, lg AS (SELECT r_name, period, ord, ln(y) AS t, CAST(quarter(period) AS DOUBLE) AS x FROM rq), {folds_sql('lg', 12)},
wi AS (SELECT DISTINCT train_start_ord, train_end_ord FROM pl), cu AS (SELECT unnest([1.5, 2.5, 3.5])::DOUBLE AS cut),
wt AS (SELECT r_name, train_end_ord, count(*) AS n, sum(t) AS s FROM lg JOIN wi ON ord BETWEEN train_start_ord AND train_end_ord GROUP BY ALL),
wc AS (SELECT r_name, train_end_ord, cut, count(*) AS nl, sum(t) AS sl FROM lg JOIN wi ON ord BETWEEN train_start_ord AND train_end_ord JOIN cu ON x <= cut GROUP BY ALL),
st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r_name, train_end_ord ORDER BY sl*sl/nl + (s-sl)*(s-sl)/(n-nl) DESC, cut) AS r FROM wc JOIN wt USING (r_name, train_end_ord) WHERE n > nl) WHERE r = 1),
p AS (SELECT r_name, horizon, t AS actual, s/n + .1*(CASE WHEN x <= cut THEN sl/nl ELSE (s-sl)/(n-nl) END - s/n) AS predicted FROM lg JOIN pl ON ord BETWEEN test_start_ord AND test_end_ord JOIN st USING (r_name, train_end_ord))
SELECT r_name, horizon, {AGG} FROM p GROUP BY 1, 2""")
def m3d(spark, sf):
    """A model of its own for every region and train window."""
    panel = region_quarter(spark, sf).withColumn("target", F.ln("y")).withColumn("season", F.quarter("period").cast("double"))
    preds = M.backtest_tree(panel, "target", ["season"], fold_plan(period_axis(panel), 12), "gbt", ["r_name"], cuts=[[1.5, 2.5, 3.5]], rounds=1, depth=1)
    return V.forecast_metrics(preds, ["r_name", "horizon"])


@query("m5_backtest_region_ridge", "r_name:s horizon:i " + METRICS, f"""
WITH {REGION_QUARTER}, lg AS (SELECT r_name, period, ord, ln(y) AS t, lag(y) OVER (PARTITION BY r_name ORDER BY ord) AS x FROM rq), ok AS (SELECT * FROM lg WHERE x IS NOT NULL), {folds_sql('ok', 12)},
f AS (SELECT r_name, train_end_ord, count(*) AS n, avg(x) AS mx, avg(t) AS my, covar_pop(x, t) AS sxy, var_pop(x) AS sxx FROM ok JOIN (SELECT DISTINCT train_start_ord, train_end_ord FROM pl) ON ord BETWEEN train_start_ord AND train_end_ord GROUP BY 1, 2),
b AS (SELECT *, n*sxy/(sxx*(n + 1)) AS beta FROM f),
p AS (SELECT r_name, horizon, t AS actual, my + beta*(x - mx) AS predicted FROM ok JOIN pl ON ord BETWEEN test_start_ord AND test_end_ord JOIN b USING (r_name, train_end_ord))
SELECT r_name, horizon, {AGG} FROM p GROUP BY 1, 2""")
def m5(spark, sf):
    """Quarterly revenue per region → log → lag → ridge refitted per fold → metrics per horizon."""
    panel = lag_features(region_quarter(spark, sf), ["y"], [1], ["r_name"]).withColumn("target", F.ln("y"))
    panel = panel.na.drop(subset=["target", "y_lag1"])
    plan = fold_plan(period_axis(panel), 12)
    preds = M.backtest_ridge(panel, "target", ["y_lag1"], plan, ["r_name"])
    return V.forecast_metrics(preds, ["r_name", "horizon"])


@query("m5_backtest_rows", "fs_option:s horizon:i " + METRICS, f"""
WITH {LINE_ROWS}, {folds_sql('lr', 40)},
f AS (SELECT train_end_ord, count(*) AS n, avg(l_quantity) AS mx, avg(target) AS my, covar_pop(l_quantity, target) AS sxy, var_pop(l_quantity) AS sxx,
  avg(unit_price) AS ux, covar_pop(unit_price, target) AS uxy, var_pop(unit_price) AS uxx FROM lr JOIN (SELECT DISTINCT train_start_ord, train_end_ord FROM pl) ON ord BETWEEN train_start_ord AND train_end_ord GROUP BY 1),
p AS (SELECT 'quantity' AS fs_option, horizon, target AS actual, my + n*sxy/(sxx*(n + 1))*(l_quantity - mx) AS predicted FROM lr JOIN pl ON ord BETWEEN test_start_ord AND test_end_ord JOIN f USING (train_end_ord)
 UNION ALL SELECT 'price', horizon, target, my + n*uxy/(uxx*(n + 1))*(unit_price - ux) FROM lr JOIN pl ON ord BETWEEN test_start_ord AND test_end_ord JOIN f USING (train_end_ord))
SELECT fs_option, horizon, {AGG} FROM p GROUP BY 1, 2""")
def m5b(spark, sf):
    rows = line_rows(spark, sf)
    preds = M.backtest_ridge(rows, "target", ["l_quantity", "unit_price"], line_plan(rows), options={"quantity": ["l_quantity"], "price": ["unit_price"]})
    return V.forecast_metrics(preds, ["fs_option", "horizon"])


@query("m5_backtest_all_features", "horizon:i " + METRICS)
def m5c(spark, sf):
    rows = line_rows(spark, sf)
    return V.forecast_metrics(M.backtest_ridge(rows, "target", LINE_FEATURES, line_plan(rows)), ["horizon"])


@query("m5_backtest_nation_panel", "n_name:s horizon:i " + METRICS)
def m5d(spark, sf):
    """One ridge per nation and fold, lags and season as features."""
    panel = lag_features(nation_aligned(spark, sf).withColumn("target", F.ln("y")), ["target"], [1, 2, 12], ["n_name"])
    panel = panel.select("*", *season_sincos("month"))
    preds = M.backtest_ridge(panel, "target", ["target_lag1", "target_lag2", "target_lag12", "season_sin", "season_cos"], fold_plan(period_axis(panel), 40), ["n_name"])
    return V.forecast_metrics(preds, ["n_name", "horizon"])


@query("m6_coefficient_table", "feature:s coefficient:6 abs_coefficient:6")
def m6(spark, sf):
    return M.coefficient_table(M.fit_final_ridge(line_rows(spark, sf), "target", LINE_FEATURES), LINE_FEATURES)


@query("m6_final_tree_importance", "feature:s importance:6")
def m6b(spark, sf):
    return M.tree_importance_table(spark, M.fit_tree(line_rows(spark, sf), "target", LINE_FEATURES, "random_forest"))


SPACE = {"alpha": {"type": "log_uniform", "low": 0.01, "high": 1000.0}, "depth": {"type": "int", "low": 2, "high": 8},
         "rate": {"type": "uniform", "low": 0.01, "high": 0.3}, "split": {"type": "categorical", "choices": ["all", "sqrt", "log2"]}}


@query("h1_param_candidates", "alpha:6 depth:i rate:6 split:s fitness:6")
def h1(spark, sf):
    """Random points of the space; their penalties are scored on the line items."""
    rows = line_rows(spark, sf)
    points = H.param_candidates(spark, SPACE, 12)
    alphas = [r["alpha"] for r in points.select("alpha").orderBy("candidate").collect()]
    scored = H.sweep_ridge(rows, "target", LINE_FEATURES, line_plan(rows), alphas)
    return points.join(scored.select(F.col("cand").alias("candidate"), "fitness"), "candidate")


def ridge_sweep(spark, sf):
    rows = line_rows(spark, sf)
    alphas = [10.0 ** (k / 4 - 1) for k in range(20)]
    opts = {"all": LINE_FEATURES, "price": ["unit_price", "l_quantity"], "rates": ["l_discount", "l_tax"]}
    return H.sweep_ridge(rows, "target", LINE_FEATURES, line_plan(rows), alphas, opts)


@query("h2_sweep_ridge", "fs_option:s alpha:6 weighted_mae:6 horizon_spread_penalty:6 fitness:6")
def h2(spark, sf):
    return ridge_sweep(spark, sf)


SWEEP1 = f"""{LINE_ROWS}, {folds_sql('lr', 40)}, al AS (SELECT unnest([1.0, 1000.0, 100000.0])::DOUBLE AS alpha),
f AS (SELECT train_end_ord, count(*) AS n, avg(l_quantity) AS mx, avg(target) AS my, covar_pop(l_quantity, target) AS sxy, var_pop(l_quantity) AS sxx FROM lr JOIN (SELECT DISTINCT train_start_ord, train_end_ord FROM pl) ON ord BETWEEN train_start_ord AND train_end_ord GROUP BY 1),
fm AS (SELECT alpha, fold_id, horizon, avg(abs(target - (my + n*sxy/(sxx*(n + alpha))*(l_quantity - mx)))) AS mae FROM lr JOIN pl ON ord BETWEEN test_start_ord AND test_end_ord JOIN f USING (train_end_ord), al GROUP BY 1, 2, 3),
hm AS (SELECT alpha, horizon, avg(mae) AS mae FROM fm GROUP BY 1, 2),
sw AS (SELECT alpha, sum(CASE horizon WHEN 1 THEN .5 WHEN 2 THEN .3 ELSE .2 END*mae) AS weighted_mae, stddev_pop(mae) AS horizon_spread_penalty FROM hm GROUP BY 1)"""


@query("h2_sweep_ridge_one_feature", "alpha:2 weighted_mae:8 horizon_spread_penalty:8 fitness:8", f"WITH {SWEEP1} SELECT *, weighted_mae + .1*horizon_spread_penalty AS fitness FROM sw")
def h2b(spark, sf):
    rows = line_rows(spark, sf)
    return H.sweep_ridge(rows, "target", ["l_quantity"], line_plan(rows), [1.0, 1000.0, 100000.0])


@query("h2_sweep_tree", "params:s weighted_mae:6 horizon_spread_penalty:6 fitness:6")
def h2c(spark, sf):
    rows = line_rows(spark, sf)
    points = H.param_candidates(spark, FOREST_SPACE, 16).orderBy("candidate").collect()
    return H.sweep_tree(rows, "target", LINE_FEATURES, line_plan(rows), "random_forest", [{k: r[k] for k in FOREST_SPACE} for r in points])


# The search space of the forest.
FOREST_SPACE = {"trees": {"type": "int", "low": 5, "high": 30}, "depth": {"type": "int", "low": 3, "high": 8},
                "min_split": {"type": "int", "low": 2, "high": 10}, "min_leaf": {"type": "int", "low": 1, "high": 5}}


POINT = {name: f"({shift!r} + (i + 1)*{step!r} - floor({shift!r} + (i + 1)*{step!r}))" for name, (step, shift) in zip(SPACE, H.spread(len(SPACE)))}


@query("h1_param_candidates_one", "alpha:6 depth:i rate:6 split:s fitness:6", f"""
WITH pt AS (SELECT i, exp(ln(0.01) + {POINT['alpha']}*(ln(1000.0) - ln(0.01))) AS alpha, CAST(floor(2 + {POINT['depth']}*7) AS INTEGER) AS depth, 0.01 + {POINT['rate']}*(0.3 - 0.01) AS rate,
 list_extract(['all', 'sqrt', 'log2'], CAST(floor({POINT['split']}*3) AS INTEGER) + 1) AS split FROM range(12) AS r(i)),
{SWEEP1.replace("al AS (SELECT unnest([1.0, 1000.0, 100000.0])::DOUBLE AS alpha)", "al AS (SELECT alpha FROM pt)")}
SELECT pt.alpha, depth, rate, split, weighted_mae + .1*horizon_spread_penalty AS fitness FROM pt JOIN sw USING (alpha)""")
def h1b(spark, sf):
    """The points' penalties are scored on one feature."""
    rows = line_rows(spark, sf)
    points = H.param_candidates(spark, SPACE, 12)
    alphas = [r["alpha"] for r in points.select("alpha").orderBy("candidate").collect()]
    scored = H.sweep_ridge(rows, "target", ["l_quantity"], line_plan(rows), alphas)
    return points.join(scored.select(F.col("cand").alias("candidate"), "fitness"), "candidate")


@query("h2_sweep_tree_stumps", "params:s weighted_mae:8 horizon_spread_penalty:8 fitness:8", f"""
WITH {STUMP}, ra AS (SELECT unnest([0.1, 0.5, 1.0])::DOUBLE AS rate),
fm AS (SELECT rate, fold_id, horizon, avg(abs(target - (s/n + rate*(CASE WHEN l_quantity <= cut THEN sl/nl ELSE (s-sl)/(n-nl) END - s/n)))) AS mae FROM lr JOIN pl ON ord BETWEEN test_start_ord AND test_end_ord JOIN st USING (train_end_ord), ra GROUP BY 1, 2, 3),
hm AS (SELECT rate, horizon, avg(mae) AS mae FROM fm GROUP BY 1, 2),
sw AS (SELECT rate, sum(CASE horizon WHEN 1 THEN .5 WHEN 2 THEN .3 ELSE .2 END*mae) AS weighted_mae, stddev_pop(mae) AS horizon_spread_penalty FROM hm GROUP BY 1)
SELECT 'rate=' || CAST(rate AS VARCHAR) || ', rounds=1, depth=1' AS params, weighted_mae, horizon_spread_penalty, weighted_mae + .1*horizon_spread_penalty AS fitness FROM sw
UNION ALL SELECT 'rate=-1.0, rounds=1, depth=1', NULL, NULL, 'Infinity'::DOUBLE""")
def h2d(spark, sf):
    """Three rates and one that cannot be, on one cut of quantity."""
    rows = line_rows(spark, sf)
    points = [{"rate": r, "rounds": 1, "depth": 1} for r in (0.1, 0.5, 1.0, -1.0)]
    return H.sweep_tree(rows, "target", ["l_quantity"], line_plan(rows), "gbt", points, cuts=[CUTS])


@query("h3_sweep_history", "iteration:i mean_fitness:8 best_fitness:8", f"""
WITH {SWEEP1}, fi AS (SELECT row_number() OVER (ORDER BY alpha) - 1 AS iteration, weighted_mae + .1*horizon_spread_penalty AS fitness FROM sw)
SELECT iteration, fitness AS mean_fitness, min(fitness) OVER (ORDER BY iteration) AS best_fitness FROM fi""")
def h3(spark, sf):
    rows = line_rows(spark, sf)
    return H.sweep_history(H.sweep_ridge(rows, "target", ["l_quantity"], line_plan(rows), [1.0, 1000.0, 100000.0]), 1)


@query("h4_sweep_summary", "fs_option:s n_models:i avg_fitness:6 best_fitness:6 best_model:s")
def h4(spark, sf):
    scored = ridge_sweep(spark, sf).withColumn("model", F.concat(F.lit("ridge alpha="), F.round("alpha", 4).cast("string")))
    return H.sweep_summary(scored)


@query("h4_sweep_summary_one_feature", "fs_option:s n_models:i avg_fitness:8 best_fitness:8 best_model:s", f"""
WITH {SWEEP1}, fi AS (SELECT 'all' AS fs_option, alpha, weighted_mae + .1*horizon_spread_penalty AS fitness FROM sw)
SELECT fs_option, count(*) AS n_models, avg(fitness) AS avg_fitness, min(fitness) AS best_fitness, CAST(CAST(arg_min(alpha, fitness) AS BIGINT) AS VARCHAR) AS best_model FROM fi GROUP BY 1""")
def h4b(spark, sf):
    rows = line_rows(spark, sf)
    s = H.sweep_ridge(rows, "target", ["l_quantity"], line_plan(rows), [1.0, 1000.0, 100000.0])
    return H.sweep_summary(s.withColumn("model", F.col("alpha").cast("bigint").cast("string")))
