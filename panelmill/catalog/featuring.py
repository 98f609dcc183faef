"""Feature engineering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators.folds import fold_plan, period_axis
from ..plans.panels import line_rows, nation_aligned, nation_panel, region_quarter, table
from .common import LINE_ROWS, NATION_ALIGNED, NATION_QUARTER, QUARTER_ALIGNED, REGION_QUARTER, folds_sql, query

W = "WINDOW w AS (PARTITION BY n_name ORDER BY ord)"


@query("f1_target_transform", "n_name:s period:d log_y:8 dlog_y:8 raw_y:2", f"""
WITH {NATION_ALIGNED} SELECT n_name, period, ln(y) AS log_y, ln(y) - lag(ln(y)) OVER w AS dlog_y, y AS raw_y FROM na {W}""")
def f1(spark, sf):
    p = X.target_transform(nation_aligned(spark, sf), "y", ["n_name"], "log", "log_y")
    p = X.target_transform(p, "y", ["n_name"], "delta_log", "dlog_y")
    return X.target_transform(p, "y", ["n_name"], "none", "raw_y")


@query("f1_transform_metadata", "n_name:s original_min:2 original_max:2 original_mean:4 transformed_min:8 transformed_max:8", f"""
WITH {NATION_ALIGNED} SELECT n_name, min(y) AS original_min, max(y) AS original_max, avg(y) AS original_mean, min(ln(y)) AS transformed_min, max(ln(y)) AS transformed_max FROM na GROUP BY 1""")
def f1b(spark, sf):
    return X.transform_metadata(X.target_transform(nation_aligned(spark, sf), "y", ["n_name"]), "y", "target", ["n_name"])


@query("f2_inverse_transform", "o_orderkey:i back:4", "SELECT o_orderkey, exp(ln(o_totalprice)) AS back FROM orders")
def f2(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.inverse_transform(F.ln("o_totalprice")).alias("back"))


@query("f3_lag_features", "n_name:s period:d y_lag1:2 y_lag2:2 y_lag4:2 n_orders_lag1:0 n_orders_lag2:0 n_orders_lag4:0", f"""
WITH {NATION_ALIGNED} SELECT n_name, period, lag(y,1) OVER w AS y_lag1, lag(y,2) OVER w AS y_lag2, lag(y,4) OVER w AS y_lag4,
 lag(n_orders,1) OVER w AS n_orders_lag1, lag(n_orders,2) OVER w AS n_orders_lag2, lag(n_orders,4) OVER w AS n_orders_lag4 FROM na {W}""")
def f3(spark, sf):
    return X.lag_features(nation_aligned(spark, sf), ["y", "n_orders"], [1, 2, 4], ["n_name"])


def _roll(c, n, shift=0):
    over = f"OVER (PARTITION BY n_name ORDER BY ord ROWS BETWEEN {n - 1 + shift} PRECEDING AND {shift} {'PRECEDING' if shift else 'FOLLOWING'})"
    over = over.replace("AND 0 FOLLOWING", "AND CURRENT ROW")
    return (f"avg({c}) {over} AS {c}_roll{n}_mean, stddev_samp({c}) {over} AS {c}_roll{n}_std, min({c}) {over} AS {c}_roll{n}_min, max({c}) {over} AS {c}_roll{n}_max")


ROLL_SPEC = "n_name:s period:d " + " ".join(f"n_orders_roll{n}_{f}:6" for n in (4, 8) for f in ("mean", "std", "min", "max"))


@query("f4_rolling_features", ROLL_SPEC, f"WITH {NATION_ALIGNED} SELECT n_name, period, {_roll('n_orders', 4)}, {_roll('n_orders', 8)} FROM na")
def f4(spark, sf):
    return X.rolling_features(nation_aligned(spark, sf), ["n_orders"], [4, 8], ["mean", "std", "min", "max"], ["n_name"])


@query("f5_rolling_shifted", ROLL_SPEC, f"WITH {NATION_ALIGNED} SELECT n_name, period, {_roll('n_orders', 4, 1)}, {_roll('n_orders', 8, 1)} FROM na")
def f5(spark, sf):
    return X.rolling_features(nation_aligned(spark, sf), ["n_orders"], [4, 8], ["mean", "std", "min", "max"], ["n_name"], shift=1)


@query("f5_shift_features", "n_name:s period:d y:2 n_orders:0", f"WITH {NATION_ALIGNED} SELECT n_name, period, lag(y) OVER w AS y, lag(n_orders) OVER w AS n_orders FROM na {W}")
def f5b(spark, sf):
    return X.shift_features(nation_aligned(spark, sf), ["y", "n_orders"], 1, ["n_name"])


@query("f6_season_dummies", "n_name:s period:d Q2:i Q3:i Q4:i", f"""
WITH {NATION_QUARTER} SELECT n_name, period, (quarter(period)=2)::INT AS "Q2", (quarter(period)=3)::INT AS "Q3", (quarter(period)=4)::INT AS "Q4" FROM nq""")
def f6(spark, sf):
    return nation_panel(spark, sf, "quarter").select("n_name", "period", *X.season_dummies())


@query("f7_season_sincos", "n_name:s period:d season_sin:8 season_cos:8", f"""
WITH {NATION_QUARTER} SELECT n_name, period, sin(2*pi()*(quarter(period)-1)/4) AS season_sin, cos(2*pi()*(quarter(period)-1)/4) AS season_cos FROM nq""")
def f7(spark, sf):
    return nation_panel(spark, sf, "quarter").select("n_name", "period", *X.season_sincos())


@query("f8_shock_dummies", "n_name:s period:d dip:i peak:i", f"""
WITH {NATION_QUARTER} SELECT n_name, period, (period BETWEEN DATE '1997-01-01' AND DATE '1998-04-01')::INT AS dip, (period BETWEEN DATE '2000-07-01' AND DATE '2001-01-01')::INT AS peak FROM nq""")
def f8(spark, sf):
    shocks = {"dip": ("1997Q1", "1998Q2"), "peak": ("2000-Q3", "2001 Q1")}
    return nation_panel(spark, sf, "quarter").select("n_name", "period", *X.shock_dummies(shocks))


@query("f9_growth_log", "n_name:s period:d y_dlog:8 dev_dlog:8", f"""
WITH {NATION_ALIGNED}, dv AS (SELECT *, n_orders - 8 AS dev FROM na),
sh AS (SELECT *, CASE WHEN min(dev) OVER k <= 0 THEN dev + 0.01*min(CASE WHEN dev > 0 THEN dev END) OVER k ELSE dev END AS d2 FROM dv WINDOW k AS (PARTITION BY n_name)),
lg AS (SELECT n_name, period, ord, ln(y) AS ly, CASE WHEN d2 > 0 THEN ln(d2) END AS ld FROM sh)
SELECT n_name, period, ly - lag(ly) OVER w AS y_dlog, ld - lag(ld) OVER w AS dev_dlog FROM lg {W}""")
def f9(spark, sf):
    p = nation_aligned(spark, sf).withColumn("dev", F.col("n_orders") - 8)
    return X.growth_log(p, ["y", "dev"], ["n_name"])


@query("f10_difference", "n_name:s period:d y_diff:2 n_orders_diff:0", f"WITH {NATION_ALIGNED} SELECT n_name, period, y - lag(y) OVER w AS y_diff, n_orders - lag(n_orders) OVER w AS n_orders_diff FROM na {W}")
def f10(spark, sf):
    return X.difference(nation_aligned(spark, sf), ["y", "n_orders"], ["n_name"])


@query("f11_ratio_features", "n_name:s period:d y_per_n_orders:6 y_per_spare:6", f"""
WITH {NATION_ALIGNED}, sp AS (SELECT *, n_orders - 8 AS spare FROM na)
SELECT n_name, period, y/n_orders AS y_per_n_orders, CASE WHEN spare <> 0 THEN y/spare END AS y_per_spare FROM sp""")
def f11(spark, sf):
    return X.ratio_features(nation_aligned(spark, sf).withColumn("spare", F.col("n_orders") - 8), "y", ["n_orders", "spare"], ["n_name"])


@query("f11_ratio_shifted", "n_name:s period:d y_per_n_orders:6", f"WITH {NATION_ALIGNED} SELECT n_name, period, lag(y/n_orders) OVER w AS y_per_n_orders FROM na {W}")
def f11b(spark, sf):
    return X.ratio_features(nation_aligned(spark, sf), "y", ["n_orders"], ["n_name"], shift=1)


@query("f12_degree_features", "n_name:s period:d HDD_proxy:6 CDD_proxy:6", f"""
WITH {NATION_ALIGNED} SELECT n_name, period, CASE WHEN n_orders IS NOT NULL THEN greatest(0.0, 9.0 - n_orders) END AS "HDD_proxy", CASE WHEN n_orders IS NOT NULL THEN greatest(0.0, n_orders - 9.0) END AS "CDD_proxy" FROM na""")
def f12(spark, sf):
    return nation_aligned(spark, sf).select("n_name", "period", *X.degree_features("n_orders", 9.0))


ENG = ("n_name:s period:d target:8 y_lag1:2 y_lag2:2 y_lag3:2 y_lag4:2 y_roll4_mean:6 y_roll4_std:4 y_roll8_mean:6 y_roll8_std:4 y_dlog:8 n_orders_dlog:8 "
       "y_per_n_orders:6 HDD_proxy:6 CDD_proxy:6 Q2:i Q3:i Q4:i COVID:i EnergyCrisis:i")


def _r(f, n):
    return f"{f}(y) OVER (PARTITION BY n_name ORDER BY ord ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


ENGINEERED = f"""
fe AS (SELECT n_name, period, ord, y, n_orders, ln(y) AS target, lag(y,1) OVER w AS y_lag1, lag(y,2) OVER w AS y_lag2, lag(y,3) OVER w AS y_lag3, lag(y,4) OVER w AS y_lag4,
 {_r('avg', 4)} AS y_roll4_mean, {_r('stddev_samp', 4)} AS y_roll4_std, {_r('avg', 8)} AS y_roll8_mean, {_r('stddev_samp', 8)} AS y_roll8_std,
 lag(ln(y),1) OVER w - lag(ln(y),2) OVER w AS y_dlog, ln(n_orders) - lag(ln(n_orders)) OVER w AS n_orders_dlog, lag(y/n_orders) OVER w AS y_per_n_orders,
 CASE WHEN n_orders IS NOT NULL THEN greatest(0.0, 18.0 - n_orders) END AS "HDD_proxy", CASE WHEN n_orders IS NOT NULL THEN greatest(0.0, n_orders - 18.0) END AS "CDD_proxy",
 (quarter(period)=2)::INT AS "Q2", (quarter(period)=3)::INT AS "Q3", (quarter(period)=4)::INT AS "Q4",
 (period BETWEEN DATE '2020-01-01' AND DATE '2021-10-01')::INT AS "COVID", (period BETWEEN DATE '2022-01-01' AND DATE '2023-10-01')::INT AS "EnergyCrisis" FROM nq {W})"""


def engineered(spark, sf):
    panel = nation_aligned(spark, sf, "quarter").drop("avg_price")
    return X.engineer_features(panel, "y", ["n_name"], rolling=(4, 8), growth=("y", "n_orders"), ratios=("n_orders",), degree_col="n_orders")


@query("f13_engineer_features", ENG, f"WITH {QUARTER_ALIGNED}, {ENGINEERED} SELECT * FROM fe")
def f13(spark, sf):
    return engineered(spark, sf)[0]


DICT = {"n_orders": "original", "y_lag1": "lag", "y_roll4_mean": "rolling", "y_dlog": "growth", "y_per_n_orders": "ratio", "HDD_proxy": "degree", "Q2": "seasonality", "COVID": "shock"}


@query("f14_feature_dictionary", "feature:s n_unique:i min:6 max:6 mean:4 missing_pct:6 category:s", f"WITH {QUARTER_ALIGNED}, {ENGINEERED} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count(DISTINCT "{c}") AS n_unique, min("{c}") AS min, max("{c}") AS max, avg("{c}") AS mean, (count(*) - count("{c}"))*100.0/count(*) AS missing_pct, '{k}' AS category FROM fe"""
    for c, k in DICT.items()))
def f14(spark, sf):
    df, category = engineered(spark, sf)
    return X.feature_dictionary(df, {c: category[c] for c in DICT})


@query("f15_horizon_target", "n_name:s period:d y_h1:2 y_h2:2 y_h4:2", f"WITH {NATION_ALIGNED} SELECT n_name, period, lead(y,1) OVER w AS y_h1, lead(y,2) OVER w AS y_h2, lead(y,4) OVER w AS y_h4 FROM na {W}")
def f15(spark, sf):
    p = nation_aligned(spark, sf)
    for h in (1, 2, 4):
        p = X.horizon_target(p, "y", h, ["n_name"])
    return p


@query("f16_lookback_sequences", "r_name:s period:d first_y:2 last_y:2 total:2 len:i", f"""
WITH {REGION_QUARTER} SELECT * FROM (SELECT r_name, period, lag(y,4) OVER w AS first_y, lag(y,1) OVER w AS last_y, lag(y,1) OVER w + lag(y,2) OVER w + lag(y,3) OVER w + lag(y,4) OVER w AS total, 4 AS len
 FROM rq WINDOW w AS (PARTITION BY r_name ORDER BY ord)) WHERE first_y IS NOT NULL""")
def f16(spark, sf):
    s = X.lookback_sequences(region_quarter(spark, sf), ["y", "ord"], 4, ["r_name"])
    at = lambda i: F.col("sequence")[i][0]
    return s.select("r_name", "period", at(0).alias("first_y"), at(3).alias("last_y"), (at(3) + at(2) + at(1) + at(0)).alias("total"), F.size("sequence").alias("len"))


@query("f16_lookback_padded", "r_name:s period:d first_y:2 last_y:2 len:i", f"""
WITH {REGION_QUARTER} SELECT r_name, period, coalesce(lag(y,4) OVER w, lag(y,3) OVER w, lag(y,2) OVER w, lag(y,1) OVER w, y) AS first_y, coalesce(lag(y,1) OVER w, y) AS last_y, 4 AS len
FROM rq WINDOW w AS (PARTITION BY r_name ORDER BY ord)""")
def f16b(spark, sf):
    s = X.lookback_sequences(region_quarter(spark, sf), ["y"], 4, ["r_name"], pad=True)
    at = lambda i: F.col("sequence")[i][0]
    return s.select("r_name", "period", at(0).alias("first_y"), at(3).alias("last_y"), F.size("sequence").alias("len"))


SC = "l_orderkey:i l_linenumber:i l_partkey:i l_suppkey:i l_quantity_scaled:6 l_extendedprice_scaled:6"
TRAIN = "period < DATE '2000-01-01'"


def _sc(expr_a, expr_b):
    a, b = (lambda c: expr_a.format(c=c)), (lambda c: expr_b.format(c=c))
    return f"""
WITH {LINE_ROWS}, tr AS (SELECT {', '.join(f'{a(c)} AS a_{c}, {b(c)} AS b_{c}' for c in ('l_quantity', 'l_extendedprice'))} FROM lr WHERE {TRAIN})
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity - a_l_quantity)/b_l_quantity AS l_quantity_scaled, (l_extendedprice - a_l_extendedprice)/b_l_extendedprice AS l_extendedprice_scaled FROM lr, tr"""


def _scaled(spark, sf, how):
    return X.scale(line_rows(spark, sf), ["l_quantity", "l_extendedprice"], how, fit_on=F.col("period") < F.lit("2000-01-01").cast("date"))


@query("f17_scale_standard", SC, _sc("avg({c})", "stddev_pop({c})"))
def f17(spark, sf):
    return _scaled(spark, sf, "standard")


@query("f17_scale_minmax", SC, _sc("min({c})", "(max({c}) - min({c}))"))
def f17b(spark, sf):
    return _scaled(spark, sf, "minmax")


@query("f17_scale_robust", SC, _sc("median({c})", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"))
def f17c(spark, sf):
    return _scaled(spark, sf, "robust")


@query("f17_scale_per_fold", "r_name:s fold_id:i period:d y_scaled:8", f"""
WITH {REGION_QUARTER}, {folds_sql('rq', 12)},
st AS (SELECT r_name, fold_id, avg(y) AS m, stddev_pop(y) AS s FROM rq JOIN pl ON ord BETWEEN train_start_ord AND train_end_ord GROUP BY 1, 2)
SELECT r_name, fold_id, period, (y - m)/s AS y_scaled FROM rq JOIN pl ON ord BETWEEN test_start_ord AND test_end_ord JOIN st USING (r_name, fold_id)""")
def f17d(spark, sf):
    from ..operators.modelling import fold_moments
    from ..operators.folds import assign_folds

    panel = region_quarter(spark, sf)
    plan = fold_plan(period_axis(panel), 12)
    stats = fold_moments(panel, ["y"], plan, ["r_name"])
    rows = assign_folds(panel, plan).join(stats, ["r_name", "train_end_ord"])
    return rows.withColumn("y_scaled", (F.col("y") - F.col("mean_y")) / F.col("std_y"))
