"""Quality audit and cleaning (Q1–Q13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators.calendar import align_to_spine
from ..plans.panels import events_hour, line_rows, month_series, nation_aligned, nation_panel, table
from .common import EVENTS_HOUR, LINE_ROWS, MONTH_SERIES, NATION_ALIGNED, NATION_MONTH, query

# missing values by rule: the driver tables hold none
HOLES = """
ho AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 3 <> 0 THEN NULL ELSE o_custkey END AS cust,
  CASE WHEN o_orderkey % 200 = 0 THEN 2.0 ELSE 1.0 END AS flat, 'x' AS tag, o_orderstatus, o_orderdate FROM orders)"""


def holes(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.when(k % 17 != 0, F.col("o_totalprice")).alias("price"), F.when(k % 3 == 0, F.col("o_custkey")).alias("cust"),
        F.when(k % 200 == 0, F.lit(2.0)).otherwise(F.lit(1.0)).alias("flat"), F.lit("x").alias("tag"), "o_orderstatus", "o_orderdate")


COLS = ["price", "cust", "flat", "tag", "o_orderstatus"]


@query("q1_missing_report", "column:s missing_count:i missing_pct:6 dtype:s", f"""
WITH {HOLES} SELECT 'price' AS "column", count(*) - count(price) AS missing_count, (count(*) - count(price))*100.0/count(*) AS missing_pct, 'double' AS dtype FROM ho
UNION ALL SELECT 'cust', count(*) - count(cust), (count(*) - count(cust))*100.0/count(*), 'bigint' FROM ho
UNION ALL SELECT 'flat', count(*) - count(flat), (count(*) - count(flat))*100.0/count(*), 'double' FROM ho
UNION ALL SELECT 'tag', count(*) - count(tag), 0.0, 'string' FROM ho
UNION ALL SELECT 'o_orderstatus', count(*) - count(o_orderstatus), 0.0, 'string' FROM ho""")
def q1(spark, sf):
    return Q.missing_report(holes(spark, sf), COLS)


def _mode(c):
    return f"SELECT '{c}' AS \"column\", max(n)*1.0/sum(n) AS mode_share, count(*) AS n_values FROM (SELECT {c}, count(*) AS n FROM ho WHERE {c} IS NOT NULL GROUP BY 1)"


@query("q2_constant_columns", "column:s mode_share:8 n_values:i is_constant:b", f"""
WITH {HOLES} SELECT "column", mode_share, n_values, CASE WHEN "column" IN ('tag','o_orderstatus') THEN n_values <= 1 ELSE mode_share >= 0.99 END AS is_constant
FROM ({' UNION ALL '.join(_mode(c) for c in COLS)})""")
def q2(spark, sf):
    return Q.constant_columns(holes(spark, sf), COLS)


LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "unit_price", "s_acctbal", "target"]
LONG = " UNION ALL ".join(f"SELECT '{c}' AS variable, {c} AS value FROM lr" for c in LINE_COLS)
BOUNDS = """
qb AS (SELECT variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM lg GROUP BY 1),
fb AS (SELECT variable, q1, q3, q1 - 1.5*(q3 - q1) AS lower, q3 + 1.5*(q3 - q1) AS upper FROM qb)"""


@query("q3_outliers_iqr", "variable:s n_outliers:i n_values:i pct_outliers:6 min:4 max:4 mean:4 std:4", f"""
WITH {LINE_ROWS}, lg AS ({LONG}), {BOUNDS}
SELECT variable, count(*) FILTER (value < lower OR value > upper) AS n_outliers, count(*) AS n_values,
 count(*) FILTER (value < lower OR value > upper)*100.0/count(*) AS pct_outliers, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_samp(value) AS std
FROM lg JOIN fb USING (variable) GROUP BY 1 HAVING n_outliers > 0""")
def q3(spark, sf):
    return Q.outliers_iqr(line_rows(spark, sf), LINE_COLS)


@query("q3_iqr_bounds_by_brand", "p_brand:s variable:s n:i q1:6 q3:6 lower:6 upper:6", f"""
WITH {LINE_ROWS}, lg AS (SELECT p_brand, 'l_extendedprice' AS variable, l_extendedprice AS value FROM lr UNION ALL SELECT p_brand, 'target', target FROM lr),
qb AS (SELECT p_brand, variable, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM lg GROUP BY 1, 2)
SELECT *, q1 - 1.5*(q3 - q1) AS lower, q3 + 1.5*(q3 - q1) AS upper FROM qb""")
def q3b(spark, sf):
    return Q.iqr_bounds(line_rows(spark, sf), ["l_extendedprice", "target"], by=["p_brand"])


def _z(sd):
    return f"""
WITH {LINE_ROWS}, lg AS ({LONG}), st AS (SELECT variable, avg(value) AS m, {sd}(value) AS s FROM lg GROUP BY 1)
SELECT variable, count(*) FILTER (abs((value - m)/s) > 2.5) AS n_outliers, count(*) AS n_values, count(*) FILTER (abs((value - m)/s) > 2.5)*100.0/count(*) AS pct_outliers
FROM lg JOIN st USING (variable) GROUP BY 1"""


@query("q4_outliers_zscore", "variable:s n_outliers:i n_values:i pct_outliers:6", _z("stddev_samp"))
def q4(spark, sf):
    return Q.outliers_zscore(line_rows(spark, sf), LINE_COLS, 2.5, keep_zero=True)


@query("q4_outliers_zscore_pop", "variable:s n_outliers:i n_values:i pct_outliers:6", _z("stddev_pop"))
def q4b(spark, sf):
    return Q.outliers_zscore(line_rows(spark, sf), LINE_COLS, 2.5, ddof=0, keep_zero=True)


@query("q5_outliers_mad", "variable:s n_outliers:i n_values:i median:6 mad:6", f"""
WITH {LINE_ROWS}, lg AS ({LONG}), md AS (SELECT variable, median(value) AS med FROM lg GROUP BY 1),
dv AS (SELECT lg.variable, value, med, abs(value - med) AS d FROM lg JOIN md USING (variable)),
mm AS (SELECT variable, median(d) AS mad FROM dv GROUP BY 1)
SELECT variable, count(*) FILTER (mad <> 0 AND 0.6745*d/mad > 3.5) AS n_outliers, count(*) AS n_values, max(med) AS median, max(mad) AS mad
FROM dv JOIN mm USING (variable) GROUP BY 1""")
def q5(spark, sf):
    return Q.outliers_mad(line_rows(spark, sf), LINE_COLS)


@query("q6_outlier_rows", "variable:s l_orderkey:i l_linenumber:i value:8 lower:4 upper:4", f"""
WITH {LINE_ROWS}, lg AS ({' UNION ALL '.join(f"SELECT '{c}' AS variable, {c} AS value, l_orderkey, l_linenumber FROM lr" for c in LINE_COLS)}), {BOUNDS}
SELECT variable, l_orderkey, l_linenumber, value, lower, upper FROM lg JOIN fb USING (variable) WHERE value < lower OR value > upper""")
def q6(spark, sf):
    return Q.outlier_rows(line_rows(spark, sf), LINE_COLS, ["l_orderkey", "l_linenumber"])


@query("q7_temporal_gaps", "c:i gap_from:d gap_to:d gap_days:i", """
WITH cm AS (SELECT DISTINCT o_custkey AS c, CAST(date_trunc('month', o_orderdate) AS DATE) AS period FROM orders),
g AS (SELECT c, lag(period) OVER (PARTITION BY c ORDER BY period) AS gap_from, period AS gap_to FROM cm)
SELECT c, gap_from, gap_to, gap_to - gap_from AS gap_days FROM g WHERE gap_to - gap_from > 100""")
def q7(spark, sf):
    months = table(spark, sf, "orders").select(F.col("o_custkey").alias("c"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("period")).distinct()
    return Q.temporal_gaps(months, ["c"])


@query("q7_gap_summary", "n_name:s start:d end:d n_periods:i n_gaps:i", f"""
WITH {NATION_MONTH}, g AS (SELECT n_name, period, period - lag(period) OVER (PARTITION BY n_name ORDER BY period) AS d FROM nm)
SELECT n_name, min(period) AS start, max(period) AS "end", count(*) AS n_periods, count(*) FILTER (d > 31) AS n_gaps FROM g GROUP BY 1""")
def q7b(spark, sf):
    return Q.gap_summary(nation_panel(spark, sf), ["n_name"], 31)


@query("q8_describe_numeric", "variable:s count:i missing:i missing_pct:6 mean:4 std:4 min:4 q25:4 q50:4 q75:4 max:4 range:4 iqr:4 cv:4 skewness:6 kurtosis:6", f"""
WITH {LINE_ROWS}, {HOLES}, lg AS ({LONG} UNION ALL SELECT 'price', price FROM ho), mu AS (SELECT variable, avg(value) AS m FROM lg GROUP BY 1)
SELECT variable, count(value) AS count, count(*) - count(value) AS missing, (count(*) - count(value))*100.0/count(*) AS missing_pct, avg(value) AS mean, stddev_samp(value) AS std,
 min(value) AS min, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75, max(value) AS max, max(value) - min(value) AS range,
 quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, stddev_samp(value)/avg(value)*100 AS cv,
 avg((value - m)**3)/avg((value - m)**2)**1.5 AS skewness, avg((value - m)**4)/avg((value - m)**2)**2 - 3 AS kurtosis
FROM lg JOIN mu USING (variable) GROUP BY 1""")
def q8(spark, sf):
    line = Q.describe_numeric(line_rows(spark, sf), LINE_COLS)
    return line.unionByName(Q.describe_numeric(holes(spark, sf), ["price"]))


@query("q9_quality_report", "section:s variable:s metric:s value:5", f"""
WITH {MONTH_SERIES}, lg AS ({' UNION ALL '.join(f"SELECT '{c}' AS variable, {c} AS value FROM ms" for c in ('y', 'n_orders', 'n_cust', 'avg_price'))}), {BOUNDS},
mi AS (SELECT variable, count(*) - count(value) AS missing_count, (count(*) - count(value))*100.0/count(*) AS missing_pct FROM lg GROUP BY 1),
co AS (SELECT variable, max(n)*1.0/sum(n) AS mode_share, CASE WHEN max(n)*1.0/sum(n) >= .99 THEN 1.0 ELSE 0.0 END AS is_constant FROM (SELECT variable, value, count(*) AS n FROM lg GROUP BY 1,2) GROUP BY 1),
ou AS (SELECT variable, count(*) FILTER (value < lower OR value > upper) AS n_outliers, count(*) FILTER (value < lower OR value > upper)*100.0/count(*) AS pct_outliers,
  min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_samp(value) AS std FROM lg JOIN fb USING (variable) GROUP BY 1 HAVING n_outliers > 0),
st AS (SELECT variable, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, quantile_cont(value,.25) AS q25, quantile_cont(value,.5) AS q50,
  quantile_cont(value,.75) AS q75, max(value) AS max FROM lg GROUP BY 1),
ga AS (SELECT 'table' AS variable, count(*) FILTER (d > 31) AS n_gaps, count(*) AS n_periods FROM (SELECT period - lag(period) OVER (ORDER BY period) AS d FROM ms))
SELECT 'summary' AS section, 'table' AS variable, unnest(['n_rows','n_columns']) AS metric, unnest([count(*)::DOUBLE, 6.0]) AS value FROM ms
UNION ALL SELECT 'missing', variable, unnest(['missing_count','missing_pct']), unnest([missing_count::DOUBLE, missing_pct]) FROM mi
UNION ALL SELECT 'constant', variable, unnest(['mode_share','is_constant']), unnest([mode_share, is_constant]) FROM co
UNION ALL SELECT 'outliers', variable, unnest(['n_outliers','pct_outliers','min','max','mean','std']), unnest([n_outliers::DOUBLE, pct_outliers, min, max, mean, std]) FROM ou
UNION ALL SELECT 'statistics', variable, unnest(['count','mean','std','min','q25','q50','q75','max']), unnest([count::DOUBLE, mean, std, min, q25, q50, q75, max]) FROM st
UNION ALL SELECT 'gaps', variable, unnest(['n_gaps','n_periods']), unnest([n_gaps::DOUBLE, n_periods::DOUBLE]) FROM ga""")
def q9(spark, sf):
    return Q.quality_report(month_series(spark, sf), ["y", "n_orders", "n_cust", "avg_price"], "period", max_step_days=31)


@query("q10_drop_columns", "o_orderkey:i price:2 o_orderstatus:s", "SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderstatus FROM orders")
def q10(spark, sf):
    out = Q.drop_high_missing(Q.drop_constant(holes(spark, sf), COLS), ["price", "cust", "o_orderstatus"])
    assert not {"flat", "tag", "cust"} & set(out.columns)
    return out


INTERP = """
k AS (SELECT {key}, period, ord, {v} AS v,
  last_value({v} IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN {v} IS NOT NULL THEN ord END IGNORE NULLS) OVER b AS po,
  first_value({v} IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN {v} IS NOT NULL THEN ord END IGNORE NULLS) OVER a AS no
  FROM {src} WINDOW b AS (PARTITION BY {key} ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY {key} ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("q11_interpolate_linear", "event_type:s period:t total:7", f"""
WITH {EVENTS_HOUR}, sp AS (SELECT unnest(generate_series((SELECT min(period) FROM eh), (SELECT max(period) FROM eh), INTERVAL 1 HOUR)) AS period),
al AS (SELECT k.event_type, sp.period, CAST(floor(epoch(sp.period)/3600) AS BIGINT) AS ord, eh.total FROM (SELECT DISTINCT event_type FROM eh) k CROSS JOIN sp LEFT JOIN eh ON eh.event_type = k.event_type AND eh.period = sp.period),
{INTERP.format(key='event_type', v='total', src='al')}
SELECT event_type, period, CASE WHEN v IS NOT NULL THEN v WHEN pv IS NOT NULL AND nv IS NOT NULL THEN pv + (nv - pv)*(ord - po)/(no - po) ELSE pv END AS total FROM k""")
def q11(spark, sf):
    aligned = align_to_spine(events_hour(spark, sf), ["event_type"], "hour")
    # blocks of 100 hours, so the carry between blocks is exercised
    return Q.interpolate_linear(aligned, ["total"], ["event_type"], size=100)


@query("q12_clean", "n_name:s period:d y:4 n_orders:6", f"""
WITH {NATION_ALIGNED}, hn AS (SELECT n_name, period, ord, CASE WHEN ord % 7 <> 0 THEN y END AS y, n_orders FROM na),
{INTERP.format(key='n_name', v='y', src='hn')}, {INTERP.format(key='n_name', v='n_orders', src='hn').replace('k AS', 'k2 AS')}
SELECT k.n_name, k.period, CASE WHEN k.v IS NOT NULL THEN k.v WHEN k.pv IS NOT NULL AND k.nv IS NOT NULL THEN k.pv + (k.nv - k.pv)*(k.ord - k.po)/(k.no - k.po) ELSE k.pv END AS y,
 CASE WHEN k2.v IS NOT NULL THEN k2.v WHEN k2.pv IS NOT NULL AND k2.nv IS NOT NULL THEN k2.pv + (k2.nv - k2.pv)*(k2.ord - k2.po)/(k2.no - k2.po) ELSE k2.pv END AS n_orders
FROM k JOIN k2 ON k.n_name = k2.n_name AND k.ord = k2.ord""")
def q12(spark, sf):
    return Q.clean(_dirty(spark, sf), ["y", "n_orders", "one"], ["n_name"])[0]


def _dirty(spark, sf):
    return nation_aligned(spark, sf).select("n_name", "period", "ord", F.when(F.col("ord") % 7 != 0, F.col("y")).alias("y"), "n_orders", F.lit(1.0).alias("one"))


@query("q12_cleaning_log", "column:s action:s missing_count:i", f"""
WITH {NATION_ALIGNED} SELECT 'one' AS "column", 'dropped_constant' AS action, CAST(NULL AS BIGINT) AS missing_count
UNION ALL SELECT 'y', 'interpolated', count(*) FILTER (ord % 7 = 0 OR y IS NULL) FROM na
UNION ALL (SELECT 'n_orders', 'interpolated', count(*) FILTER (n_orders IS NULL) AS c FROM na HAVING c > 0)
UNION ALL (SELECT 'y', 'remaining', count(*) AS c FROM na JOIN (SELECT n_name, min(CASE WHEN ord % 7 <> 0 AND y IS NOT NULL THEN ord END) AS f FROM na GROUP BY 1) USING (n_name) WHERE ord < f HAVING c > 0)
UNION ALL (SELECT 'n_orders', 'remaining', count(*) AS c FROM na JOIN (SELECT n_name, min(CASE WHEN n_orders IS NOT NULL THEN ord END) AS f FROM na GROUP BY 1) USING (n_name) WHERE ord < f HAVING c > 0)""")
def q12b(spark, sf):
    return Q.clean(_dirty(spark, sf), ["y", "n_orders", "one"], ["n_name"])[1]


@query("q13_drop_incomplete", "o_orderkey:i price:2 cust:i", f"WITH {HOLES} SELECT o_orderkey, price, cust FROM ho WHERE price IS NOT NULL AND cust IS NOT NULL")
def q13(spark, sf):
    return Q.drop_incomplete(holes(spark, sf), ["price", "cust"])
