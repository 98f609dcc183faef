"""Statistical profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.period import season_label
from ..operators import gram as G
from ..operators import linear as L
from ..operators import profile as P
from ..operators.quality import outliers_iqr
from ..plans.panels import LINE_FEATURES, events_hour, line_rows, month_series, nation_aligned, nation_panel, table
from .common import EVENTS_HOUR, LINE_ROWS, MONTH_SERIES, NATION_ALIGNED, NATION_MONTH, query

COLS = ["l_quantity", "l_extendedprice", "unit_price", "s_acctbal", "target"]
LONG = " UNION ALL ".join(f"SELECT '{c}' AS variable, {c} AS value FROM lr" for c in COLS)
MOMENTS = """mu AS (SELECT variable, avg(value) AS m FROM lg GROUP BY 1),
mo AS (SELECT variable, count(*) AS n, avg((value-m)**3)/avg((value-m)**2)**1.5 AS skewness, avg((value-m)**4)/avg((value-m)**2)**2 - 3 AS kurtosis FROM lg JOIN mu USING (variable) GROUP BY 1)"""


@query("d1_distribution_profile", "variable:s n:i skewness:6 kurtosis:6 skew_label:s kurt_label:s jarque_bera:2 jb_p:6 is_normal:b distribution_type:s", f"""
WITH {LINE_ROWS}, lg AS ({LONG}), {MOMENTS}, jb AS (SELECT *, n/6.0*(skewness**2 + kurtosis**2/4) AS jarque_bera FROM mo)
SELECT *, CASE WHEN abs(skewness) < .5 THEN 'Approximately symmetric' WHEN skewness > 0 THEN 'Right-skewed' ELSE 'Left-skewed' END AS skew_label,
 CASE WHEN abs(kurtosis) < .5 THEN 'Mesokurtic' WHEN kurtosis > 0 THEN 'Leptokurtic' ELSE 'Platykurtic' END AS kurt_label, exp(-jarque_bera/2) AS jb_p, exp(-jarque_bera/2) > .05 AS is_normal,
 CASE WHEN exp(-jarque_bera/2) > .05 THEN 'Normal/Gaussian' WHEN skewness > 1 THEN 'Log-normal or Exponential' WHEN skewness < -1 THEN 'Left-skewed (consider reflection)' ELSE 'Non-normal (consider transformation)' END AS distribution_type FROM jb""")
def d1(spark, sf):
    return P.distribution_profile(line_rows(spark, sf), COLS)


@query("d2_normality_ks", "variable:s statistic:6 p_value:6 is_normal:b")
def d2(spark, sf):
    return P.normality_ks(line_rows(spark, sf).select("target", "l_quantity"), ["target", "l_quantity"])


@query("d3_trend_test", "n_name:s n:i slope:4 r2:8", f"""
WITH {NATION_MONTH} SELECT n_name, count(*) AS n, regr_slope(y, year(period)*12+month(period)) AS slope, regr_r2(y, year(period)*12+month(period)) AS r2 FROM nm GROUP BY 1""")
def d3(spark, sf):
    return P.trend_test(nation_panel(spark, sf), ["y"], ["n_name"])


@query("d3_trend_verdict", "variable:s n:i p_value:6 has_trend:b")
def d3b(spark, sf):
    return P.trend_test(month_series(spark, sf), ["y", "n_orders", "n_cust", "avg_price"])


@query("d4_adf_test", "n_name:s n:i lags:i statistic:6 is_stationary:b")
def d4(spark, sf):
    return P.adf_test(nation_aligned(spark, sf), "y", ["n_name"])


@query("d4_df_test", "n_name:s n:i lags:i statistic:6 is_stationary:b", f"""
WITH {NATION_ALIGNED}, dl AS (SELECT n_name, y - lag(y) OVER w AS d, lag(y) OVER w AS l FROM na WINDOW w AS (PARTITION BY n_name ORDER BY ord)),
r AS (SELECT n_name, count(*) AS n, regr_slope(d, l) AS b, regr_sxx(d, l) AS sxx, regr_syy(d, l) AS syy FROM dl WHERE d IS NOT NULL GROUP BY 1)
SELECT n_name, n, 0 AS lags, b/sqrt((syy - b*b*sxx)/(n - 2)/sxx) AS statistic, b/sqrt((syy - b*b*sxx)/(n - 2)/sxx) < -2.86 AS is_stationary FROM r""")
def d4b(spark, sf):
    return P.adf_test(nation_aligned(spark, sf), "y", ["n_name"], lags=0)


def _kpss(src, key, val, lags=4):
    k = f"PARTITION BY {key} " if key else ""
    g = "GROUP BY 1" if key else ""
    sel = f"{key}," if key else ""
    prods = ", ".join(f"e*lag(e,{i}) OVER o AS p{i}" for i in range(1, lags + 1))
    var = " + ".join(["sum(e*e)", *[f"2*(1-{i}/{lags + 1}.0)*coalesce(sum(p{i}),0)" for i in range(1, lags + 1)]])
    return f"""
de AS (SELECT {sel} ord, {val} - avg({val}) OVER ({k}) AS e FROM {src}),
cu AS (SELECT *, sum(e) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s, {prods} FROM de WINDOW o AS ({k}ORDER BY ord)),
kp AS (SELECT {sel} count(*) AS n, sum(s*s)/(count(*)*({var})) AS statistic FROM cu {g})"""


KP = """CASE WHEN statistic <= .347 THEN .10 WHEN statistic <= .463 THEN .10 + (statistic-.347)*((.05-.10)/(.463-.347)) WHEN statistic <= .574 THEN .05 + (statistic-.463)*((.025-.05)/(.574-.463))
 WHEN statistic <= .739 THEN .025 + (statistic-.574)*((.01-.025)/(.739-.574)) ELSE .01 END"""


@query("d5_kpss_test", "event_type:s n:i statistic:6 p_value:6 is_stationary:b", f"""
WITH {EVENTS_HOUR}, sp AS (SELECT unnest(generate_series((SELECT min(period) FROM eh), (SELECT max(period) FROM eh), INTERVAL 1 HOUR)) AS period),
al AS (SELECT k.event_type, CAST(floor(epoch(sp.period)/3600) AS BIGINT) AS ord, coalesce(eh.n, 0) AS v FROM (SELECT DISTINCT event_type FROM eh) k CROSS JOIN sp LEFT JOIN eh ON eh.event_type = k.event_type AND eh.period = sp.period),
{_kpss('al', 'event_type', 'v')} SELECT *, {KP} AS p_value, {KP} > .05 AS is_stationary FROM kp""")
def d5(spark, sf):
    return P.kpss_test(hours(spark, sf), "n", ["event_type"], lags=4)


def hours(spark, sf):
    from ..operators.calendar import align_to_spine

    return align_to_spine(events_hour(spark, sf), ["event_type"], "hour").na.fill(0.0, ["n"])


@query("d5_kpss_test_auto", "event_type:s n:i lags:i statistic:6 p_value:6 is_stationary:b", f"""
WITH {EVENTS_HOUR}, sp AS (SELECT unnest(generate_series((SELECT min(period) FROM eh), (SELECT max(period) FROM eh), INTERVAL 1 HOUR)) AS period),
al AS (SELECT k.event_type, CAST(floor(epoch(sp.period)/3600) AS BIGINT) AS ord, coalesce(eh.n, 0) AS v FROM (SELECT DISTINCT event_type FROM eh) k CROSS JOIN sp LEFT JOIN eh ON eh.event_type = k.event_type AND eh.period = sp.period),
de AS (SELECT event_type, ord, v - avg(v) OVER (PARTITION BY event_type) AS e FROM al),
nn AS (SELECT event_type, count(*) AS n, sum(e*e) AS p0 FROM de GROUP BY 1),
pr AS (SELECT a.event_type, a.ord - b.ord AS k, sum(a.e*b.e) AS p FROM de a JOIN de b ON a.event_type = b.event_type AND a.ord - b.ord BETWEEN 1 AND 200 GROUP BY ALL),
se AS (SELECT event_type, n, p0, p0/n + coalesce(sum(p/(n/2.0)) FILTER (k <= floor(pow(n, 2/9.0))), 0) AS s0, coalesce(sum(k*p/(n/2.0)) FILTER (k <= floor(pow(n, 2/9.0))), 0) AS s1 FROM nn JOIN pr USING (event_type) GROUP BY event_type, n, p0),
lg AS (SELECT event_type, n, p0, least(CAST(floor(1.1447*pow(s1/s0*s1/s0, 1/3.0)*pow(n, 1/3.0)) AS BIGINT), n - 1) AS lags FROM se),
vr AS (SELECT event_type, n, lags, p0 + coalesce(sum(2*(1 - k/(lags + 1.0))*p) FILTER (k <= lags), 0) AS var FROM lg JOIN pr USING (event_type) GROUP BY event_type, n, lags, p0),
cu AS (SELECT event_type, sum(e) OVER (PARTITION BY event_type ORDER BY ord) AS s FROM de),
kp AS (SELECT event_type, n, lags, sum(s*s)/(n*var) AS statistic FROM cu JOIN vr USING (event_type) GROUP BY event_type, n, lags, var)
SELECT *, {KP} AS p_value, {KP} > .05 AS is_stationary FROM kp""")
def d5b(spark, sf):
    """The number of lags comes from the data."""
    return P.kpss_test(hours(spark, sf), "n", ["event_type"])


FEATS = [*LINE_FEATURES, "target"]
PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, corr({a}, {b}) AS correlation FROM lr" for a in FEATS for b in FEATS)


@query("d6_correlation_matrix", "var1:s var2:s correlation:6", f"WITH {LINE_ROWS} {PAIRS}")
def d6(spark, sf):
    return G.correlation_matrix(line_rows(spark, sf), FEATS)


DIMS = 64   # of the vectors in embeddings
WIDE = " UNION ALL ".join(f"SELECT 'e{a}' AS var1, 'e{b}' AS var2, corr(e{a}, e{b}) AS correlation FROM ev" for a in range(DIMS) for b in range(DIMS))


@query("d6_correlation_embeddings", "var1:s var2:s correlation:6", f"WITH ev AS (SELECT {', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}' for i in range(DIMS))} FROM embeddings) {WIDE}")
def d6b(spark, sf):
    e = table(spark, sf, "embeddings").select(*[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(DIMS)])
    return G.correlation_matrix(e, e.columns, engine="arrow")


@query("d6_correlation_wide", "var1:s y:6 n_orders:6 n_cust:6 avg_price:6", f"WITH {MONTH_SERIES} " + " UNION ALL ".join(
    f"SELECT '{a}' AS var1, " + ", ".join(f"corr({a}, {b}) AS {b}" for b in ("y", "n_orders", "n_cust", "avg_price")) + " FROM ms" for a in ("y", "n_orders", "n_cust", "avg_price")))
def d6c(spark, sf):
    return G.correlation_wide(month_series(spark, sf), ["y", "n_orders", "n_cust", "avg_price"])


@query("d7_high_correlations", "var1:s var2:s correlation:6 strength:s", f"""
WITH {LINE_ROWS}, p AS ({" UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, corr({a}, {b}) AS correlation FROM lr" for i, a in enumerate(FEATS) for b in FEATS[i + 1:])})
SELECT *, CASE WHEN abs(correlation) > .9 THEN 'Very High' ELSE 'High' END AS strength FROM p WHERE abs(correlation) > .4""")
def d7(spark, sf):
    return G.high_correlations(G.correlation_matrix(line_rows(spark, sf), FEATS), 0.4, FEATS)


@query("d8_vif_uncentered", "variable:s vif:6 band:s")
def d8(spark, sf):
    return L.vif_uncentered(line_rows(spark, sf), LINE_FEATURES)


@query("d8_vif_uncentered_pair", "variable:s vif:6", f"""
WITH {LINE_ROWS}, s AS (SELECT sum(l_quantity*l_quantity) AS aa, sum(p_size*p_size) AS bb, sum(l_quantity*p_size) AS ab FROM lr)
SELECT unnest(['l_quantity','p_size']) AS variable, 1/(1 - ab*ab/(aa*bb)) AS vif FROM s""")
def d8b(spark, sf):
    return L.vif_uncentered(line_rows(spark, sf), ["l_quantity", "p_size"])


@query("d9_seasonal_stats", "season:s mean:4 std:4 min:2 max:2 count:i", "SELECT 'Q' || quarter(o_orderdate) AS season, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max, count(*) AS count FROM orders GROUP BY 1")
def d9(spark, sf):
    return P.seasonal_stats(table(spark, sf, "orders"), "o_totalprice", season_label(F.col("o_orderdate")))


@query("d10_seasonal_anova", "n:i k:i f_statistic:6", """
WITH g AS (SELECT quarter(o_orderdate) AS q, count(*) AS c, avg(o_totalprice) AS m, var_pop(o_totalprice)*count(*) AS ss FROM orders GROUP BY 1), t AS (SELECT avg(o_totalprice) AS gm FROM orders)
SELECT sum(c) AS n, count(*) AS k, (sum(c*(m-gm)**2)/(count(*)-1))/(sum(ss)/(sum(c)-count(*))) AS f_statistic FROM g, t""")
def d10(spark, sf):
    return P.seasonal_anova(table(spark, sf, "orders"), "o_totalprice", season_label(F.col("o_orderdate")))


@query("d10_seasonal_anova_p", "c_mktsegment:s f_statistic:6 p_value:6 is_seasonal:b")
def d10b(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return P.seasonal_anova(rows, "o_totalprice", season_label(F.col("o_orderdate")), ["c_mktsegment"])


@query("d11_profile_findings", "section:s variable:s finding:s")
def d11(spark, sf):
    panel = month_series(spark, sf)
    cols = ["y", "n_orders", "n_cust", "avg_price"]
    station = None
    for c in cols:
        one = P.adf_test(panel, c).withColumn("variable", F.lit(c)).select("variable", "is_stationary")
        station = one if station is None else station.unionByName(one)
    return P.profile_findings(P.distribution_profile(panel, cols), outliers_iqr(panel, cols), station, P.trend_test(panel, cols), G.correlation_matrix(panel, cols), cols)
