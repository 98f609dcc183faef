"""Feature selection (X2–X3, L, N, T, R, E, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import consensus as C
from ..operators import embedded as E
from ..operators import filters as T
from ..operators import gram as G
from ..operators import linear as L
from ..operators import neighbours as K
from ..operators import wrappers as R
from ..operators.folds import fold_plan, period_axis
from ..plans.panels import LINE_FEATURES, line_rows, nation_panel
from ..plans.selection import run_all_fs
from .common import LINE_ROWS, NATION_MONTH, folds_sql, query

LINE_IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def line_plan(rows, min_train=40, test=4):
    return fold_plan(period_axis(rows), min_train, test)


GC = ["1.0", "l_quantity", "l_discount", "target"]


@query("x2_gram", "ord:i i:i j:i v:6", f"WITH {LINE_ROWS} " + " UNION ALL ".join(
    f"SELECT ord, {i} AS i, {j} AS j, sum(({GC[i]})*({GC[j]})) AS v FROM lr GROUP BY 1" for i in range(4) for j in range(i, 4)))
def x2(spark, sf):
    return G.gram(line_rows(spark, sf), ["l_quantity", "l_discount", "target"], ["ord"], center=False).table


@query("x2_gram_arrow", "p_brand:s i:i j:i v:6", f"WITH {LINE_ROWS} " + " UNION ALL ".join(
    f"SELECT p_brand, {i} AS i, {j} AS j, sum(({GC[i]})*({GC[j]})) AS v FROM lr GROUP BY 1" for i in range(4) for j in range(i, 4)))
def x2b(spark, sf):
    return G.gram(line_rows(spark, sf), ["l_quantity", "l_discount", "target"], ["p_brand"], engine="arrow", center=False).table


@query("x3_prefix_gram", "train_end_ord:i n:i mean_x:8 mean_y:8 sxy:4", f"""
WITH {LINE_ROWS}, {folds_sql('lr', 40)}, w AS (SELECT DISTINCT train_start_ord, train_end_ord FROM pl)
SELECT train_end_ord, count(*) AS n, avg(l_quantity) AS mean_x, avg(target) AS mean_y, covar_pop(l_quantity, target)*count(*) AS sxy FROM lr JOIN w ON ord BETWEEN train_start_ord AND train_end_ord GROUP BY 1""")
def x3(spark, sf):
    import pandas as pd

    rows = line_rows(spark, sf)
    g = G.prefix_gram(rows, ["l_quantity", "target"], G.windows_of(line_plan(rows)))

    def fn(key, m):
        return pd.DataFrame([[key[1], int(m.n), m.mean[0], m.mean[1], m.cross[0, 1]]], columns=["train_end_ord", "n", "mean_x", "mean_y", "sxy"])

    return G.per_group(g, fn, "train_end_ord bigint, n bigint, mean_x double, mean_y double, sxy double")


@query("l1_vif", "feature:s vif:6")
def l1(spark, sf):
    return L.vif(line_rows(spark, sf), LINE_FEATURES)


@query("l1_vif_pair_by_brand", "p_brand:s feature:s vif:6", f"""
WITH {LINE_ROWS} SELECT p_brand, unnest(['l_extendedprice','unit_price']) AS feature, 1/(1 - corr(l_extendedprice, unit_price)**2) AS vif FROM lr GROUP BY 1""")
def l1b(spark, sf):
    return L.vif(line_rows(spark, sf), ["l_extendedprice", "unit_price"], ["p_brand"])


@query("l2_vif_filter", "iteration:i feature:s vif:6 removed:b selected:b")
def l2(spark, sf):
    rows = line_rows(spark, sf).withColumn("gross", F.col("l_extendedprice") * (1 + F.col("l_tax"))).withColumn("twice", 2 * F.col("l_quantity"))
    return L.vif_filter(rows, [*LINE_FEATURES, "gross", "twice"], 4.0)


@query("l3_ridge_stability", "feature:s stability:6 avg_coefficient:6 std_coefficient:6 n_folds_selected:i n_folds_total:i fallback:b selected:b")
def l3(spark, sf):
    rows = line_rows(spark, sf)
    return L.ridge_stability(rows, LINE_FEATURES, "target", line_plan(rows))


@query("l4_elasticnet_stability", "feature:s stability:6 avg_coefficient:6 std_coefficient:6 n_folds_selected:i n_folds_total:i fallback:b selected:b")
def l4(spark, sf):
    rows = line_rows(spark, sf)
    return L.elasticnet_stability(rows, LINE_FEATURES, "target", line_plan(rows), alpha=0.05)


@query("l5_fs_linear", "method:s feature:s score:6 selected:b")
def l5(spark, sf):
    rows = line_rows(spark, sf)
    return L.fs_linear(rows, LINE_FEATURES, "target", line_plan(rows))


@query("n1_rf_importance_folds", "method:s feature:s mean_importance:6 std_importance:6 min_importance:6 max_importance:6 selected:b")
def n1(spark, sf):
    rows = line_rows(spark, sf)
    return E.importance_over_folds(E.fold_importances(rows, LINE_FEATURES, "target", line_plan(rows), "random_forest"), "rf_importance")


@query("n2_gbt_importance_folds", "method:s feature:s mean_importance:6 std_importance:6 min_importance:6 max_importance:6 selected:b")
def n2(spark, sf):
    rows = line_rows(spark, sf)
    return E.importance_over_folds(E.fold_importances(rows, LINE_FEATURES, "target", line_plan(rows), "gbt"), "gbt_importance", "relative")


@query("n3_boruta", "feature:s hits:i rounds:i p_value:6 verdict:s selected:b")
def n3(spark, sf):
    return E.boruta(line_rows(spark, sf), LINE_FEATURES, "target", LINE_IDS)


@query("n4_fs_nonlinear", "method:s feature:s score:6 selected:b")
def n4(spark, sf):
    rows = line_rows(spark, sf)
    return E.fs_nonlinear(rows, LINE_FEATURES, "target", line_plan(rows))


RANKED = ", ".join(f"rank() OVER (ORDER BY {c}) - 1 AS b_{c}, count(*) OVER (PARTITION BY {c}) AS t_{c}" for c in [*LINE_FEATURES, "target"])
BIN = lambda c: f"CAST(floor(16*(2*b_{c} + t_{c} - 1)/(2*n)) AS BIGINT)"
CELLS = " UNION ALL ".join(f"SELECT '{c}' AS feature, {BIN(c)} AS bx, {BIN('target')} AS bz, count(*) AS c FROM rk GROUP BY ALL" for c in LINE_FEATURES)


@query("t1_mutual_info", "feature:s mi_score:8 mi_normalized:8 selected:b", f"""
WITH {LINE_ROWS}, rk AS (SELECT {RANKED}, count(*) OVER () AS n FROM lr), c AS ({CELLS}),
p AS (SELECT *, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, bx) AS px, sum(c) OVER (PARTITION BY feature, bz) AS py FROM c),
m AS (SELECT feature, sum(c/n*ln(c*n/(px*py))) AS mi_score FROM p GROUP BY 1)
SELECT *, mi_score/max(mi_score) OVER () AS mi_normalized, row_number() OVER (ORDER BY mi_score DESC) <= 5 AS selected FROM m""")
def t1(spark, sf):
    return T.mutual_info(line_rows(spark, sf), LINE_FEATURES, "target", top_k=5)


MI = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(floor({e}) AS BIGINT) AS bx, CAST(floor(target*4) AS BIGINT) AS bz FROM lr" for c, e in (
    ("l_quantity", "l_quantity/5"), ("l_discount", "l_discount*100 + 0.5"), ("unit_price", "unit_price/100"), ("p_size", "p_size/10")))


@query("t1_mutual_info_binned", "feature:s mi_score:8 mi_normalized:8 selected:b", f"""
WITH {LINE_ROWS}, b AS ({MI}), c AS (SELECT feature, bx, bz, count(*) AS c FROM b GROUP BY ALL),
p AS (SELECT *, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, bx) AS px, sum(c) OVER (PARTITION BY feature, bz) AS py FROM c),
m AS (SELECT feature, sum(c/n*ln(c*n/(px*py))) AS mi_score FROM p GROUP BY 1)
SELECT *, mi_score/max(mi_score) OVER () AS mi_normalized, row_number() OVER (ORDER BY mi_score DESC) <= 2 AS selected FROM m""")
def t1b(spark, sf):
    rows = line_rows(spark, sf)
    y = F.floor(F.col("target") * 4)
    cell = lambda n, e: F.struct(F.lit(n).alias("feature"), F.floor(e).alias("bx"), y.alias("by"))
    cells = rows.select(F.inline(F.array(cell("l_quantity", F.col("l_quantity") / 5), cell("l_discount", F.col("l_discount") * 100 + 0.5),
                                         cell("unit_price", F.col("unit_price") / 100), cell("p_size", F.col("p_size") / 10))))
    return T.mutual_info_binned(cells.groupBy("feature", "bx", "by").agg(F.count(F.lit(1)).alias("c")), 2)


@query("t1_mutual_info_neighbours", "feature:s mi_score:8 mi_normalized:8 selected:b")
def t1n(spark, sf):
    return K.mutual_info_neighbours(line_rows(spark, sf), LINE_FEATURES, "target", top_k=5)


LATTICE = " UNION ALL ".join(f"SELECT '{c}' AS feature, row_number() OVER () AS i, CAST(round(({c} - m_{c})/s_{c}*4294967296) AS BIGINT) AS x, CAST(round((y - m_y)/s_y*4294967296) AS BIGINT) AS z FROM st" for c in ("n_orders", "avg_price"))


@query("t1_mutual_info_neighbours_panel", "feature:s mi_score:6 mi_normalized:6 selected:b", f"""
WITH {NATION_MONTH}, st AS (SELECT *, {', '.join(f'avg({c}) OVER () AS m_{c}, stddev_pop({c}) OVER () AS s_{c}' for c in ('n_orders', 'avg_price', 'y'))} FROM nm),
p AS ({LATTICE}), d AS (SELECT a.feature, a.i, greatest(abs(a.x - b.x), abs(a.z - b.z)) AS d FROM p a JOIN p b ON a.feature = b.feature AND a.i <> b.i),
k AS (SELECT feature, i, list_sort(min(d, 3))[3] AS rho FROM d GROUP BY ALL),
w AS (SELECT a.feature, a.i, any_value(rho) AS rho, count(*) AS n, count(*) FILTER (abs(a.x - b.x) < rho OR rho = 0 AND a.x = b.x) AS nx,
      count(*) FILTER (abs(a.z - b.z) < rho OR rho = 0 AND a.z = b.z) AS nz, count(*) FILTER (a.x = b.x AND a.z = b.z) AS c
      FROM p a JOIN k ON a.feature = k.feature AND a.i = k.i JOIN p b ON a.feature = b.feature GROUP BY 1, 2),
h AS (SELECT m, sum(CASE WHEN m > 1 THEN 1.0/(m - 1) ELSE 0.0 END) OVER (ORDER BY m) AS psi FROM (SELECT unnest(range(1, (SELECT max(n) + 1 FROM w))) AS m)),
e AS (SELECT w.feature, greatest(0.0, avg(hk.psi + hn.psi - hx.psi - hz.psi)) AS mi_score FROM w JOIN h hk ON hk.m = CASE WHEN rho = 0 THEN c - 1 ELSE 3 END
      JOIN h hn ON hn.m = w.n JOIN h hx ON hx.m = w.nx JOIN h hz ON hz.m = w.nz GROUP BY 1)
SELECT *, mi_score/max(mi_score) OVER () AS mi_normalized, row_number() OVER (ORDER BY mi_score DESC, feature) <= 1 AS selected FROM e""")
def t1np(spark, sf):
    return K.mutual_info_neighbours(nation_panel(spark, sf), ["n_orders", "avg_price"], "y", top_k=1)


CORR = " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS n, corr({c}, target) AS correlation FROM lr" for c in LINE_FEATURES)


@query("t2_f_test", "feature:s f_score:4 selected:b", f"""
WITH {LINE_ROWS}, c AS ({CORR}), f AS (SELECT *, correlation**2*(n-2)/(1-correlation**2) AS f_score FROM c)
SELECT feature, f_score, row_number() OVER (ORDER BY f_score DESC, feature) <= 8 AS selected FROM f""")
def t2(spark, sf):
    return T.f_test(line_rows(spark, sf), LINE_FEATURES, "target", top_k=8)


@query("t2_f_test_p", "feature:s p_value:6 significant:b")
def t2b(spark, sf):
    return T.f_test(line_rows(spark, sf), LINE_FEATURES, "target")


@query("t3_correlation_pearson", "feature:s n:i correlation:6 abs_correlation:6 selected:b", f"WITH {LINE_ROWS}, c AS ({CORR}) SELECT *, abs(correlation) AS abs_correlation, abs(correlation) >= .3 AS selected FROM c")
def t3(spark, sf):
    return T.correlation_select(line_rows(spark, sf), LINE_FEATURES, "target")


SP = ["l_quantity", "unit_price", "l_discount", "p_size"]
RANK = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1)/2.0 AS r_{c}" for c in [*SP, "target"])


@query("t4_correlation_spearman", "feature:s n:i correlation:6 selected:b", f"""
WITH {LINE_ROWS}, rk AS (SELECT {RANK} FROM lr), c AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS n, corr(r_{c}, r_target) AS correlation FROM rk" for c in SP)})
SELECT *, row_number() OVER (ORDER BY abs(correlation) DESC) <= 2 AS selected FROM c""")
def t4(spark, sf):
    return T.correlation_select(line_rows(spark, sf), SP, "target", top_k=2, method="spearman")


@query("t5_variance_threshold", "feature:s variance:6 selected:b", f"""
WITH {LINE_ROWS}, v AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, var_samp({c})/(max({c}) - min({c}))**2 AS variance FROM lr" for c in LINE_FEATURES)}) SELECT *, variance >= .083 AS selected FROM v""")
def t5(spark, sf):
    return T.variance_threshold(line_rows(spark, sf), LINE_FEATURES, 0.083)


@query("t6_run_filters", "category:s method:s feature:s score:4 selected:b")
def t6(spark, sf):
    return T.run_filters(line_rows(spark, sf), LINE_FEATURES, "target", 5)


@query("r1_rfe_ridge", "feature:s ranking:i selected:b")
def r1(spark, sf):
    return R.rfe_ridge(line_rows(spark, sf), LINE_FEATURES, "target", 4)


@query("r2_rfe_forest", "feature:s ranking:i selected:b")
def r2(spark, sf):
    return R.rfe_forest(line_rows(spark, sf), LINE_FEATURES, "target", 6)


ONE_BY_ONE = f"""{LINE_ROWS}, ax AS (SELECT ord, ntile(5) OVER (ORDER BY ord) - 1 AS b FROM (SELECT DISTINCT ord FROM lr)),
x AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x, target AS t, b FROM lr JOIN ax USING (ord)" for c in LINE_FEATURES)}),
g AS (SELECT feature, k.b AS fold, avg(x) AS mx, avg(t) AS mt, covar_pop(x, t)*count(*) AS sxy, var_pop(x)*count(*) AS sxx FROM x JOIN (SELECT DISTINCT b FROM ax) k ON x.b <> k.b GROUP BY 1, 2),
m AS (SELECT x.feature, x.b, avg(abs(t - (mt + sxy/(sxx + 1)*(x - mx)))) AS mae FROM x JOIN g ON x.feature = g.feature AND x.b = g.fold GROUP BY 1, 2),
sc AS (SELECT feature, avg(mae) AS mean_mae, stddev_pop(mae) AS std_mae FROM m GROUP BY 1)"""


@query("r3_forward_select_one", "feature:s selected:b step:i mae:6", f"""
WITH {ONE_BY_ONE}, r AS (SELECT *, row_number() OVER (ORDER BY mean_mae) = 1 AS best FROM sc) SELECT feature, best AS selected, CASE WHEN best THEN 1 ELSE 0 END AS step, CASE WHEN best THEN mean_mae END AS mae FROM r""")
def r3b(spark, sf):
    return R.sequential_select(line_rows(spark, sf), LINE_FEATURES, "target", 1)


@query("r5_exhaustive_one", "features:s n_features:i mean_score:6 std_score:6 selected:b", f"""
WITH {ONE_BY_ONE} SELECT feature AS features, 1 AS n_features, -mean_mae AS mean_score, std_mae AS std_score, row_number() OVER (ORDER BY mean_mae) = 1 AS selected FROM sc""")
def r5b(spark, sf):
    out = R.exhaustive_select(line_rows(spark, sf), LINE_FEATURES, "target", 1, 1)
    return out.withColumn("features", F.concat_ws(",", "features"))


@query("r3_forward_select", "feature:s selected:b step:i mae:6")
def r3(spark, sf):
    return R.sequential_select(line_rows(spark, sf), LINE_FEATURES, "target", 4)


@query("r4_backward_select", "feature:s selected:b step:i mae:6")
def r4(spark, sf):
    return R.sequential_select(line_rows(spark, sf), LINE_FEATURES, "target", 6, "backward")


@query("r5_exhaustive_select", "features:s n_features:i mean_score:6 std_score:6 selected:b")
def r5(spark, sf):
    out = R.exhaustive_select(line_rows(spark, sf), LINE_FEATURES, "target")
    return out.withColumn("features", F.concat_ws(",", "features"))


@query("r6_run_wrappers", "category:s method:s feature:s score:6 selected:b")
def r6(spark, sf):
    return R.run_wrappers(line_rows(spark, sf), LINE_FEATURES, "target", 7)


@query("e1_lasso_select", "feature:s coefficient:6 abs_coefficient:6 alpha:8 selected:b")
def e1(spark, sf):
    return E.lasso_select(line_rows(spark, sf), LINE_FEATURES, "target")


@query("e2_elasticnet_select", "feature:s coefficient:6 abs_coefficient:6 alpha:8 selected:b")
def e2(spark, sf):
    return E.elasticnet_select(line_rows(spark, sf), LINE_FEATURES, "target")


@query("e3_gbt_select", "feature:s importance:6 selected:b")
def e3(spark, sf):
    return E.tree_select(line_rows(spark, sf), LINE_FEATURES, "target", "gbt", 4)


@query("e4_rf_select", "feature:s importance:6 selected:b")
def e4(spark, sf):
    return E.tree_select(line_rows(spark, sf), LINE_FEATURES, "target", "random_forest", threshold=0.05)


@query("e5_run_embedded", "category:s method:s feature:s score:6 selected:b")
def e5(spark, sf):
    return E.run_embedded(line_rows(spark, sf), LINE_FEATURES, "target", 5)


# fold importances |corr| on the train window, the input of the consensus queries
IMP = f"""{LINE_ROWS}, {folds_sql('lr', 40)}, im AS ({" UNION ALL ".join(f"SELECT fold_id, horizon, '{c}' AS feature, abs(corr({c}, target)) AS importance FROM lr JOIN pl ON ord BETWEEN train_start_ord AND train_end_ord GROUP BY 1, 2" for c in LINE_FEATURES)})"""


def correlation_importances(spark, sf):
    """Per fold and feature |corr(feature, target)| from one scan."""
    import pandas as pd

    rows = line_rows(spark, sf)
    plan = line_plan(rows)
    g = G.prefix_gram(rows, [*LINE_FEATURES, "target"], G.windows_of(plan))

    def fn(key, m):
        r = m.corr()[:-1, -1]
        return pd.DataFrame({"train_start_ord": key[0], "train_end_ord": key[1], "feature": LINE_FEATURES, "importance": abs(r)})

    imp = G.per_group(g, fn, "train_start_ord bigint, train_end_ord bigint, feature string, importance double")
    return plan.select("fold_id", "horizon", "train_start_ord", "train_end_ord").join(imp, ["train_start_ord", "train_end_ord"])


# selections: by fold-mean importance, by Pearson threshold, by variance
SEL = f"""{IMP}, se AS (
 SELECT 'mean' AS method, 'filter' AS category, feature, avg(importance) > .02 AS selected FROM im GROUP BY feature
 UNION ALL SELECT 'best', 'wrapper', feature, max(importance) > .1 FROM im GROUP BY feature
 UNION ALL SELECT 'worst', 'embedded', feature, min(importance) > .3 FROM im GROUP BY feature
 UNION ALL SELECT 'spread', 'embedded', feature, max(importance) - min(importance) > .01 FROM im GROUP BY feature)"""


def selections(spark, sf):
    imp = correlation_importances(spark, sf).groupBy("feature").agg(
        F.avg("importance").alias("a"), F.max("importance").alias("b"), F.min("importance").alias("c"))
    row = lambda m, cat, ok: F.struct(F.lit(m).alias("method"), F.lit(cat).alias("category"), F.col("feature"), ok.alias("selected"))
    return imp.select(F.inline(F.array(
        row("mean", "filter", F.col("a") > 0.02), row("best", "wrapper", F.col("b") > 0.1),
        row("worst", "embedded", F.col("c") > 0.3), row("spread", "embedded", F.col("b") - F.col("c") > 0.01))))


VOTES = f"""vo AS (SELECT feature, count(DISTINCT method) FILTER (selected) AS vote_count, count(DISTINCT category) FILTER (selected) AS n_categories,
 coalesce(array_to_string(list_sort(list(method) FILTER (selected)), ','), '') AS selected_by FROM se GROUP BY 1),
fl AS (SELECT unnest({LINE_FEATURES!r}) AS feature, unnest(range({len(LINE_FEATURES)})) AS pos)"""
STABLE = """st AS (SELECT feature, sum(i) AS top_k_count, avg(i) AS stability FROM (SELECT feature, CASE WHEN row_number() OVER (PARTITION BY fold_id ORDER BY importance DESC, feature) <= 3 THEN 1.0 ELSE 0 END AS i FROM im) GROUP BY 1)"""


@query("c1_vote_select", "feature:s vote_count:i selected_by:s selected:b", f"WITH {SEL}, {VOTES} SELECT *, vote_count >= 2 AS selected FROM vo")
def c1(spark, sf):
    out = C.vote_select(selections(spark, sf), C.feature_list(spark, LINE_FEATURES))
    return out.withColumn("selected_by", F.concat_ws(",", "selected_by"))


@query("c2_topk_stability", "feature:s top_k_count:i stability:6 selected:b", f"WITH {IMP}, {STABLE} SELECT *, stability >= .6 AS selected FROM st")
def c2(spark, sf):
    return C.topk_stability(correlation_importances(spark, sf), 3)


@query("c3_fs_consensus", "feature:s vote_count:i stability:6 selected:b fallback:b", f"""
WITH {SEL}, {VOTES}, {STABLE}, j AS (SELECT vo.feature, vote_count, stability, vote_count >= 2 AND stability >= .6 AS b FROM vo JOIN st USING (feature)), n AS (SELECT count(*) FILTER (b) AS n FROM j)
SELECT feature, vote_count, stability, CASE WHEN n >= 3 THEN b ELSE vote_count >= 3 OR stability >= .7 END AS selected, n < 3 AS fallback FROM j, n""")
def c3(spark, sf):
    votes = C.vote_select(selections(spark, sf), C.feature_list(spark, LINE_FEATURES))
    return C.fs_consensus(votes, C.topk_stability(correlation_importances(spark, sf), 3))


@query("c4_fs_hybrid", "feature:s n_categories:i vote_count:i vote_pct:6 selected:b", f"""
WITH {SEL}, {VOTES}, h AS (SELECT fl.feature, pos, n_categories, vote_count, vote_count/4.0 AS vote_pct, n_categories = 3 OR vote_count >= 2 AS ok FROM vo JOIN fl USING (feature)), n AS (SELECT count(*) FILTER (ok) AS n FROM h)
SELECT *, ok OR (n < 3 AND row_number() OVER (ORDER BY ok DESC, vote_count DESC, pos) <= 3) AS selected FROM h, n""")
def c4(spark, sf):
    return C.fs_hybrid(selections(spark, sf), C.feature_list(spark, LINE_FEATURES))


@query("c5_options_summary", "fs_option:s n_features:i features:s", f"""
WITH {SEL}, {VOTES} SELECT category AS fs_option, count(*) AS n_features, string_agg(feature, ',' ORDER BY pos) AS features FROM (SELECT DISTINCT category, feature FROM se WHERE selected) JOIN fl USING (feature) GROUP BY 1""")
def c5(spark, sf):
    sel = selections(spark, sf)
    options = None
    for c in ("filter", "wrapper", "embedded"):
        one = C.option_union(sel.where(F.col("category") == c), c)
        options = one if options is None else options.unionByName(one)
    return C.options_summary(options, C.feature_list(spark, LINE_FEATURES)).withColumn("features", F.concat_ws(",", "features"))


@query("c5_run_all_fs", "fs_option:s n_features:i features:s")
def c5b(spark, sf):
    rows = line_rows(spark, sf)
    options, _ = run_all_fs(rows, LINE_FEATURES, "target", line_plan(rows), top_k=6)
    return C.options_summary(options, C.feature_list(spark, LINE_FEATURES)).withColumn("features", F.concat_ws(",", "features"))
