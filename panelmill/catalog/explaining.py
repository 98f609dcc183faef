"""Attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribute as A
from ..operators import decide as D
from ..operators import modelling as M
from ..plans.panels import LINE_FEATURES, line_rows
from ..plans.selection import fs_evaluation
from ..session import settle
from .common import LINE_ROWS, query
from .modelling import CUTS
from .selecting import IMP, LINE_IDS, correlation_importances, line_plan

FEATS = ["l_quantity", "unit_price"]
FIT = """
s AS (SELECT count(*) AS n, avg(l_quantity) AS m1, avg(unit_price) AS m2, stddev_pop(l_quantity) AS s1, stddev_pop(unit_price) AS s2,
 covar_pop(l_quantity, target)*count(*)/stddev_pop(l_quantity) AS c1, covar_pop(unit_price, target)*count(*)/stddev_pop(unit_price) AS c2, corr(l_quantity, unit_price)*count(*) AS r FROM lr),
b AS (SELECT *, (c1*(n+1) - c2*r)/((n+1)*(n+1) - r*r)/s1 AS b1, (c2*(n+1) - c1*r)/((n+1)*(n+1) - r*r)/s2 AS b2 FROM s),
ph AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, period, b1*(l_quantity - m1) AS phi_l_quantity, b2*(unit_price - m2) AS phi_unit_price FROM lr, b)"""
LONG = "lo AS (SELECT period, 'l_quantity' AS feature, abs(phi_l_quantity) AS a FROM ph UNION ALL SELECT period, 'unit_price', abs(phi_unit_price) FROM ph)"
# The regimes of the line-item table.
REGIMES = {"early": (None, "1997-01-01"), "middle": ("1997-01-01", "2000-01-01"), "late": ("2000-01-01", None)}


def attributed(spark, sf):
    rows = line_rows(spark, sf)
    return A.linear_shap(rows, FEATS, M.fit_final_ridge(rows, "target", FEATS))


@query("i1_linear_shap", "l_orderkey:i l_linenumber:i l_partkey:i l_suppkey:i phi_l_quantity:8 phi_unit_price:8", f"WITH {LINE_ROWS}, {FIT} SELECT * FROM ph")
def i1(spark, sf):
    return attributed(spark, sf)


@query("i1_linear_shap_all", "l_orderkey:i l_linenumber:i l_partkey:i l_suppkey:i " + " ".join(f"phi_{f}:6" for f in LINE_FEATURES))
def i1b(spark, sf):
    rows = line_rows(spark, sf)
    return A.linear_shap(rows, LINE_FEATURES, M.fit_final_ridge(rows, "target", LINE_FEATURES))


@query("i2_sampled_shapley", "feature:s importance:6 efficiency_gap:8")
def i2(spark, sf):
    """Attribution of a boosted model against sampled backgrounds; the gap to its prediction is taken from a second scoring."""
    rows = line_rows(spark, sf).select("period", *LINE_IDS, "target", *LINE_FEATURES)
    model = M.fit_tree(rows, "target", LINE_FEATURES, "gbt")
    phi = settle(model.transform(rows, "prediction").select(*LINE_IDS, "period", "prediction", *LINE_FEATURES))
    phi = A.sampled_shapley(phi, LINE_FEATURES, model, [*LINE_IDS, "period", "prediction"], 2)
    return with_gap(phi, F.col("f_background"))


def with_gap(phi, base):
    """Importances and the largest gap between a row's values with ``base`` and its prediction, from one pass that writes no value."""
    total = sum((F.col(f"phi_{f}") for f in LINE_FEATURES), base)
    sums = settle(A.abs_sums(phi, LINE_FEATURES, more=[F.max(F.abs(total - F.col("prediction"))).alias("g")]))
    return A.mean_abs_importance(None, LINE_FEATURES, sums=sums).withColumn("efficiency_gap", sums.agg(F.max("g").alias("g")).scalar())


@query("i2_tree_shapley", "feature:s importance:6 efficiency_gap:8")
def i2b(spark, sf):
    """Exact attribution of a boosted model for all rows; the gap of the values' sum to the prediction is 0."""
    rows = line_rows(spark, sf).select("target", *LINE_FEATURES)
    model = M.fit_tree(rows, "target", LINE_FEATURES, "gbt")
    return with_gap(A.tree_shap(model.transform(rows), LINE_FEATURES, model), F.lit(A.expected_value(model)))


@query("i2_tree_shapley_stump", "quarter:s importance:8 n_samples:i", f"""
WITH {LINE_ROWS}, cu AS (SELECT unnest({CUTS!r})::DOUBLE AS cut), wt AS (SELECT count(*) AS n, sum(target) AS s FROM lr),
wc AS (SELECT cut, count(*) AS nl, sum(target) AS sl FROM lr JOIN cu ON l_quantity <= cut GROUP BY 1),
st AS (SELECT * FROM wc, wt WHERE n > nl ORDER BY sl*sl/nl + (s-sl)*(s-sl)/(n-nl) DESC, cut LIMIT 1)
SELECT 'Q' || quarter(period) AS quarter, avg(abs(.1*(CASE WHEN l_quantity <= cut THEN sl/nl ELSE (s-sl)/(n-nl) END - s/n))) AS importance, count(*) AS n_samples FROM lr, st GROUP BY 1""")
def i2c(spark, sf):
    """A stump's values are its leaves less their mean."""
    rows = line_rows(spark, sf)
    model = M.fit_tree(rows, "target", ["l_quantity"], "gbt", cuts=[CUTS], rounds=1, depth=1)
    return A.importance_by_season(A.tree_shap(rows, ["l_quantity"], model), ["l_quantity"])


@query("i3_mean_abs_importance", "feature:s importance:8 n_samples:i importance_normalized:8", f"WITH {LINE_ROWS}, {FIT}, {LONG}, g AS (SELECT feature, avg(a) AS importance, count(*) AS n_samples FROM lo GROUP BY 1) SELECT *, importance/sum(importance) OVER () AS importance_normalized FROM g")
def i3(spark, sf):
    return A.mean_abs_importance(attributed(spark, sf), FEATS)


@query("i4_importance_by_regime_all", "regime:s feature:s importance:6 n_samples:i importance_normalized:6")
def i4b(spark, sf):
    rows = line_rows(spark, sf)
    return A.importance_by_regime(A.linear_shap(rows, LINE_FEATURES, M.fit_final_ridge(rows, "target", LINE_FEATURES)), LINE_FEATURES, REGIMES)


@query("i4_importance_by_regime", "regime:s feature:s importance:8 n_samples:i importance_normalized:8", f"""
WITH {LINE_ROWS}, {FIT}, {LONG}, g AS (SELECT CASE WHEN period < DATE '1997-01-01' THEN 'early' WHEN period < DATE '2000-01-01' THEN 'middle' ELSE 'late' END AS regime, feature, avg(a) AS importance, count(*) AS n_samples FROM lo GROUP BY 1, 2)
SELECT *, importance/sum(importance) OVER (PARTITION BY regime) AS importance_normalized FROM g WHERE n_samples >= 5""")
def i4(spark, sf):
    return A.importance_by_regime(attributed(spark, sf), FEATS, REGIMES)


@query("i5_importance_by_season", "quarter:s feature:s importance:8 n_samples:i importance_normalized:8", f"""
WITH {LINE_ROWS}, {FIT}, {LONG}, g AS (SELECT 'Q' || quarter(period) AS quarter, feature, avg(a) AS importance, count(*) AS n_samples FROM lo GROUP BY 1, 2)
SELECT *, importance/sum(importance) OVER (PARTITION BY quarter) AS importance_normalized FROM g WHERE n_samples >= 3""")
def i5(spark, sf):
    return A.importance_by_season(attributed(spark, sf), FEATS)


@query("i5_season_pivot", "feature:s Q1:8 Q2:8 Q3:8 Q4:8 mean:8", f"""
WITH {LINE_ROWS}, {FIT}, {LONG}, g AS (SELECT quarter(period) AS q, feature, avg(a) AS v FROM lo GROUP BY 1, 2)
SELECT feature, max(v) FILTER (q=1) AS "Q1", max(v) FILTER (q=2) AS "Q2", max(v) FILTER (q=3) AS "Q3", max(v) FILTER (q=4) AS "Q4", avg(v) AS mean FROM g GROUP BY 1""")
def i5b(spark, sf):
    return A.season_pivot(A.importance_by_season(attributed(spark, sf), FEATS))


KEY = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
TURNED = " UNION ALL ".join(
    f"SELECT {i} AS rep, target, l_quantity, unit_price, coalesce(lead(l_quantity) OVER w, first_value(l_quantity) OVER w) AS q, coalesce(lead(unit_price) OVER w, first_value(unit_price) OVER w) AS u "
    f"FROM kd WINDOW w AS (PARTITION BY bucket ORDER BY md5(concat_ws('|', k, '42', '{i}')), l_quantity, unit_price)" for i in range(10))


@query("i6_permutation_pair", "feature:s importance_mean:8 importance_std:8", f"""
WITH {LINE_ROWS}, {FIT}, kd AS (SELECT l_quantity, unit_price, target, {KEY} AS k, ('0x' || substr(md5({KEY}), 1, 8))::BIGINT % CAST(ceil((SELECT count(*) FROM lr)/4096.0) AS BIGINT) AS bucket FROM lr),
tu AS ({TURNED}), er AS (SELECT rep, b1, b2, q - l_quantity AS dq, u - unit_price AS du, target - (my + b1*(l_quantity - m1) + b2*(unit_price - m2)) AS e FROM tu, b, (SELECT avg(target) AS my FROM lr)),
ri AS (SELECT rep, avg(abs(e - b1*dq) - abs(e)) AS dq, avg(abs(e - b2*du) - abs(e)) AS du FROM er GROUP BY 1)
SELECT 'l_quantity' AS feature, avg(dq) AS importance_mean, stddev_pop(dq) AS importance_std FROM ri UNION ALL SELECT 'unit_price', avg(du), stddev_pop(du) FROM ri""")
def i6c(spark, sf):
    rows = line_rows(spark, sf)
    return A.permutation_importance(rows, FEATS, "target", M.fit_final_ridge(rows, "target", FEATS), LINE_IDS)


@query("i6_permutation_importance", "feature:s importance_mean:6 importance_std:6")
def i6(spark, sf):
    rows = line_rows(spark, sf)
    return A.permutation_importance(rows, LINE_FEATURES, "target", M.fit_final_ridge(rows, "target", LINE_FEATURES), LINE_IDS)


@query("i6_permutation_tree", "feature:s importance_mean:6 importance_std:6")
def i6b(spark, sf):
    rows = line_rows(spark, sf)
    return A.permutation_importance(rows, LINE_FEATURES, "target", M.fit_tree(rows, "target", LINE_FEATURES, "gbt"), LINE_IDS)


@query("i8_concentration_topk", "concentration:8", f"""
WITH {IMP}, m AS (SELECT feature, avg(importance) AS m FROM im WHERE horizon = 1 GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY m DESC) AS p FROM m) SELECT sum(m) FILTER (p <= 3)/sum(m) AS concentration FROM r""")
def i8(spark, sf):
    return A.concentration_topk(correlation_importances(spark, sf).where("horizon = 1"), 3)


@query("i9_fold_rank_correlation", "rank_correlation:8", f"""
WITH {IMP}, k AS (SELECT fold_id, feature, row_number() OVER (PARTITION BY fold_id ORDER BY importance) AS r FROM im WHERE horizon = 1),
c AS (SELECT a.fold_id, corr(a.r, b.r) AS r FROM k a JOIN k b ON b.fold_id = a.fold_id + 1 AND b.feature = a.feature GROUP BY 1) SELECT avg(r) AS rank_correlation FROM c""")
def i9(spark, sf):
    return A.fold_rank_correlation(correlation_importances(spark, sf).where("horizon = 1"))


@query("i10_fold_topk_jaccard", "topk_jaccard:8", f"""
WITH {IMP}, k AS (SELECT fold_id, feature FROM (SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY importance DESC, feature) AS p FROM im WHERE horizon = 1) WHERE p <= 5),
j AS (SELECT a.fold_id, count(*) AS c FROM k a JOIN k b ON b.fold_id = a.fold_id + 1 AND b.feature = a.feature GROUP BY 1),
f AS (SELECT DISTINCT fold_id FROM k WHERE fold_id + 1 IN (SELECT fold_id FROM k)) SELECT avg(coalesce(c, 0)/(10.0 - coalesce(c, 0))) AS topk_jaccard FROM f LEFT JOIN j USING (fold_id)""")
def i10(spark, sf):
    return A.fold_topk_jaccard(correlation_importances(spark, sf).where("horizon = 1"), 5)


OPTIONS = {"all": LINE_FEATURES, "price": ["l_extendedprice", "unit_price", "l_quantity"], "rates": ["l_discount", "l_tax", "l_extendedprice"],
           "calendar": ["doy_sin", "doy_cos", "l_quantity"]}
MATRIX = "fs_option:s n_features:i C1_accuracy:6 C2_stability:6 C3_shap_concentration:6 C4_shap_stability:6 C5_parsimony:6 mae_h1:6 mae_h2:6 mae_h4:6 error_std:6"


@query("i11_fs_evaluation", MATRIX)
def i11(spark, sf):
    rows = line_rows(spark, sf)
    return fs_evaluation(rows, LINE_FEATURES, "target", line_plan(rows), OPTIONS)


@query("i11_champion_option", "fs_option:s C1_accuracy:6 vikor_Q:6 vikor_rank:i is_selected:b")
def i11b(spark, sf):
    """Evaluation matrix → Pareto front → VIKOR → selected options."""
    rows = line_rows(spark, sf)
    return D.select_fs_option(fs_evaluation(rows, LINE_FEATURES, "target", line_plan(rows), OPTIONS))


@query("i12_interpretation_report", "section:s part:s feature:s value:6")
def i12(spark, sf):
    rows = line_rows(spark, sf)
    return A.interpretation_report(rows, LINE_FEATURES, "target", M.fit_final_ridge(rows, "target", LINE_FEATURES), LINE_IDS, regimes=REGIMES)


@query("i12_tree_report", "section:s part:s feature:s value:6")
def i12b(spark, sf):
    rows = line_rows(spark, sf)
    return A.tree_report(rows, LINE_FEATURES, "target", M.fit_tree(rows, "target", LINE_FEATURES, "gbt"), LINE_IDS, regimes=REGIMES)
