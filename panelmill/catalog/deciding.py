"""Multi-criteria decision."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decide as D
from ..plans.panels import ALT_CRITERIA as C
from ..plans.panels import ALT_WEIGHTS as WT
from ..plans.panels import part_alternatives, supplier_alternatives
from .common import PARTS, SUPPLIERS, query

BEATS = """b.revenue >= a.revenue AND b.discount <= a.discount AND b.lines >= a.lines AND b.spread <= a.spread
 AND (b.revenue > a.revenue OR b.discount < a.discount OR b.lines > a.lines OR b.spread < a.spread)"""


@query("p1_pareto_filter", "l_suppkey:i revenue:4 discount:6 lines:0 spread:6", f"WITH {SUPPLIERS} SELECT * FROM sa a WHERE NOT EXISTS (SELECT 1 FROM sa b WHERE {BEATS})")
def p1(spark, sf):
    return D.pareto_filter(supplier_alternatives(spark, sf), C)


@query("p1_pareto_by_brand", "p_brand:s l_partkey:i revenue:4 discount:6", f"WITH {PARTS} SELECT * FROM pa a WHERE NOT EXISTS (SELECT 1 FROM pa b WHERE b.p_brand = a.p_brand AND {BEATS})")
def p1b(spark, sf):
    return D.pareto_filter(part_alternatives(spark, sf), C, ["p_brand"])


@query("p1_pareto_line_items", "l_extendedprice:2 l_quantity:0 l_discount:2 l_tax:2 n:i", """
WITH li AS (SELECT l_extendedprice, l_quantity, l_discount, l_tax, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT * FROM li a WHERE NOT EXISTS (SELECT 1 FROM li b WHERE b.l_extendedprice >= a.l_extendedprice AND b.l_quantity <= a.l_quantity AND b.l_discount <= a.l_discount AND b.l_tax <= a.l_tax
 AND (b.l_extendedprice > a.l_extendedprice OR b.l_quantity < a.l_quantity OR b.l_discount < a.l_discount OR b.l_tax < a.l_tax))""")
def p1c(spark, sf):
    from ..plans.panels import table

    crit = {"l_extendedprice": "benefit", "l_quantity": "cost", "l_discount": "cost", "l_tax": "cost"}
    return D.pareto_filter(table(spark, sf, "lineitem").select(*crit), crit).groupBy(*crit).agg(F.count(F.lit(1)).alias("n"))


NORM = " , ".join(f"{c}/sqrt(sum({c}*{c}) OVER k) AS {c}_norm" for c in C)


@query("p2_vector_normalise", "p_brand:s l_partkey:i revenue_norm:6 discount_norm:6 lines_norm:6 spread_norm:6", f"WITH {PARTS} SELECT p_brand, l_partkey, {NORM} FROM pa WINDOW k AS (PARTITION BY p_brand)")
def p2(spark, sf):
    return D.vector_normalise(part_alternatives(spark, sf), list(C), ["p_brand"])


def topsis_sql(src, k, weights):
    w = "".join(f", {weights[c]}*{c}/sqrt(sum({c}*{c}) OVER {k}) AS w_{c}" for c in C)
    best = " + ".join(f"(w_{c} - {'max' if C[c] == 'benefit' else 'min'}(w_{c}) OVER {k})**2" for c in C)
    worst = " + ".join(f"(w_{c} - {'min' if C[c] == 'benefit' else 'max'}(w_{c}) OVER {k})**2" for c in C)
    return f"""tw AS (SELECT *{w} FROM {src}), td AS (SELECT *, sqrt({best}) AS topsis_d_plus, sqrt({worst}) AS topsis_d_minus FROM tw),
ts AS (SELECT *, topsis_d_minus/(topsis_d_plus + topsis_d_minus + 1e-10) AS topsis_score FROM td)"""


def avg_rank(order, part=""):
    p = f"PARTITION BY {part} " if part else ""
    q = f"PARTITION BY {part}, {order.split()[0]}" if part else f"PARTITION BY {order.split()[0]}"
    return f"floor(rank() OVER ({p}ORDER BY {order}) + (count(*) OVER ({q}) - 1)/2.0)"


@query("p3_topsis", "l_suppkey:i topsis_d_plus:8 topsis_d_minus:8 topsis_score:6 topsis_rank:i", f"WITH {SUPPLIERS}, {topsis_sql('sa', '()', WT)} SELECT *, {avg_rank('topsis_score DESC')} AS topsis_rank FROM ts")
def p3(spark, sf):
    return D.topsis(supplier_alternatives(spark, sf), C, WT)


@query("p3_topsis_by_brand", "p_brand:s l_partkey:i topsis_score:6 topsis_rank:i", f"WITH {PARTS}, {topsis_sql('pa', '(PARTITION BY p_brand)', WT)} SELECT *, {avg_rank('topsis_score DESC', 'p_brand')} AS topsis_rank FROM ts")
def p3b(spark, sf):
    return D.topsis(part_alternatives(spark, sf), C, WT, ["p_brand"])


def sr_sql(src, k, weights, crit=C):
    def d(c):
        spread = f"nullif(max({c}) OVER {k} - min({c}) OVER {k}, 0)"
        num = f"max({c}) OVER {k} - {c}" if crit[c] == "benefit" else f"{c} - min({c}) OVER {k}"
        return f"coalesce({weights[c]}*({num})/{spread}, 0)"

    parts = [d(c) for c in crit]
    return f"SELECT *, {' + '.join(parts)} AS vikor_S, greatest({', '.join(parts)}) AS vikor_R FROM {src}"


def q_sql(k, v="0.5"):
    z = lambda c: f"coalesce((vikor_{c} - min(vikor_{c}) OVER {k})/nullif(max(vikor_{c}) OVER {k} - min(vikor_{c}) OVER {k}, 0), 0)"
    return f"{v}*{z('S')} + (1 - {v})*{z('R')}"


@query("p4_vikor", "l_suppkey:i vikor_S:6 vikor_R:6 vikor_Q:6 vikor_rank:i is_compromise:b", f"""
WITH {SUPPLIERS}, sr AS ({sr_sql('sa', '()', WT)}), vq AS (SELECT *, {q_sql('()')} AS vikor_Q FROM sr), vr AS (SELECT *, {avg_rank('vikor_Q')} AS vikor_rank,
 row_number() OVER (ORDER BY vikor_Q, l_suppkey) AS rn, lead(vikor_Q) OVER (ORDER BY vikor_Q, l_suppkey) AS q2, count(*) OVER () AS n, min(vikor_S) OVER () AS s0, min(vikor_R) OVER () AS r0 FROM vq)
SELECT *, rn = 1 AND coalesce(q2, vikor_Q) - vikor_Q >= CASE WHEN n > 1 THEN 1.0/(n-1) ELSE 0 END AND (vikor_S = s0 OR vikor_R = r0) AS is_compromise FROM vr""")
def p4(spark, sf):
    return D.vikor(supplier_alternatives(spark, sf), C, WT, tie=["l_suppkey"])


BRAND = "(PARTITION BY p_brand)"


@query("p4_vikor_by_brand", "p_brand:s l_partkey:i vikor_S:6 vikor_R:6 vikor_Q:6 vikor_rank:i is_compromise:b", f"""
WITH {PARTS}, sr AS ({sr_sql('pa', BRAND, WT)}), vq AS (SELECT *, {q_sql(BRAND)} AS vikor_Q FROM sr), vr AS (SELECT *, {avg_rank('vikor_Q', 'p_brand')} AS vikor_rank,
 row_number() OVER o AS rn, lead(vikor_Q) OVER o AS q2, count(*) OVER {BRAND} AS n, min(vikor_S) OVER {BRAND} AS s0, min(vikor_R) OVER {BRAND} AS r0 FROM vq WINDOW o AS (PARTITION BY p_brand ORDER BY vikor_Q, l_partkey))
SELECT *, rn = 1 AND coalesce(q2, vikor_Q) - vikor_Q >= CASE WHEN n > 1 THEN 1.0/(n-1) ELSE 0 END AND (vikor_S = s0 OR vikor_R = r0) AS is_compromise FROM vr""")
def p4b(spark, sf):
    return D.vikor(part_alternatives(spark, sf), C, WT, by=["p_brand"], tie=["l_partkey"])


@query("p5_rank_average", "l_partkey:i l_quantity:0 l_linenumber:i rank:i", f"""
WITH li AS (SELECT l_partkey, l_quantity, l_linenumber, l_orderkey FROM lineitem) SELECT l_partkey, l_quantity, l_linenumber, {avg_rank('l_quantity', 'l_linenumber')} AS rank FROM li""")
def p5(spark, sf):
    from ..plans.panels import table

    rows = table(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_linenumber")
    return D.rank_average(rows, "l_quantity", ["l_linenumber"])


def as_fs_matrix(df, name):
    return df.select(F.concat(F.lit("s"), F.col(name).cast("string")).alias("fs_option"), F.col("discount").alias("C1_accuracy"), F.col("revenue").alias("C2_stability"),
                     F.col("lines").alias("C3_shap_concentration"), (-F.col("spread")).alias("C4_shap_stability"), (F.col(name) % 7 / 7).alias("C5_parsimony"))


FSM = "fm AS (SELECT 's' || l_suppkey AS fs_option, discount AS C1_accuracy, revenue AS C2_stability, lines AS C3_shap_concentration, -spread AS C4_shap_stability, (l_suppkey % 7)/7.0::DOUBLE AS C5_parsimony FROM sa)"
FS_BEATS = "b.C1_accuracy <= a.C1_accuracy AND " + " AND ".join(f"b.{c} >= a.{c}" for c in list(D.FS_CRITERIA)[1:]) + " AND (b.C1_accuracy < a.C1_accuracy OR " + " OR ".join(f"b.{c} > a.{c}" for c in list(D.FS_CRITERIA)[1:]) + ")"


@query("p6_select_fs_option", "fs_option:s vikor_Q:6 vikor_rank:i is_selected:b", f"""
WITH {SUPPLIERS}, {FSM}, fr AS (SELECT * FROM fm a WHERE NOT EXISTS (SELECT 1 FROM fm b WHERE {FS_BEATS})),
sr AS ({sr_sql('fr', '()', D.FS_WEIGHTS, D.FS_CRITERIA)}), vq AS (SELECT *, {q_sql('()')} AS vikor_Q FROM sr)
SELECT fs_option, vikor_Q, {avg_rank('vikor_Q')} AS vikor_rank, row_number() OVER (ORDER BY vikor_Q, fs_option) <= 2 AS is_selected FROM vq""")
def p6(spark, sf):
    return D.select_fs_option(as_fs_matrix(supplier_alternatives(spark, sf), "l_suppkey"))


MW = {c: w / 0.9 for c, w in D.MODEL_WEIGHTS.items()}


@query("p7_select_model", "model:s vikor_Q:6 vikor_rank:i is_selected:b", f"""
WITH {SUPPLIERS}, mm AS (SELECT 'm' || l_suppkey AS model, discount AS weighted_mae, revenue AS stability_score, spread AS annual_mape, lines AS parsimony FROM sa),
fr AS (SELECT * FROM mm a WHERE NOT EXISTS (SELECT 1 FROM mm b WHERE b.weighted_mae <= a.weighted_mae AND b.stability_score >= a.stability_score AND b.annual_mape <= a.annual_mape AND b.parsimony >= a.parsimony
 AND (b.weighted_mae < a.weighted_mae OR b.stability_score > a.stability_score OR b.annual_mape < a.annual_mape OR b.parsimony > a.parsimony))),
sr AS ({sr_sql('fr', '()', MW, D.MODEL_CRITERIA)}), vq AS (SELECT *, {q_sql('()')} AS vikor_Q FROM sr)
SELECT model, vikor_Q, {avg_rank('vikor_Q')} AS vikor_rank, row_number() OVER (ORDER BY vikor_Q, model) <= 2 AS is_selected FROM vq""")
def p7(spark, sf):
    s = supplier_alternatives(spark, sf)
    return D.select_model(s.select(F.concat(F.lit("m"), F.col("l_suppkey").cast("string")).alias("model"), F.col("discount").alias("weighted_mae"),
                                   F.col("revenue").alias("stability_score"), F.col("spread").alias("annual_mape"), F.col("lines").alias("parsimony")))


@query("p8_v_sensitivity", "l_suppkey:i v:2 vikor_Q:6 rank:i", f"""
WITH {SUPPLIERS}, sr AS ({sr_sql('sa', '()', WT)}), g AS (SELECT unnest(generate_series(0, 10))/10.0 AS v), x AS (SELECT *, row_number() OVER () FROM sr CROSS JOIN g),
vq AS (SELECT l_suppkey, v, {q_sql('(PARTITION BY v)', 'v')} AS vikor_Q FROM x) SELECT *, {avg_rank('vikor_Q', 'v')} AS rank FROM vq""")
def p8(spark, sf):
    return D.v_sensitivity(supplier_alternatives(spark, sf), C, WT)


def scenarios(kind):
    out = []
    crit = list(C)
    if kind == "weight":
        for c in crit:
            for d, f in (("increase", 1.2), ("decrease", 0.8)):
                w = {k: WT[k] * (f if k == c else 1) for k in crit}
                t = sum(w.values())
                out.append(((c, d), {k: w[k] / t for k in crit}))
    else:
        for c in crit:
            w = {k: (0.0 if k == c else WT[k]) for k in crit}
            t = sum(w.values())
            out.append(((c,), {k: w[k] / t for k in crit}))
    return out


def scenario_sql(src, part, key, kind):
    vals = ", ".join("(" + ", ".join([f"'{x}'" for x in lab] + [repr(w[c]) for c in C]) + ")" for lab, w in scenarios(kind))
    labels = ["criterion", "perturbation"] if kind == "weight" else ["removed_criterion"]
    k = f"(PARTITION BY {', '.join([*part, *labels])})"
    base_k = f"(PARTITION BY {', '.join(part)})" if part else "()"
    pre = ", ".join([*part, ""]) if part else ""
    return f"""
b0 AS ({sr_sql(src, base_k, WT)}), b1 AS (SELECT *, {q_sql(base_k)} AS q FROM b0), b2 AS (SELECT {pre}{key} AS alternative, {avg_rank('q', ', '.join(part))} AS base_rank FROM b1),
sc({', '.join([*labels, *[f'w_{c}' for c in C]])}) AS (VALUES {vals}), cx AS (SELECT * FROM {src} CROSS JOIN sc),
x0 AS ({sr_sql('cx', k, {c: f'w_{c}' for c in C})}), x1 AS (SELECT *, {q_sql(k)} AS q FROM x0),
x2 AS (SELECT {pre}{', '.join(labels)}, {key} AS alternative, {avg_rank('q', ', '.join([*part, *labels]))} AS new_rank FROM x1),
ch AS (SELECT x2.*, base_rank, new_rank - base_rank AS rank_change, (base_rank = 1) <> (new_rank = 1) AS rank_reversed FROM x2 JOIN b2 ON x2.alternative = b2.alternative {' '.join(f'AND x2.{p} = b2.{p}' for p in part)})"""


@query("p9_weight_sensitivity", "criterion:s perturbation:s alternative:i base_rank:i new_rank:i rank_change:i", f"WITH {SUPPLIERS}, {scenario_sql('sa', [], 'l_suppkey', 'weight')} SELECT * FROM ch")
def p9(spark, sf):
    return D.weight_sensitivity(supplier_alternatives(spark, sf), "l_suppkey", C, WT)


@query("p9_weight_sensitivity_by_brand", "p_brand:s criterion:s perturbation:s alternative:i base_rank:i new_rank:i rank_change:i", f"WITH {PARTS}, {scenario_sql('pa', ['p_brand'], 'l_partkey', 'weight')} SELECT * FROM ch")
def p9b(spark, sf):
    return D.weight_sensitivity(part_alternatives(spark, sf), "l_partkey", C, WT, by=["p_brand"])


@query("p10_criterion_removal", "removed_criterion:s alternative:i base_rank:i new_rank:i rank_change:i rank_reversed:b", f"WITH {SUPPLIERS}, {scenario_sql('sa', [], 'l_suppkey', 'removal')} SELECT * FROM ch")
def p10(spark, sf):
    return D.criterion_removal(supplier_alternatives(spark, sf), "l_suppkey", C, WT)


@query("p11_rank_stability", "alternative:i rank_stability:6 n_scenarios:i", f"WITH {SUPPLIERS}, {scenario_sql('sa', [], 'l_suppkey', 'weight')} SELECT alternative, avg(CASE WHEN rank_change = 0 THEN 1.0 ELSE 0 END) AS rank_stability, count(*) AS n_scenarios FROM ch GROUP BY 1")
def p11(spark, sf):
    return D.rank_stability(D.weight_sensitivity(supplier_alternatives(spark, sf), "l_suppkey", C, WT))
