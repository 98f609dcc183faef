"""Walk-forward splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds as W
from ..plans.panels import line_rows, region_quarter
from ..session import run_folder
from ..sources.tables import read_table, write_table
from .common import LINE_ROWS, REGION_QUARTER, folds_sql, query

PLAN = "fold_id:i horizon:i train_start:d train_end:d test_start:d test_end:d train_size:i test_size:i"


def region_plan(spark, sf):
    return W.fold_plan(W.period_axis(region_quarter(spark, sf)), 12)


@query("w1_fold_plan", PLAN, f"WITH {REGION_QUARTER}, {folds_sql('rq', 12)} SELECT * FROM pl")
def w1(spark, sf):
    return region_plan(spark, sf)


@query("w1_fold_plan_rows", PLAN, f"WITH {LINE_ROWS}, {folds_sql('lr', 40)} SELECT * FROM pl")
def w1b(spark, sf):
    return W.fold_plan(W.period_axis(line_rows(spark, sf)), 40)


@query("w2_expanding_plan", PLAN, f"WITH {REGION_QUARTER}, {folds_sql('rq', 8, 2)} SELECT * FROM pl")
def w2(spark, sf):
    """Any window asked for is put aside: the train window always starts with the first period."""
    return W.expanding_plan(W.period_axis(region_quarter(spark, sf)), min_train=8, test=2, window=3)


@query("w2_rolling_plan", PLAN, f"""
WITH {REGION_QUARTER}, {folds_sql('rq', 12)}
SELECT fold_id, horizon, ax.period AS train_start, train_end, test_start, test_end, least(train_size, 10) AS train_size, test_size
FROM pl JOIN ax ON ax.pos = greatest(0, train_size - 10)""")
def w2b(spark, sf):
    return W.fold_plan(W.period_axis(region_quarter(spark, sf)), 12, window=10)


@query("w3_folds_by_horizon", PLAN, f"WITH {REGION_QUARTER}, {folds_sql('rq', 12)} SELECT * FROM pl WHERE horizon = 2")
def w3(spark, sf):
    import uuid

    # saved and read back, then filtered
    path = write_table(region_plan(spark, sf), f"{run_folder(spark)}/w3-{uuid.uuid4().hex}")
    return W.folds_by_horizon(read_table(spark, path), 2)


@query("w4_assign_folds", "r_name:s fold_id:i role:s period:d y:2", f"""
WITH {REGION_QUARTER}, {folds_sql('rq', 12)}
SELECT r_name, fold_id, 'test' AS role, period, y FROM rq JOIN pl ON ord BETWEEN test_start_ord AND test_end_ord
UNION ALL SELECT r_name, fold_id, 'train', period, y FROM rq JOIN pl ON ord BETWEEN train_start_ord AND train_end_ord""")
def w4(spark, sf):
    return W.assign_folds(region_quarter(spark, sf), region_plan(spark, sf), ("test", "train"))


@query("w4_assign_test_rows", "fold_id:i horizon:i n:i total:4", f"""
WITH {LINE_ROWS}, {folds_sql('lr', 40)} SELECT fold_id, horizon, count(*) AS n, sum(target) AS total FROM lr JOIN pl ON ord BETWEEN test_start_ord AND test_end_ord GROUP BY 1, 2""")
def w4b(spark, sf):
    rows = line_rows(spark, sf)
    out = W.assign_folds(rows, W.fold_plan(W.period_axis(rows), 40))
    return out.groupBy("fold_id", "horizon").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("total"))


@query("w5_validate_no_leakage", "fold_id:i horizon:i gap:i valid:b", f"WITH {REGION_QUARTER}, {folds_sql('rq', 12)} SELECT fold_id, horizon, test_start_ord - train_end_ord AS gap, true AS valid FROM pl")
def w5(spark, sf):
    return W.validate_no_leakage(region_plan(spark, sf))


@query("w5_leakage_violations", "fold_id:i train_last:i test_first:i", f"""
WITH {REGION_QUARTER}, {folds_sql('rq', 12)}, ex AS (SELECT fold_id, 'test' AS role, ord FROM rq JOIN pl ON ord BETWEEN test_start_ord AND test_end_ord
UNION ALL SELECT fold_id, 'train', ord FROM rq JOIN pl ON ord BETWEEN train_start_ord AND train_end_ord + 1)
SELECT fold_id, max(ord) FILTER (role = 'train') AS train_last, min(ord) FILTER (role = 'test') AS test_first FROM ex GROUP BY 1 HAVING train_last >= test_first""")
def w5b(spark, sf):
    # a plan broken on purpose: the train window reaches one period too far
    plan = region_plan(spark, sf).withColumn("train_end_ord", F.col("train_end_ord") + 1)
    return W.leakage_violations(W.assign_folds(region_quarter(spark, sf), plan, ("test", "train")))


@query("w6_contiguous_kfold", "block:i n_periods:i n_rows:i first:d last:d", f"""
WITH {LINE_ROWS}, ax AS (SELECT ord, min(period) AS period FROM lr GROUP BY 1), kf AS (SELECT ord, period, ntile(5) OVER (ORDER BY ord) - 1 AS block FROM ax)
SELECT block, count(DISTINCT lr.ord) AS n_periods, count(*) AS n_rows, min(kf.period) AS first, max(kf.period) AS last FROM lr JOIN kf USING (ord) GROUP BY 1""")
def w6(spark, sf):
    rows = line_rows(spark, sf)
    per = rows.groupBy("ord").agg(F.count(F.lit(1)).alias("n"))
    kf = W.contiguous_kfold(W.period_axis(rows), 5)
    return per.join(kf, "ord").groupBy("block").agg(F.count(F.lit(1)).alias("n_periods"), F.sum("n").alias("n_rows"), F.min("period").alias("first"), F.max("period").alias("last"))
