import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelmill.operators import folds as W
from panelmill.operators.calendar import period_spine


@pytest.fixture(scope="module")
def plan(spark):
    # 101 quarters from 2000Q1
    return W.fold_plan(W.period_axis(period_spine(spark, "2000-01-01", "2025-01-01")), 40, 4, (1, 2, 4)).toPandas().sort_values("fold_id")


def test_plan_counts_and_dates(plan):
    assert len(plan) == 44
    assert plan.groupby("horizon").size().to_dict() == {1: 15, 2: 15, 4: 14}
    first, last = plan.iloc[0], plan[plan.horizon == 1].iloc[-1]
    assert (first.train_start, first.train_end) == (dt.date(2000, 1, 1), dt.date(2009, 10, 1))
    assert (first.test_start, first.test_end) == (dt.date(2010, 1, 1), dt.date(2010, 10, 1))
    assert (last.train_end, last.test_end) == (dt.date(2023, 10, 1), dt.date(2024, 10, 1))
    h2 = plan[plan.horizon == 2].iloc[0]
    assert (h2.fold_id, h2.test_start, h2.test_end) == (15, dt.date(2010, 4, 1), dt.date(2011, 1, 1))


def test_plan_invariants(plan):
    gap = plan.test_start_ord - plan.train_end_ord
    assert (gap == plan.horizon).all()
    assert (plan.train_size >= 40).all() and (plan.test_size == 4).all()
    for _, g in plan.groupby("horizon"):
        assert g.train_size.is_monotonic_increasing


def test_short_axis_and_single_horizon(spark):
    axis = W.period_axis(period_spine(spark, "2000-01-01", "2012-04-01"))   # 50 quarters
    assert W.fold_plan(axis, 30, 4, (1,)).count() == 5
    assert W.fold_plan(axis, 49, 4, (1, 2)).count() == 0


def test_assigned_rows_do_not_leak(spark):
    spine = period_spine(spark, "2000-01-01", "2019-10-01").withColumn("y", F.col("ord").cast("double"))
    plan = W.fold_plan(W.period_axis(spine), 40)
    rows = W.assign_folds(spine, plan, ("train", "test"))
    assert W.leakage_violations(rows).count() == 0
    assert W.validate_no_leakage(plan).where(~F.col("valid")).count() == 0
    sizes = rows.groupBy("fold_id", "role").count().toPandas()
    assert (sizes[sizes.role == "test"]["count"] == 4).all()


def test_rolling_window(spark):
    axis = W.period_axis(period_spine(spark, "2000-01-01", "2019-10-01"))
    p = W.fold_plan(axis, 40, window=12).toPandas()
    assert (p.train_size == 12).all()
    assert (p.train_end_ord - p.train_start_ord == 11).all()
