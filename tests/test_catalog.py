"""Catalog queries against DuckDB; all of them with PANELMILL_ALL=1."""

import os

import pytest

from tests.oracle import DATA, compare, connect

import __spark_entry__ as entry

SF = os.environ.get("PANELMILL_SF", "sf0.001")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
QUICK = ["s4_parse_period", "s7_align_to_spine", "q3_outliers_iqr", "q7_temporal_gaps", "q11_interpolate_linear", "d3_trend_test", "d5_kpss_test", "f4_rolling_features",
         "f13_engineer_features", "w1_fold_plan_rows", "w4_assign_folds", "x3_prefix_gram", "t4_correlation_spearman", "c3_fs_consensus", "m5_backtest_region_ridge",
         "h2_sweep_ridge_one_feature", "v5_evaluation_summary", "a8_compare_baselines", "p1_pareto_by_brand", "p4_vikor", "p9_weight_sensitivity", "i4_importance_by_regime"]
NAMES = sorted(QUERIES) if os.environ.get("PANELMILL_ALL") else QUICK


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, f"{DATA}/{SF}")
    if name in ORACLE:
        _, diff = compare(df, duck, ORACLE[name])
        assert not diff, diff
    else:   # no SQL: rows, and no column that is null throughout
        rows = df.collect()
        assert rows and all(any(r[c] is not None for r in rows) for c in df.columns)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_scans_are_pruned(spark):
    plan = QUERIES["s1_read_table_filtered"](spark, f"{DATA}/{SF}")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan
    assert "o_custkey" not in plan.split("ReadSchema")[1].splitlines()[0]


def test_features_share_one_window_shuffle(spark):
    plan = QUERIES["f13_engineer_features"](spark, f"{DATA}/{SF}")._jdf.queryExecution().executedPlan().toString()
    assert "Window [" in plan
    assert sum("__blk" in line and "Exchange" in line for line in plan.splitlines()) == 1
