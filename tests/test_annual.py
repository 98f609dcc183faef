import math

import pandas as pd
from pyspark.sql import functions as F

from panelmill.functions.period import parse_period
from panelmill.operators import annual as A
from panelmill.operators import evaluate as V


def preds(spark, n=20, noise=0.0):
    d = pd.DataFrame({"period": pd.date_range("2015-01-01", periods=n, freq="QS").date, "actual": [10 + 0.01 * i for i in range(n)]})
    d["predicted"] = d["actual"] + [noise * (-1) ** i for i in range(n)]
    return spark.createDataFrame(d)


def test_ones_sum_to_four_e(spark):
    d = pd.DataFrame({"period": pd.date_range("2010-01-01", periods=4, freq="QS").date, "actual": 1.0, "predicted": 1.0})
    r = A.annualise_predictions(spark.createDataFrame(d)).first()
    assert r.year == 2010 and math.isclose(r.actual_annual, 4 * math.e) and math.isclose(r.predicted_annual, 4 * math.e)


def test_perfect_and_noisy(spark):
    r = A.annual_consistency(A.annualise_predictions(preds(spark))).first()
    assert r.annual_mae < 1e-6 and r.n_years == 5 and abs(r.consistency_score - 1) < 1e-9
    r = A.annual_consistency(A.annualise_predictions(preds(spark, noise=0.1))).first()
    assert 0 <= r.consistency_score < 1


def test_repeated_periods_are_averaged(spark):
    p = preds(spark).unionByName(preds(spark))
    a = A.annualise_predictions(preds(spark)).orderBy("year").collect()
    assert [r.actual_annual for r in A.annualise_predictions(p).orderBy("year").collect()] == [r.actual_annual for r in a]
    twice = A.annualise_predictions(p, dedupe="none").orderBy("year").collect()
    assert math.isclose(twice[0].actual_annual, 2 * a[0].actual_annual)


def test_baselines(spark):
    y = spark.createDataFrame([(2000 + i, float(i * i + 1)) for i in range(6)], "year int, value double")
    got = {(r.method, r.year): r.predicted for r in A.annual_baselines(y, (), ("naive", "mean", "linear", "ar1")).collect()}
    assert got[("naive", 2000)] == 1.0 and got[("naive", 2003)] == 5.0
    assert got[("mean", 2002)] == 1.5
    assert math.isclose(got[("linear", 2002)], 3.0) and math.isclose(got[("linear", 2001)], 1.0)
    # changes 1, 3, 5 before 2004: phi = (3·1 + 5·3) / (1 + 9)
    assert math.isclose(got[("ar1", 2004)], 10 + 1.8 * 5)
    c = A.compare_baselines(A.annualise_predictions(preds(spark)), A.annualise_predictions(preds(spark)).select("year", F.col("actual_annual").alias("value"))).first()
    assert c.beats_all and c.n_years == 5


def test_metrics(spark):
    p = spark.createDataFrame([(1, 0, 1.0, 2.0), (1, 0, 3.0, 3.0), (2, 1, 5.0, 4.0)], "horizon int, fold_id int, actual double, predicted double")
    m = {r.horizon: r for r in V.metrics_by_horizon(p, (1, 2, 4)).collect()}
    assert m[1].mae == 0.5 and m[1].r2 == 0.5 and m[2].r2 == 0.0 and m[4].n == 0 and m[4].mae == 0.0
    assert math.isclose(V.weighted_mae(V.metrics_by_horizon(p, (1, 2, 4))).first().weighted_mae, 0.5 * 0.5 + 0.3 * 1)
    s = V.stability(p).first()
    assert s.error_std == 0.25 and s.n_folds == 2


def test_period_literals(spark):
    got = [str(r[0]) for r in spark.createDataFrame([("1999Q1",), ("1999-Q2",), ("1999 Q3",), ("1999.4",), ("2025.1",), ("x",), ("1999Q5",)], "t string").select(parse_period(F.col("t"))).collect()]
    assert got == ["1999-01-01", "1999-04-01", "1999-07-01", "1999-10-01", "2025-01-01", "None", "None"]
