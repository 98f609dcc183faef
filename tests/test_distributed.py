import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.operators import distributed as X
from panelmill.operators.features import lag_features, rolling_features
from panelmill.operators.quality import interpolate_linear, outliers_mad


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_quantiles_are_exact(spark, parts):
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(size=5000), np.full(4000, 0.25), rng.pareto(1.0, 1000)]   # one value fills 40 %
    df = spark.createDataFrame(pd.DataFrame({"variable": "x", "value": x})).repartition(parts)
    q = X.quantiles(df, [0, 0.25, 0.5, 0.9, 1]).first()
    assert q.n == len(x)
    assert np.allclose(q.q, np.quantile(x, [0, 0.25, 0.5, 0.9, 1]), rtol=0, atol=1e-12)


def test_value_ranks(spark):
    x = np.random.default_rng(3).integers(0, 50, 3000).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = X.average_rank(df, "x", truncate=False).toPandas()
    assert np.allclose(got["rank"], got["x"].rank())


def panel(spark, n=60, gaps=()):
    d = pd.DataFrame({"k": "a", "ord": range(n), "v": np.random.default_rng(5).normal(size=n)})
    return d, spark.createDataFrame(d[~d.ord.isin(gaps)])


def test_blocks_do_not_change_results(spark):
    d, df = panel(spark)
    b = X.Blocks(df, ["k"], back=5, size=7)
    got = b.select(b.at("v", -5).alias("l"), F.avg("v").over(b.frame(-3, 0)).alias("m")).orderBy("ord").toPandas()
    assert np.allclose(got["l"], d["v"].shift(5), equal_nan=True)
    assert np.allclose(got["m"], d["v"].rolling(4, min_periods=1).mean())


def test_lags_and_rolling(spark):
    d, df = panel(spark)
    out = rolling_features(lag_features(df, ["v"], [1, 4], ["k"]), ["v"], [4], ["mean", "std"], ["k"], shift=1).orderBy("ord").toPandas()
    assert np.allclose(out["v_lag4"], d["v"].shift(4), equal_nan=True)
    assert np.allclose(out["v_roll4_mean"], d["v"].rolling(4, min_periods=1).mean().shift(1), equal_nan=True)
    assert np.allclose(out["v_roll4_std"], d["v"].rolling(4, min_periods=1).std().shift(1), equal_nan=True)


def test_lag_over_a_gap_is_missing(spark):
    _, df = panel(spark, 10, gaps=(4,))
    out = {r.ord: r.v_lag1 for r in lag_features(df, ["v"], [1], ["k"]).collect()}
    assert out[5] is None and out[6] is not None


@pytest.mark.parametrize("size", [3, 8, 4096])
def test_interpolation_matches_pandas(spark, size):
    v = pd.Series(np.arange(40.0) ** 1.5)
    v[[0, 1, 5, 6, 7, 8, 9, 10, 11, 20, 38, 39]] = np.nan
    df = spark.createDataFrame([(i, None if np.isnan(x) else float(x)) for i, x in enumerate(v)], "ord bigint, v double")
    got = interpolate_linear(df, ["v"], size=size).orderBy("ord").toPandas()["v"]
    assert np.allclose(got.astype(float), v.interpolate(), equal_nan=True)


def test_prefix_sums(spark):
    d, df = panel(spark)
    got = X.prefix_sums(df, {"s": F.col("v")}, ["k"], size=9).orderBy("ord").toPandas()
    assert np.allclose(got["s"], d["v"].cumsum())


def test_permuted_does_not_depend_on_the_layout(spark, monkeypatch):
    df = spark.range(501).withColumn("x", F.col("id") * 2.0)
    monkeypatch.setattr(X, "PERMUTED", 100)
    found = []
    for n in (1, 4, 37):
        rows = X.permuted(df.repartition(n), ["x"], ["id"], 3).collect()
        found.append(sorted((r["id"], *[o["x"] for o in r["__p"]]) for r in rows))
    assert found[0] == found[1] == found[2]
    for r in range(3):
        other = [row[1 + r] for row in found[0]]
        assert sorted(other) == [2.0 * i for i in range(501)] and np.mean([o != 2 * row[0] for o, row in zip(other, found[0])]) > 0.95
    assert len({tuple(row[1:]) for row in found[0]}) > 490
    alone = {r["id"]: r["__p"]["x"] for r in X.permuted(df, ["x"], ["id"], 1, only=2).collect()}
    assert alone == {row[0]: row[3] for row in found[0]}


def test_mad_zero(spark):
    df = spark.createDataFrame([(1.0,)] * 9 + [(50.0,)], "x double")
    assert outliers_mad(df, ["x"]).first().n_outliers == 0


def test_quantiles_of_values_that_change_when_read_again(spark):
    import random

    noise = F.udf(lambda: random.random(), "double").asNondeterministic()   # as sums added up in another order
    q = X.quantiles(spark.range(60).select(F.lit("x").alias("variable"), noise().alias("value")), [0.25, 0.5]).first()
    assert q.n == 60 and 0 < q.q[0] < q.q[1] < 1


def test_permuted_shuffles_and_sorts_rows_once(spark):
    d = pd.DataFrame({"id": np.arange(300) // 2, "a": np.arange(300.0), "s": [f"v{i}" for i in range(300)]})   # ids come twice
    got = X.permuted(spark.createDataFrame(d), ["a", "s"], ["id"], 4)
    plan = got._jdf.queryExecution().toString()
    assert plan.split("Physical Plan")[-1].count("Sort ") == 1
    rows = got.toPandas()
    for r in range(4):
        assert sorted(p[r]["a"] for p in rows["__p"]) == list(d.a) and all(p[r]["s"] == f"v{int(p[r]['a'])}" for p in rows["__p"])
