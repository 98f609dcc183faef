import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.operators import attribute as A
from panelmill.operators import embedded as E
from panelmill.operators import gram as G
from panelmill.operators import linear as L
from panelmill.operators import modelling as M
from panelmill.operators import wrappers as R
from panelmill.operators.folds import fold_plan, period_axis

FEATS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 60 * 20
    d = pd.DataFrame(rng.normal(size=(n, 4)) * [1, 5, 1000, 0.01] + [0, 3, 1e6, 1], columns=FEATS)
    d["ord"] = np.repeat(np.arange(60), 20)
    d["y"] = 2 * d.a - 0.3 * d.b + 0.001 * d.c + rng.normal(size=n)
    d["period"] = pd.to_datetime("2000-01-01").date()
    return d, spark.createDataFrame(d).repartition(6)


def ridge_numpy(x, y, alpha=1.0):
    mu, sd = x.mean(0), x.std(0)
    z = (x - mu) / sd
    b = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return y.mean() - (b / sd) @ mu, b / sd


@pytest.mark.parametrize("engine", ["sql", "arrow"])
def test_backtest_equals_refits(data, engine):
    d, df = data
    plan = fold_plan(period_axis(df), 40)
    got = M.backtest_ridge(df, "y", FEATS, plan, carry=["a"], engine=engine).toPandas()
    folds = plan.toPandas()
    for f in folds.itertuples():
        tr = d[(d.ord >= f.train_start_ord) & (d.ord <= f.train_end_ord)]
        te = d[(d.ord >= f.test_start_ord) & (d.ord <= f.test_end_ord)].sort_values("a")
        b0, b = ridge_numpy(tr[FEATS].to_numpy(), tr.y.to_numpy())
        mine = got[got.fold_id == f.fold_id].sort_values("a")
        assert np.allclose(mine.predicted, te[FEATS].to_numpy() @ b + b0, rtol=1e-8, atol=1e-8)


def test_partition_invariance(data):
    _, df = data
    one = M.fit_final_ridge(df.coalesce(1), "y", FEATS).first()
    many = M.fit_final_ridge(df.repartition(37), "y", FEATS).first()
    assert np.allclose(one.beta, many.beta, rtol=1e-9) and one.n == many.n


def test_vif_and_filter(data):
    d, df = data
    df = df.withColumn("e", F.col("a") * 2 + F.col("b") * 0.001).withColumn("f", 2 * F.col("b"))
    r = np.linalg.inv(np.corrcoef(d[["a", "b"]].to_numpy().T))
    got = {x.feature: x.vif for x in L.vif(df, ["a", "b"]).collect()}
    assert np.isclose(got["a"], r[0, 0], rtol=1e-8)
    rep = L.vif_filter(df, [*FEATS, "e", "f"]).toPandas()
    kept = set(rep[rep.selected].feature)
    assert {"c", "d"} <= kept and len(kept) == 4 and not {"b", "f"} <= kept


def test_elastic_net_optimality(data):
    d, df = data
    m = next(iter(G.moments_local(G.gram(df, [*FEATS, "y"])).values()))
    z = (d[FEATS] - d[FEATS].mean()) / d[FEATS].std(ddof=0)
    yc = (d.y - d.y.mean()).to_numpy()
    for alpha, ratio in ((0.1, 1.0), (0.5, 0.5)):
        b = M.elastic_net_solve(m, range(4), 4, alpha, ratio)
        g = z.to_numpy().T @ (yc - z.to_numpy() @ b) / len(d) - alpha * (1 - ratio) * b
        on = np.abs(b) > 1e-12
        assert np.allclose(g[on], alpha * ratio * np.sign(b[on]), atol=1e-7)
        assert (np.abs(g[~on]) <= alpha * ratio + 1e-7).all()


def test_wrappers_agree_with_exhaustive(data):
    _, df = data
    best = {tuple(r.features): r.mean_score for r in R.exhaustive_select(df, FEATS, "y", 1, 4).collect()}
    assert len(best) == 15
    fwd = R.sequential_select(df, FEATS, "y", 2).toPandas()
    chosen = tuple(f for f in FEATS if f in set(fwd[fwd.selected].feature))
    assert np.isclose(-best[chosen], fwd.mae.max() if fwd.step.max() == 1 else fwd[fwd.step == 2].mae.iloc[0], rtol=1e-9)
    first = fwd[fwd.step == 1].feature.iloc[0]
    assert best[(first,)] == max(v for k, v in best.items() if len(k) == 1)


def test_subsets_are_unranked_in_order():
    from itertools import combinations

    for p, low, high in ((5, 1, 5), (6, 2, 4), (1, 1, 1), (9, 3, 3)):
        want = [c for size in range(low, high + 1) for c in combinations(range(p), size)]
        assert [R.subset_at(r, p, low, high) for r in range(len(want))] == want


def test_exhaustive_does_not_depend_on_ranges(data, monkeypatch):
    _, df = data
    key = lambda rows: sorted((tuple(r.features), round(r.mean_score, 9), round(r.std_score, 9), r.selected) for r in rows)
    want = key(R.exhaustive_select(df, FEATS, "y", 1, 3).collect())
    monkeypatch.setattr(R, "SUBSETS", 3)
    monkeypatch.setattr(R, "BUFFER", 50)
    assert key(R.exhaustive_select(df.repartition(5), FEATS, "y", 1, 3).collect()) == want and sum(r[3] for r in want) == 1


def test_exhaustive_scores_equal_numpy(data):
    d, df = data
    got = {tuple(r.features): r.mean_score for r in R.exhaustive_select(df, FEATS, "y", 1, 1, standardize=True).collect()}
    maes = []
    for k in range(5):
        te = (d.ord >= 12 * k) & (d.ord < 12 * (k + 1))
        b0, b = ridge_numpy(d[~te][["b"]].to_numpy(), d[~te].y.to_numpy())
        maes.append(np.abs(d[te].y - (d[te].b * b[0] + b0)).mean())
    assert np.isclose(-got[("b",)], np.mean(maes), rtol=1e-8)


def test_lasso_keeps_signal(data):
    _, df = data
    got = {r.feature: r.selected for r in E.lasso_select(df, FEATS, "y").collect()}
    assert got["a"] and got["b"] and got["c"]


def test_attribution_adds_up(data):
    d, df = data
    fit = M.fit_final_ridge(df, "y", FEATS)
    one = fit.first()
    phi = A.linear_shap(df, FEATS, fit).toPandas()
    pred = phi[FEATS].to_numpy() @ np.array(one.beta) + one.intercept
    assert np.allclose(phi[[f"phi_{f}" for f in FEATS]].sum(axis=1), pred - d.y.mean(), atol=1e-6)


def test_permutation_importance_order(data):
    _, df = data
    rows = df.withColumn("id", F.xxhash64(*FEATS, "y"))
    out = A.permutation_importance(rows, FEATS, "y", M.fit_final_ridge(df, "y", FEATS), ["id"], 2).collect()
    assert out[0].feature == "a" and out[0].importance_mean > 0
    assert abs([r for r in out if r.feature == "d"][0].importance_mean) < 0.05
