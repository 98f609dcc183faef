"""Trees over binned blocks against trees grown row by row, and their attributions against all subsets."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.operators import attribute as A
from panelmill.operators import embedded as E
from panelmill.operators import modelling as M
from panelmill.operators import trees as T
from panelmill.operators.folds import fold_plan, period_axis
from panelmill.operators.gram import windows_of

FEATS = ["a", "b", "c", "d"]
CUTS = [np.array([-0.5, 0.0, 0.5]), np.array([1.5, 2.5]), np.array([0.1, 0.4, 0.7]), np.array([])]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 700
    d = pd.DataFrame({"ord": rng.integers(0, 30, n), "a": rng.normal(size=n), "b": rng.integers(1, 4, n).astype(float), "c": rng.random(n), "d": np.ones(n)})
    d["y"] = 2 * (d.a > 0) + d.b * (d.c > 0.4) + 0.1 * rng.normal(size=n)
    d["period"] = pd.to_datetime("2000-01-01") + pd.to_timedelta(d.ord * 31, unit="D")
    df = spark.createDataFrame(d).withColumn("period", F.to_date(F.trunc("period", "month")))
    return d, df


def slow_tree(x, y, w, depth, min_leaf, min_split):
    """(feature, threshold, left, right, cover, value) or (value, cover), by trying every cut on the rows."""
    n, s = w.sum(), (w * y).sum()
    best = None
    if depth and n >= min_split:
        for f, cuts in enumerate(CUTS):
            for c in cuts:
                left = x[:, f] <= c
                nl, sl = w[left].sum(), (w * y)[left].sum()
                if nl >= min_leaf and n - nl >= min_leaf:
                    gain = sl**2 / nl + (s - sl) ** 2 / (n - nl) - s**2 / n
                    if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-9)):
                        best = gain, f, c, left
    if best is None:
        return s / n, n
    _, f, c, left = best
    return f, c, *[slow_tree(x[at], y[at], w[at], depth - 1, min_leaf, min_split) for at in (left, ~left)], n


def slow_predict(tree, x):
    while len(tree) == 5:
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def test_boosting_equals_rows_one_by_one(data):
    d, df = data
    models = T.fit_units(df, "y", FEATS, [(0, 19, {"rounds": 4, "depth": 3, "min_leaf": 5}), (0, 29, {"rounds": 2, "depth": 2, "rate": 0.5}), (50, 60, {})], "gbt", cuts=CUTS)
    assert models[2] is None
    for model, (last, rounds, depth, leaf, rate) in zip(models, ((19, 4, 3, 5, 0.1), (29, 2, 2, 1, 0.5))):
        own = d[d.ord <= last]
        x, y = own[FEATS].to_numpy(), own.y.to_numpy()
        f = np.full(len(y), y.mean())
        for _ in range(rounds):
            tree = slow_tree(x, y - f, np.ones(len(y)), depth, leaf, 2)
            f = f + rate * np.array([slow_predict(tree, r) for r in x])
        assert np.allclose(model.predict(x), f)
    got = models[0].transform(df).select("a", "prediction").orderBy("a").toPandas()
    assert np.allclose(got.prediction, models[0].predict(d.sort_values("a")[FEATS].to_numpy()))


def test_forest_tree_equals_rows_one_by_one(data):
    d, df = data
    model = T.fit_trees(df, "y", FEATS, "random_forest", cuts=CUTS, trees=1, depth=4, share=1.0, bootstrap=False, min_leaf=3, min_split=20)
    tree = slow_tree(d[FEATS].to_numpy(), d.y.to_numpy(), np.ones(len(d)), 4, 3, 20)
    assert np.allclose(model.predict(d[FEATS].to_numpy()), [slow_predict(tree, r) for r in d[FEATS].to_numpy()])


def test_forest_does_not_depend_on_the_layout(data, monkeypatch):
    _, df = data
    one = T.fit_trees(df.repartition(1), "y", FEATS, trees=6, depth=4)
    monkeypatch.setattr(T, "BLOCK_ROWS", 60)
    monkeypatch.setattr(T, "CELLS", 500)
    many = T.fit_trees(df.repartition(7), "y", FEATS, trees=6, depth=4)
    assert (one.feature == many.feature).all() and np.allclose(one.value, many.value) and np.allclose(one.cover, many.cover)
    assert len({one.cover[t, 0] for t in range(6)}) > 1   # bootstrap samples differ
    imp = dict(zip(FEATS, one.importances()))
    assert imp["d"] == 0 and imp["a"] > imp["c"] and math.isclose(sum(imp.values()), 1)


def test_all_windows_equal_single_fits(data):
    _, df = data
    plan = fold_plan(period_axis(df), 12, 6)
    windows = windows_of(plan)
    together = T.fit_units(df, "y", FEATS, [(a, b, {"trees": 3, "depth": 3}) for a, b in windows], cuts=CUTS)
    for (a, b), model in zip(windows, together):
        assert (df.where(F.col("ord").between(a, b)).count() > 0) and model.cover[:, 0].max() > 0
    alone = T.fit_units(df, "y", FEATS, [(*windows[0], {"trees": 3, "depth": 3})], cuts=CUTS)[0]
    assert (alone.feature == together[0].feature).all() and np.allclose(alone.value, together[0].value)


def test_backtest_per_series(spark, data):
    _, df = data
    keyed = df.withColumn("k", F.when(F.col("c") > 0.5, "high").otherwise(F.lit(None)))
    plan = fold_plan(period_axis(df), 12, 6)
    par = {"rounds": 3, "depth": 2}
    both = M.backtest_tree(keyed, "y", FEATS, plan, "gbt", ["k"], cuts=CUTS, **par).toPandas()
    for name, part in (("high", "k = 'high'"), (None, "k is null")):
        one = M.backtest_tree(keyed.where(part), "y", FEATS, plan, "gbt", cuts=CUTS, **par).toPandas()
        own = both[both.k == name] if name else both[both.k.isna()]
        order = ["fold_id", "period", "actual"]
        assert len(one) and np.allclose(own.sort_values(order).predicted, one.sort_values(order).predicted)
    with pytest.raises(ValueError):
        M.backtest_tree(keyed, "y", FEATS, plan, "gbt", ["ord"], max_series=5)


def test_unknown_parameters(data):
    _, df = data
    with pytest.raises(ValueError):
        T.fit_trees(df, "y", FEATS, "gbt", numTrees=3)


@pytest.mark.parametrize("kind, par", [("gbt", {"rounds": 3, "depth": 3}), ("random_forest", {"trees": 3, "depth": 4})])
def test_tree_shap_equals_all_orders(data, kind, par):
    d, df = data
    model = T.fit_trees(df, "y", FEATS, kind, cuts=CUTS, **par)

    def worth(tree, node, x, known):
        f = model.feature[tree, node]
        if f < 0:
            return model.value[tree, node]
        left, right = 2 * node + 1, 2 * node + 2
        if f in known:
            return worth(tree, left if x[f] <= CUTS[f][model.cut[tree, node]] else right, x, known)
        cover = model.cover[tree]
        return (cover[left] * worth(tree, left, x, known) + cover[right] * worth(tree, right, x, known)) / cover[node]

    got = A.tree_shap(df, FEATS, model).toPandas()
    total = got[[f"phi_{f}" for f in FEATS]].sum(axis=1) + A.expected_value(model)
    assert np.allclose(total, model.predict(got[FEATS].to_numpy()))
    for _, row in got.head(12).iterrows():
        x, phi = row[FEATS].to_numpy(dtype=float), np.zeros(4)
        for order in itertools.permutations(range(4)):
            known, before = set(), sum(worth(t, 0, x, set()) for t in range(len(model.feature)))
            for k in order:
                known.add(k)
                after = sum(worth(t, 0, x, known) for t in range(len(model.feature)))
                phi[k] += model.scale * (after - before) / 24
                before = after
        assert np.allclose(row[[f"phi_{f}" for f in FEATS]].to_numpy(dtype=float), phi)


def test_attribution_shuffles_no_row(data):
    _, df = data
    model = T.fit_trees(df, "y", FEATS, "gbt", cuts=CUTS, rounds=2, depth=2)
    assert "Exchange" not in A.tree_shap(df, FEATS, model)._jdf.queryExecution().executedPlan().toString()


def test_sampled_shapley_and_permutation_of_a_tree(data):
    d, df = data
    rows = df.withColumn("id", F.monotonically_increasing_id())
    model = T.fit_trees(df, "y", FEATS, "gbt", rounds=20, depth=3)
    s = A.sampled_shapley(rows, FEATS, model, ["id"], 4).toPandas()
    assert np.allclose(s[[f"phi_{f}" for f in FEATS]].sum(axis=1), s.f_x - s.f_background)
    out = {r.feature: r.importance_mean for r in A.permutation_importance(rows, FEATS, "y", model, ["id"], 3).collect()}
    assert out["a"] > 0.3 and out["c"] > 0.3 and out["d"] == 0


def test_boruta_decides(spark):
    rng = np.random.default_rng(8)
    n = 1500
    d = pd.DataFrame({f"n{i}": rng.normal(size=n) for i in range(4)} | {"s1": rng.normal(size=n), "s2": rng.normal(size=n), "s3": rng.normal(size=n)})
    d["y"] = 3 * d.s1 + 2 * d.s2 - 2 * d.s3 + rng.normal(size=n)
    df = spark.createDataFrame(d.assign(id=range(n)))
    names = [c for c in d.columns if c != "y"]
    one, two = (E.boruta(df.repartition(k), names, "y", ["id"], rounds=40, trees=10, depth=4).toPandas().set_index("feature") for k in (1, 5))
    assert (one == two).all().all()
    assert (one.verdict[["s1", "s2", "s3"]] == "accepted").all() and (one.verdict[[f"n{i}" for i in range(4)]] == "rejected").sum() >= 3
    assert one.rounds.min() < 40 and one.selected[["s1", "s2", "s3"]].all()
    few = E.boruta(df, ["n0", "n1", "n2", "n3"], "y", ["id"], rounds=3, trees=5, depth=3).toPandas()
    assert few.selected.sum() == 3   # topped up


def test_routes_lead_where_single_steps_do():
    rng = np.random.default_rng(4)
    for depth in (1, 3, 5, 7):
        size = (2 << depth) - 1
        feature, cut = rng.integers(-1, 3, size), rng.integers(0, 31, size)
        feature[(1 << depth) - 1:] = -1
        bins = rng.integers(0, 32, (3, 200)).astype(np.uint8)
        node = T.reach(T.Route(feature, cut, depth), bins.ravel(), 200, 20, 200)
        for i, got in zip(range(20, 200), node):
            at = 0
            for _ in range(depth):
                f = feature[at]
                at = 2 * at + 1 + int(f >= 0 and bins[f, i] > cut[at])
            assert at == got


def test_boosting_counts_the_smaller_child_only(data, monkeypatch):
    _, df = data
    counted, old = [], T._subset
    plain = T.fit_trees(df, "y", FEATS, "gbt", cuts=CUTS, rounds=3, depth=3)
    monkeypatch.setattr(T, "HALVED", 100)
    assert np.allclose(T.fit_trees(df, "y", FEATS, "gbt", cuts=CUTS, rounds=3, depth=3).value, plain.value)
    monkeypatch.setattr(T, "_subset", lambda *a: counted.append(a[3]) or old(*a))
    model = T.fit_trees(df, "y", FEATS, "gbt", cuts=CUTS, rounds=1, depth=3)
    splits = int((model.feature[0, :3] >= 0).sum())
    assert splits == 3 and len(counted) == 1 + 1 + 2   # not 1 + 2 + 4


def test_changes_equal_scores_of_changed_rows(data):
    d, df = data
    for depth in (3, 7):
        model = T.fit_trees(df, "y", FEATS, "gbt", cuts=CUTS, rounds=4, depth=depth)
        bins = np.ascontiguousarray(model.bins(d[FEATS].to_numpy()[:90]).T)
        mixed = [bins[k][np.stack([np.roll(np.arange(90), r) for r in (1, 5)])] for k in range(4)]
        for k, change in enumerate(A._changes(model, bins, mixed)):
            for r in range(2):
                turned = bins.copy()
                turned[k] = mixed[k][r]
                want = model.score(turned) - model.score(bins)
                assert np.allclose(want, 0 if change is None else change[r])


def test_forest_counts_on_packed_bins(monkeypatch):
    """14 features fill two integers; windows of one tree share its draw; small blocks are joined; counts equal those row by row."""
    rng, p, depth = np.random.default_rng(3), 14, 7
    rows = [{"n": n, "x": rng.integers(0, 32, (n, p)).astype(np.uint8).tobytes(), "y": rng.normal(size=n).tobytes(),
             "ord": np.sort(rng.integers(0, 30, n)).tobytes(), "h": rng.integers(0, 1 << 63, n).astype(np.uint64).tobytes()} for n in (300, 1, 450)]
    spans = [(0, 29), (5, 20), (40, 50)]
    blocks = list(T._pack(rows, p, spans))
    assert len(blocks) == 1 and blocks[0]["words"].shape == (2, 751)
    monkeypatch.setattr(T, "PIECE", 1)
    apart = list(T._pack(rows, p, spans))
    x, y, h, o = (np.concatenate([np.frombuffer(r[c], kind).reshape(r["n"], -1) for r in rows]) for c, kind in (("x", np.uint8), ("y", "<f8"), ("h", "<u8"), ("ord", "<i8")))
    y, h, o = y[:, 0], h[:, 0], o[:, 0]
    for level in range(depth):
        tree = T._Tree(0, 0, depth)
        for i in range((1 << level) - 1):
            if rng.random() < 0.9:
                tree.feature[i], tree.cut[i] = rng.integers(0, p), rng.integers(4, 28)
        width = 1 << level
        active = np.arange(width)
        active[rng.random(width) < 0.3] = -1
        active[active >= 0] = np.arange((active >= 0).sum())
        slots = rng.integers(0, p, (max(1, active.max() + 1), 5))
        route = T.Route(tree.feature, tree.cut, level)
        growing = [(u, t, drawn, route, active, slots) for t, drawn in ((0, True), (1, True), (0, False)) for u in range(3)]
        drew = []
        draw = T._draw
        monkeypatch.setattr(T, "_draw", lambda b, t, s: drew.append(t) or draw(b, t, s))
        found = dict(T._counted(blocks, growing, level, 42))
        monkeypatch.setattr(T, "_draw", draw)
        assert drew == [0, 1, -1]
        others = dict(T._counted(apart, growing, level, 42))
        assert found.keys() == others.keys() == {0, 1, 3, 4, 6, 7}
        for g, (u, t, drawn, *_) in enumerate(growing):
            if u == 2:
                continue
            w = np.ones(len(y))
            if drawn:
                at, n = T._weights(h, t, 42)
                w = np.zeros(len(y))
                w[at] = n
            want = np.zeros((2, len(slots), 5, T.BINS))
            for r in np.flatnonzero((o >= spans[u][0]) & (o <= spans[u][1]) & (w > 0)):
                i = 0
                for _ in range(level):
                    f = tree.feature[i]
                    i = 2 * i + 1 + int(f >= 0 and x[r, f] > tree.cut[i])
                node = active[i - width + 1]
                for s in range(5) if node >= 0 else ():
                    want[:, node, s, x[r, slots[node, s]]] += w[r], w[r] * y[r]
            assert (found[g][0] == want[0]).all() and np.allclose(found[g], want) and np.allclose(others[g], want)


def test_boosting_adds_histograms_up_without_a_shuffle(spark, data, monkeypatch):
    _, df = data
    fit = lambda: T.fit_units(df, "y", FEATS, [(0, 14, {"rounds": 4, "depth": 3}), (0, 29, {"rounds": 4, "depth": 3})], "gbt", cuts=CUTS)
    shuffles = []
    by_key = T.np.add
    plain = type(df.rdd).reduceByKey
    monkeypatch.setattr(type(df.rdd), "reduceByKey", lambda rdd, f, *a: (shuffles.append(f is by_key), plain(rdd, f, *a))[1])
    near = fit()
    assert len(shuffles) == 2   # base and tally, none of the 12 passes
    monkeypatch.setattr(T, "CELLS", 1)   # every tree in a pass of its own, by shuffle
    for a, b in zip(near, fit()):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all()
        np.testing.assert_allclose(a.value, b.value, rtol=1e-9, atol=1e-12)
    assert len(shuffles) > 14


def test_all_options_boost_once(data, monkeypatch):
    from panelmill.plans import selection as S

    _, df = data
    names = FEATS[:3]
    plan, fits, plain = fold_plan(period_axis(df), 20), [], T.fit_units
    for module in (E, T):
        monkeypatch.setattr(module, "fit_units", lambda d, t, f, units, kind="random_forest", *a, **k: (fits.append((kind, len(units))), plain(d, t, f, units, kind, *a, **k))[1])
    small = {"rounds": 3, "depth": 2}
    _, scores = S.run_all_fs(df, names, "y", plan, top_k=3, forest={"trees": 3, "depth": 2}, gbt=small)
    windows = len(windows_of(plan))
    assert [n for kind, n in fits if kind == "gbt"] == [windows + 1]   # the folds and the embedded method together
    got = {r["feature"]: r["score"] for r in scores.where("category = 'embedded' AND method = 'gbt'").collect()}
    want = E.tree_select(df, names, "y", "gbt", 3, **small).toPandas().set_index("feature").importance
    assert got == pytest.approx(want.to_dict(), abs=1e-9)


def test_boosting_counts_codes_of_several_features():
    cuts = [np.arange(31.0), np.arange(10.0), np.array([0.5]), np.arange(20.0), np.array([]), np.arange(8.0)]
    fields = T.code_fields(cuts)
    assert max(g for g, _, _ in fields) == 1 and all(shift + bits <= T.CODE for _, shift, bits in fields)   # 20 bits in two codes
    rng = np.random.default_rng(3)
    n, p, left = 900, len(cuts), []
    x = np.stack([rng.integers(0, len(c) + 1, n) for c in cuts], axis=1).astype(np.uint8)
    y, order = rng.normal(size=n), np.sort(rng.integers(0, 10, n))
    tree = T._Tree(0, -1, 7)
    tree.feature[:127], tree.cut[:127] = rng.integers(-1, p, 127), rng.integers(0, 8, 127)
    tree.feature[[4, 9]], tree.feature[0] = -1, 0
    for level in (0, 1, 3, 4, 5, 6):
        blocks = [T._load({"n": n, "x": x.tobytes(), "y": y.tobytes(), "ord": order.astype("<i8").tobytes()}, fields, [(0, 7)])] * 2
        width = 1 << level
        active = rng.permutation(width).astype(np.int64) if level else None
        if level:
            active[rng.integers(0, width)] = -1
            nodes = int(active.max()) + 1
        else:
            nodes = 1
        slots, m = np.tile(np.arange(p), (nodes, 1)), int((order <= 7).sum())
        found = dict(T._histograms(blocks, [(0, -1, False, T.Route(tree.feature, tree.cut, level), active, slots)], level, fields))[0]
        want = np.zeros((2, nodes, p, T.BINS))
        for r in range(m):
            i = 0
            for _ in range(level):
                f = tree.feature[i]
                i = 2 * i + 1 + int(f >= 0 and x[r, f] > tree.cut[i])
            at = active[i - width + 1] if level else 0
            if at >= 0:
                want[:, at, np.arange(p), x[r]] += np.array([[2.0 if level else 0.0], [2 * y[r]]])
        assert (found[0] == want[0]).all() and np.allclose(found[1], want[1])
        np.testing.assert_array_equal(T._tally(blocks[0], fields)[0][1], np.stack([np.bincount(x[:m, f], minlength=T.BINS) for f in range(p)]))


def test_boosting_leaves_no_files(spark, data):
    import glob

    from panelmill.session import run_folder, shared_folder

    _, df = data
    kept = lambda: {*glob.glob(f"{shared_folder(spark)}/*/rdd-*"), *glob.glob(f"{run_folder(spark)}/settled-*")}
    before = kept()
    T.fit_units(df, "y", FEATS, [(0, 29, {"rounds": 23, "depth": 1})], "gbt", cuts=CUTS)
    assert kept() == before


def test_forests_count_nodes_as_they_count_slots(monkeypatch):
    rng = np.random.default_rng(8)
    n, p, k = 3000, 14, 7
    x, y, order = rng.integers(0, T.BINS, (n, p)).astype(np.uint8), rng.normal(size=n), np.sort(rng.integers(0, 9, n))
    row = {"n": n, "x": x.tobytes(), "y": y.tobytes(), "ord": order.astype("<i8").tobytes(), "h": rng.integers(0, 1 << 63, n).astype("<u8").tobytes()}
    tree = T._Tree(0, 0, 5)
    tree.feature[:31], tree.cut[:31] = rng.integers(0, p, 31), rng.integers(0, 31, 31)
    for level in (0, 1, 3, 4):
        width = 1 << level
        active = None if level < 3 else np.where(np.arange(width) % 3 == 1, -1, np.cumsum(np.arange(width) % 3 != 1) - 1)
        slots = np.stack([T._subset(1, 0, 0, i, p, k) for i in range(width if active is None else int(active.max()) + 1)])
        count = lambda: dict(T._counted(T._pack([row], p, [(0, 6)]), [(0, 0, True, T.Route(tree.feature, tree.cut, level), active, slots)], level, 1))[0]
        monkeypatch.undo()
        found = [count()]
        monkeypatch.setattr(T, "PAIRED", 0)
        found.append(count())
        monkeypatch.setattr(T, "NEAR", 0)
        want = count()
        assert want[0].sum() > 0 and all((f[0] == want[0]).all() and np.allclose(f[1], want[1]) for f in found)


def test_boruta_shuffles_rows_once(spark, monkeypatch):
    from panelmill.operators import distributed as X

    rng = np.random.default_rng(4)
    d = pd.DataFrame({"id": np.arange(300), "a": rng.normal(size=300), "b": rng.normal(size=300)})
    d["y"] = d.a + 0.1 * rng.normal(size=300)
    df, dealt, plain = spark.createDataFrame(d), [], X.dealt
    monkeypatch.setattr(X, "dealt", lambda *a: (dealt.append(1), plain(*a))[1])
    E.boruta(df, ["a", "b"], "y", ["id"], rounds=3, trees=3, depth=2)
    assert len(dealt) == 1
    for r in range(2):   # what a round uses is what ``permuted`` gives
        one, two = (t.select("a", "b", "y", "__p").toPandas().sort_values(["a", "b"]).reset_index(drop=True) for t in (
            X.exchanged(plain(df, ["a", "b"], ["id"]), ["a", "b"], seed=42, only=r), X.permuted(df, ["a", "b"], ["id"], r + 1, 42, only=r)))
        pd.testing.assert_frame_equal(one, two)


def test_attributions_are_summed_and_not_written(spark, data, monkeypatch):
    d, df = data
    model = T.fit_trees(df, "y", FEATS, "gbt", cuts=CUTS, rounds=3, depth=2)
    written, plain = [], A.settle
    monkeypatch.setattr(A, "settle", lambda t: (written.append(plain(t)), written[-1])[1])
    parts = {"early": (None, "2001-01-01"), "late": ("2000-06-01", None)}   # they overlap
    got = A.tree_report(df.withColumn("id", F.monotonically_increasing_id()), FEATS, "y", model, ["id"], 2, regimes=parts).where("section <> 'permutation'").toPandas()
    assert [t.count() for t in written] == [d.period.dt.to_period("M").nunique() * len(FEATS)]   # sums by period only
    phi = A.tree_shap(df, FEATS, model).select("period", *[f"phi_{f}" for f in FEATS]).toPandas()
    phi["period"] = pd.to_datetime(phi.period)
    value = lambda section, part, f: got[(got.section == section) & (got.part == part) & (got.feature == f)].value.item()
    for f in FEATS:
        size = phi[f"phi_{f}"].abs()
        assert value("attribution", "all", f) == pytest.approx(size.mean(), abs=1e-12)
        assert value("regime", "early", f) == pytest.approx(size[phi.period < "2001-01-01"].mean(), abs=1e-12)
        assert value("regime", "late", f) == pytest.approx(size[phi.period >= "2000-06-01"].mean(), abs=1e-12)
        assert value("season", "Q2", f) == pytest.approx(size[phi.period.dt.quarter == 2].mean(), abs=1e-12)


def test_importances_of_nothing_and_of_nulls(spark):
    phi = spark.createDataFrame([("a", 1.0, None), ("a", -3.0, None), (None, 2.0, None)], "k string, phi_x double, phi_z double")
    rows = lambda t: sorted((r["feature"], r["importance"], r["n_samples"]) for r in t.collect())
    assert rows(A.mean_abs_importance(phi, ["x", "z"])) == [("x", 2.0, 3), ("z", None, 0)]
    assert rows(A.mean_abs_importance(phi, ["x"], ["k"])) == [("x", 2.0, 1), ("x", 2.0, 2)]
    assert rows(A.mean_abs_importance(phi.where("false"), ["x", "z"])) == []
