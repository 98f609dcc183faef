"""Attribution of forecasts to features, by regime and season."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.period import season_label
from ..session import settle
from .distributed import null_safe, permuted
from .gram import complete
from .trees import TreeModel, bit, reach

TABLED = 6   # features of a path whose patterns are all worked out at once

# Default regimes as half-open date ranges.
REGIMES = {"pre_covid": (None, "2020-01-01"), "covid": ("2020-01-01", "2022-01-01"), "post_covid": ("2022-01-01", None)}


def linear_shap(df: DataFrame, features: Sequence[str], fit: DataFrame, by: Sequence[str] = (), prefix: str = "phi_") -> DataFrame:
    """β·(x − mean) per row and feature: exact for a linear model.

    ``fit`` is one row per group (see ``fit_final_ridge``).
    """
    coef = fit.select(*by, F.struct("beta", "means").alias("__f"))
    rows = null_safe(df, coef, list(by), "left") if by else df.withColumn("__f", coef.select("__f").scalar())
    phi = [(F.get(F.col("__f.beta"), F.lit(i)) * (F.col(f) - F.get(F.col("__f.means"), F.lit(i)))).alias(prefix + f) for i, f in enumerate(features)]
    return rows.select(*df.columns, *phi)


def attribution_long(df: DataFrame, features: Sequence[str], ids: Sequence[str] = (), prefix: str = "phi_") -> DataFrame:
    wide = df.select(*ids, *[F.col(prefix + f).alias(f) for f in features])
    return wide.unpivot(list(ids), list(features), "feature", "phi")


def abs_sums(df: DataFrame, features: Sequence[str], by: Sequence[str] = (), prefix: str = "phi_", more: Sequence[Column] = ()) -> DataFrame:
    """``(by…, feature, total, n)`` and ``more`` aggregates of a group: sums of |φ| and how many there are, from one pass over the values."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.sum(F.abs(F.col(prefix + f))).alias("total"), F.count(F.col(prefix + f)).alias("n")) for f in features])
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__rows"), cells.alias("__cells"), *more).where("__rows > 0")
    return wide.select(*by, F.inline("__cells"), *wide.columns[len(by) + 2:])


def _shares(sums: DataFrame, by: Sequence[str], min_rows: int = 0) -> DataFrame:
    imp = sums.groupBy(*by, "feature").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("importance"), F.sum("n").alias("n_samples"))
    imp = imp.where(F.col("n_samples") >= min_rows)
    total = F.sum("importance").over(W.partitionBy(*by))
    return imp.withColumn("importance_normalized", F.try_divide(F.col("importance"), total))


def mean_abs_importance(df: DataFrame | None, features: Sequence[str], by: Sequence[str] = (), prefix: str = "phi_", sums: DataFrame | None = None) -> DataFrame:
    """Mean |φ| per feature and its share of the total, largest first; ``sums``: the rows' ``abs_sums`` where they are known."""
    return _shares(abs_sums(df, features, by, prefix) if sums is None else sums, by).orderBy(*by, F.desc("importance"), "feature")


def regime_of(regimes: Mapping[str, tuple], period: str = "period") -> Column:
    """All regimes a period belongs to, as an array (regimes may overlap)."""
    d = F.col(period).cast("date")
    tests = []
    for name, (lo, hi) in regimes.items():
        ok = F.lit(True)
        if lo is not None:
            ok = ok & (d >= F.lit(lo).cast("date"))
        if hi is not None:
            ok = ok & (d < F.lit(hi).cast("date"))
        tests.append(F.when(ok, F.lit(name)))
    return F.array_compact(F.array(*tests))


def importance_by_regime(df: DataFrame | None, features: Sequence[str], regimes: Mapping[str, tuple] = REGIMES, period: str = "period",
                         min_rows: int = 5, prefix: str = "phi_", sums: DataFrame | None = None) -> DataFrame:
    """``sums``: the rows' ``abs_sums`` by period where they are known."""
    tagged = (df if sums is None else sums).withColumn("regime", F.explode(regime_of(regimes, period)))
    return _shares(abs_sums(tagged, features, ["regime"], prefix) if sums is None else tagged, ["regime"], min_rows)


def importance_by_season(df: DataFrame | None, features: Sequence[str], period: str = "period", min_rows: int = 3, prefix: str = "phi_", sums: DataFrame | None = None) -> DataFrame:
    """``sums``: the rows' ``abs_sums`` by period where they are known."""
    tagged = (df if sums is None else sums).withColumn("quarter", season_label(F.col(period)))
    return _shares(abs_sums(tagged, features, ["quarter"], prefix) if sums is None else tagged, ["quarter"], min_rows)


def season_pivot(by_season: DataFrame, top: int | None = None) -> DataFrame:
    """Feature × quarter matrix by falling mean importance (of the ``top`` features if given)."""
    wide = by_season.groupBy("feature").pivot("quarter", ["Q1", "Q2", "Q3", "Q4"]).agg(F.first("importance"))
    filled = wide.select("feature", *[F.col(q) for q in ("Q1", "Q2", "Q3", "Q4")])
    mean = sum((F.coalesce(F.col(q), F.lit(0.0)) for q in ("Q1", "Q2", "Q3", "Q4")), F.lit(0.0)) / F.greatest(
        F.lit(1), sum((F.col(q).isNotNull().cast("int") for q in ("Q1", "Q2", "Q3", "Q4")), F.lit(0)))
    ordered = filled.withColumn("mean", mean).orderBy(F.desc("mean"), "feature")
    return ordered if top is None else ordered.limit(top)


def permutation_importance(df: DataFrame, features: Sequence[str], target: str, model, ids: Sequence[str], repeats: int = 10, seed: int = 42) -> DataFrame:
    """Rise of the MAE when one column changes rows (positive = useful feature), for a linear fit or a tree model.

    ``model`` is a one-row fit (see ``fit_final_ridge``) or a ``TreeModel``. ``permuted`` gives every row the values of
    ``repeats`` others in one shuffle, whatever the layout; all features and repeats are scored in one pass.
    """
    feats = list(features)
    rows = permuted(complete(df.select(*dict.fromkeys([*ids, *feats, target])), [*feats, target]), feats, ids, repeats, seed)
    if isinstance(model, TreeModel):
        per = _tree_rises(rows, feats, target, model, repeats)
    else:
        coef = model.select(F.struct("beta", "intercept").alias("__f"))
        pairs = rows.select(*feats, target, F.posexplode("__p").alias("repeat", "__o")).withColumn("__f", coef.scalar())
        pred = F.col("__f.intercept")
        for i, f in enumerate(feats):
            pred = pred + F.get(F.col("__f.beta"), F.lit(i)) * F.col(f)
        e = pairs.withColumn("__e", F.col(target) - pred)
        rise = [F.avg(F.abs(F.col("__e") - F.get(F.col("__f.beta"), F.lit(i)) * (F.col("__o")[f] - F.col(f))) - F.abs("__e")).alias(f"d{i}") for i, f in enumerate(feats)]
        cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"d{i}").alias("rise")) for i, f in enumerate(feats)])
        per = e.groupBy("repeat").agg(*rise).select("repeat", F.inline(cells))
    return per.groupBy("feature").agg(F.avg("rise").alias("importance_mean"), F.stddev_pop("rise").alias("importance_std")).orderBy(F.desc("importance_mean"), "feature")


def _values(batch: pa.RecordBatch, column: int, width: int) -> np.ndarray:
    """An array column of doubles as rows x ``width``."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _doubles(columns: Sequence[Column]) -> Column:
    return F.array(*[c.cast("double") for c in columns])


def _tree_rises(rows: DataFrame, feats: list[str], target: str, model: TreeModel, repeats: int) -> DataFrame:
    """(repeat, feature, rise): every task adds up the errors of its rows, then the sums meet."""
    p = len(feats)
    wide = rows.select(_doubles([F.col(f) for f in feats]).alias("x"), F.col(target).cast("double").alias("y"),
                       F.flatten(F.transform("__p", lambda o: _doubles([o[f] for f in feats]))).alias("o"))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total, n = shared.value, np.zeros((repeats, p)), 0
        for batch in batches:
            x, y, other = _values(batch, 0, p), batch.column(1).to_numpy(), _values(batch, 2, repeats * p)
            bins = np.ascontiguousarray(m.bins(x).T)
            mixed = [np.stack([np.searchsorted(m.cuts[k], other[:, r * p + k]) for r in range(repeats)]).astype(np.uint8) for k in range(p)]
            left = y - m.score(bins)
            n += len(y)
            for k, change in enumerate(_changes(m, bins, mixed)):
                if change is not None:
                    total[:, k] += (np.abs(left - change) - np.abs(left)).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(repeats), p)), pa.array(np.tile(np.arange(p), repeats)), pa.array(total.ravel()), pa.array(np.full(repeats * p, n))], names=["repeat", "k", "total", "n"])

    sums = wide.mapInArrow(run, "repeat long, k long, total double, n long").groupBy("repeat", "k").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("rise"))
    return sums.select("repeat", F.get(F.array(*[F.lit(f) for f in feats]), F.col("k")).alias("feature"), "rise")


def _changes(model: TreeModel, bins: np.ndarray, mixed: Sequence[np.ndarray]) -> list[np.ndarray | None]:
    """For each feature the change of the prediction (repeats x rows) when its bins are those of ``mixed``; None if no tree uses it.

    What the other features leave open in a tree is made once; a change of one feature meets that.
    """
    out: list[np.ndarray | None] = [None] * len(mixed)
    flat, n = bins.ravel(), bins.shape[1]
    for route, leaf in model.routes():
        if route.levels > route.top:   # deeper than a word: step by step
            before = leaf.take(reach(route, flat, n, 0, n))
            for f in route.used:
                turned = bins.copy()
                change = np.empty(mixed[f].shape)
                for r, own in enumerate(mixed[f]):
                    turned[f] = own
                    change[r] = leaf.take(reach(route, turned.ravel(), n, 0, n)) - before
                out[f] = change if out[f] is None else out[f] + change
            continue
        leaf, met = leaf[(1 << route.top) - 1:], [t.take(bins[f]) for f, t in route.tables]
        after = met[:]   # what this and the later features leave open
        for j in range(len(met) - 2, -1, -1):
            after[j] = met[j] & after[j + 1]
        if not met:
            continue
        before, upto = leaf.take(bit(after[0])), None
        for j, (f, table) in enumerate(route.tables):
            rest = upto if j == len(met) - 1 else after[j + 1] if upto is None else upto & after[j + 1]
            open_ = table.take(mixed[f])
            change = leaf.take(bit(open_ if rest is None else open_ & rest)) - before
            if out[f] is None:
                out[f] = change
            else:
                out[f] += change
            upto = met[j] if upto is None else upto & met[j]
    return out


def _with_columns(df: DataFrame, feats: Sequence[str], extra: Sequence[Column], make, names: Sequence[str]) -> DataFrame:
    """``df`` with columns that ``make(x, batch, first extra column)`` computes from the features, rows where they are."""
    columns = df.columns
    wide = complete(df, feats).select(*columns, _doubles([F.col(f) for f in feats]).alias("__x"), *extra)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = make(_values(batch, len(columns), len(feats)), batch, len(columns) + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(columns)], *[pa.array(c) for c in found]], names=[*columns, *names])

    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{n}` double" for n in names])
    return wide.mapInArrow(run, kinds)


def tree_shap(df: DataFrame, features: Sequence[str], model: TreeModel, prefix: str = "phi_") -> DataFrame:
    """Exact path-dependent Shapley values of a tree model (Lundberg et al. 2020): one column for each feature.

    The value of a set of features is the mean leaf reached when unknown features follow both branches by their train rows.
    The values of a row add up to its prediction less ``expected_value``. Paths to leaves are flattened once; whether a row
    meets a path's condition on each feature makes a pattern, and rows of one pattern share their values. No shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(leaf_paths(model))
    feats = list(features)
    binned = df.sparkSession.sparkContext.broadcast(model)

    def make(x: np.ndarray, batch: pa.RecordBatch, extra: int) -> list[np.ndarray]:
        return list(shap_values(shared.value, binned.value.bins(x).T, len(feats)))

    return _with_columns(df, feats, [], make, [prefix + f for f in feats])


def leaf_paths(model: TreeModel) -> list[tuple]:
    """(value, features, bins above, bins up to, shares, table) of every leaf: its conditions, merged by feature, the share of
    train rows that each one's branches hold, and the values of all patterns of conditions met (None for more than TABLED features)."""
    out = []
    for t in range(len(model.feature)):
        stack = [(0, {})]
        while stack:
            node, seen = stack.pop()
            f = int(model.feature[t, node])
            if f < 0:
                if seen:
                    fs = sorted(seen)
                    low, high, share = (np.array([seen[k][i] for k in fs]) for i in range(3))
                    worth = model.scale * model.value[t, node]
                    table = worth * path_shares((np.arange(1 << len(fs))[:, None] >> np.arange(len(fs)) & 1).astype(float), share) if len(fs) <= TABLED else None
                    out.append((worth, fs, low, high, share, None if table is None else np.ascontiguousarray(table.T)))
                continue
            low, high, share = seen.get(f, (-1, 255, 1.0))
            c = int(model.cut[t, node])
            for child, a, b in ((2 * node + 1, low, min(high, c)), (2 * node + 2, max(low, c), high)):
                stack.append((child, {**seen, f: (a, b, share * model.cover[t, child] / model.cover[t, node])}))
    return out


def expected_value(model: TreeModel) -> float:
    """Mean prediction over the train rows of the trees."""
    total = model.base
    for t in range(len(model.feature)):
        at = [i for i in range(model.feature.shape[1]) if model.feature[t, i] < 0 and (i == 0 or model.feature[t, (i - 1) // 2] >= 0)]
        total += model.scale * float(np.average(model.value[t, at], weights=model.cover[t, at]))
    return total


def path_shares(met: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley shares (patterns x features) of a leaf of value 1, for patterns of conditions met and the branch shares.

    A set's worth is the product of what its members meet and the others' shares; the sets of each size are added up as a
    polynomial over the other features.
    """
    u, m = met.shape
    out = np.zeros((u, m))
    weight = np.array([math.factorial(s) * math.factorial(m - 1 - s) / math.factorial(m) for s in range(m)])
    for j in range(m):
        c = np.zeros((u, m))
        c[:, 0] = 1
        for k in range(m):
            if k != j:
                c[:, 1:] = c[:, 1:] * share[k] + c[:, :-1] * met[:, k, None]
                c[:, 0] *= share[k]
        out[:, j] = (met[:, j] - share[j]) * (c @ weight)
    return out


def shap_values(paths: Sequence[tuple], bins: np.ndarray, width: int) -> np.ndarray:
    """Features x rows, from bins as features x rows."""
    out, n = np.zeros((width, bins.shape[1])), bins.shape[1]
    bins = np.ascontiguousarray(bins)
    for value, fs, low, high, share, table in paths:
        if table is not None:   # conditions as bits of a byte
            byte = np.zeros(n, dtype=np.uint8)
            for k, f in enumerate(fs):
                byte |= ((bins[f] > low[k]) & (bins[f] <= high[k])).view(np.uint8) << np.uint8(k)
            pattern = byte.astype(np.int64)
        else:
            pattern = np.zeros(n, dtype=np.int64)
            for k, f in enumerate(fs):
                pattern |= ((bins[f] > low[k]) & (bins[f] <= high[k])).astype(np.int64) << k
            seen = np.flatnonzero(np.bincount(pattern, minlength=1 << len(fs)))
            table = np.zeros((len(fs), 1 << len(fs)))
            table[:, seen] = value * path_shares((seen[:, None] >> np.arange(len(fs)) & 1).astype(float), share).T
        for k, f in enumerate(fs):
            out[f] += table[k].take(pattern)
    return out


def sampled_shapley(df: DataFrame, features: Sequence[str], model: TreeModel, ids: Sequence[str], permutations: int = 5, seed: int = 42) -> DataFrame:
    """Shapley values of a fitted model against other rows as background, by sampled orders.

    Each row is paired with ``permutations`` background rows (see ``permuted``) and walks from each through a feature order,
    switching one feature at a time to its own value; the steps' prediction changes are averaged (Štrumbelj & Kononenko
    2014). Columns of ``ids``, phi_<feature>, f_x and f_background; the values of a row add up to f_x - f_background.
    """
    feats, p = list(features), len(features)
    rows = permuted(complete(df.select(*dict.fromkeys([*ids, *feats])), feats), feats, ids, permutations, seed)
    rng = np.random.default_rng(seed)
    orders = [rng.permutation(p).tolist() for _ in range(permutations)]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make(x: np.ndarray, batch: pa.RecordBatch, extra: int) -> list[np.ndarray]:
        other, m = _values(batch, extra, permutations * p), shared.value
        bins = np.ascontiguousarray(m.bins(x).T)
        phi, start, own = np.zeros((p, len(x))), np.zeros(len(x)), m.score(bins)
        for r, order in enumerate(orders):
            walk = np.ascontiguousarray(m.bins(other[:, r * p:(r + 1) * p]).T)
            before = m.score(walk)
            start += before
            for k in order:
                walk[k] = bins[k]
                after = m.score(walk)
                phi[k] += after - before
                before = after
        return [*(phi / permutations), own, start / permutations]

    others = F.flatten(F.transform("__p", lambda o: _doubles([o[f] for f in feats])))
    out = _with_columns(rows, feats, [others.alias("__o")], make, [*[f"phi_{f}" for f in feats], "f_x", "f_background"])
    return out.select(*ids, *[f"phi_{f}" for f in feats], "f_x", "f_background")


def concentration_topk(importances: DataFrame, k: int = 5, by: Sequence[str] = (), fold: str = "fold_id", value: str = "importance") -> DataFrame:
    """Share of the mean importance that the k largest features hold."""
    mean = importances.groupBy(*by, "feature").agg(F.avg(value).alias("m"))
    pos = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("m"), "feature"))
    return mean.withColumn("__p", pos).groupBy(*by).agg(
        F.coalesce(F.try_divide(F.sum(F.when(F.col("__p") <= k, F.col("m"))), F.sum("m")), F.lit(0.0)).alias("concentration"))


def _consecutive(importances: DataFrame, by: Sequence[str], fold: str) -> DataFrame:
    ids = importances.select(*by, fold).distinct()
    return ids.withColumn("__i", F.row_number().over(W.partitionBy(*by).orderBy(fold)))


def fold_rank_correlation(importances: DataFrame, by: Sequence[str] = (), fold: str = "fold_id", value: str = "importance", min_common: int = 3) -> DataFrame:
    """Mean rank correlation of the importances of consecutive folds."""
    seq = null_safe(importances.select(*by, fold, "feature", F.col(value).alias("v")), _consecutive(importances, by, fold), [*by, fold])
    a = seq.select(*by, F.col("__i").alias("i"), "feature", F.col("v").alias("a"))
    b = seq.select(*by, (F.col("__i") - 1).alias("i"), "feature", F.col("v").alias("b"))
    pairs = null_safe(a, b, [*by, "i", "feature"])
    for c in ("a", "b"):
        w, t = W.partitionBy(*by, "i").orderBy(c), W.partitionBy(*by, "i", c)
        pairs = pairs.withColumn(f"r{c}", F.rank().over(w) + (F.count(F.lit(1)).over(t) - 1) / 2)
    per = pairs.groupBy(*by, "i").agg(F.nanvl(F.corr("ra", "rb"), F.lit(None).cast("double")).alias("r"), F.count(F.lit(1)).alias("c"))
    return per.groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col("c") >= min_common, F.col("r"))), F.lit(0.0)).alias("rank_correlation"))


def fold_topk_jaccard(importances: DataFrame, k: int = 5, by: Sequence[str] = (), fold: str = "fold_id", value: str = "importance") -> DataFrame:
    """Mean overlap of the top-k sets of consecutive folds."""
    pos = F.row_number().over(W.partitionBy(*by, fold).orderBy(F.desc(value), "feature"))
    tops = importances.withColumn("__p", pos).where(F.col("__p") <= k).groupBy(*by, fold).agg(F.collect_set("feature").alias("t"))
    seq = tops.withColumn("__prev", F.lag("t").over(W.partitionBy(*by).orderBy(fold))).where(F.col("__prev").isNotNull())
    j = F.size(F.array_intersect("t", "__prev")) / F.size(F.array_union("t", "__prev"))
    return seq.groupBy(*by).agg(F.avg(j).alias("topk_jaccard"))


def _sections(phi: DataFrame, features: Sequence[str], regimes: Mapping[str, tuple]) -> list[DataFrame]:
    """Attribution over all rows, by regime and by season, from the values' sums by period: one pass, and no value is written."""
    sums = settle(abs_sums(phi, features, ["period"]))
    return [
        mean_abs_importance(None, features, sums=sums).select(F.lit("attribution").alias("section"), F.lit("all").alias("part"), "feature", F.col("importance").alias("value")),
        importance_by_regime(None, features, regimes, sums=sums).select(F.lit("regime").alias("section"), F.col("regime").alias("part"), "feature", F.col("importance").alias("value")),
        importance_by_season(None, features, sums=sums).select(F.lit("season").alias("section"), F.col("quarter").alias("part"), "feature", F.col("importance").alias("value")),
    ]


def _report(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for t in parts[1:]:
        out = out.unionByName(t)
    return out


def interpretation_report(df: DataFrame, features: Sequence[str], target: str, fit: DataFrame, ids: Sequence[str], repeats: int = 10, seed: int = 42,
                          regimes: Mapping[str, tuple] = REGIMES) -> DataFrame:
    """Tidy report of a linear champion: coefficients, permutation, attribution, regime, season."""
    from .modelling import coefficient_table

    phi = linear_shap(complete(df, [*features, target]), features, fit)
    return _report([
        coefficient_table(fit, features).select(F.lit("coefficient").alias("section"), F.lit("all").alias("part"), "feature", F.col("coefficient").alias("value")),
        permutation_importance(df, features, target, fit, ids, repeats, seed).select(F.lit("permutation").alias("section"), F.lit("all").alias("part"), "feature", F.col("importance_mean").alias("value")),
        *_sections(phi, features, regimes)])


def tree_report(df: DataFrame, features: Sequence[str], target: str, model: TreeModel, ids: Sequence[str], repeats: int = 10, seed: int = 42,
                regimes: Mapping[str, tuple] = REGIMES) -> DataFrame:
    """The same for a tree champion: importance by gain, permutation, exact attribution, regime, season."""
    spark = df.sparkSession
    phi = tree_shap(df.select("period", *features), features, model)
    gains = spark.createDataFrame([("importance", "all", f, float(v)) for f, v in zip(model.features, model.importances())], "section string, part string, feature string, value double")
    return _report([gains, permutation_importance(df, features, target, model, ids, repeats, seed).select(F.lit("permutation").alias("section"), F.lit("all").alias("part"), "feature", F.col("importance_mean").alias("value")),
                    *_sections(phi, features, regimes)])
