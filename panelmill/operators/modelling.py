"""Ridge and tree models, walk-forward backtests and final fits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .distributed import null_safe
from .folds import fold_periods
from .gram import Gram, Moments, complete, gram, per_group, prefix_gram, windows_of
from .trees import TreeModel, fit_trees, fit_units, predict_by


def ridge_solve(m: Moments, feats: Sequence[int], y: int, alpha: float = 1.0, standardize: bool = True):
    """(intercept, beta, beta on the standardised scale) from centred products.

    Standardised: population std, the intercept is not penalised. Raw scale is
    solved in standardised coordinates with the penalty scaled accordingly.
    """
    f = np.asarray(feats, dtype=int)
    sd = np.where(m.sd[f] > 0, m.sd[f], 1.0)
    a = m.cross[np.ix_(f, f)] / np.outer(sd, sd)
    b = m.cross[f, y] / sd
    penalty = np.full(len(f), alpha) if standardize else alpha / sd**2
    std = np.linalg.solve(a + np.diag(penalty), b) if len(f) else np.zeros(0)
    beta = std / sd
    return float(m.mean[y] - beta @ m.mean[f]), beta, std


def elastic_net_solve(m: Moments, feats: Sequence[int], y: int, alpha: float, l1_ratio: float = 1.0, start: np.ndarray | None = None,
                      scale: np.ndarray | None = None, tol: float = 1e-10, max_iter: int = 10000) -> np.ndarray:
    """Coordinate descent on covariances; coefficients of standardised features.

    Minimises ‖y − Xb‖²/2n + α·ρ·‖b‖₁ + α(1 − ρ)/2·‖b‖² (Friedman et al. 2010).
    """
    f = np.asarray(feats, dtype=int)
    sd = scale if scale is not None else np.where(m.sd[f] > 0, m.sd[f], 1.0)
    q = m.cross[np.ix_(f, f)] / np.outer(sd, sd) / m.n
    c = m.cross[f, y] / sd / m.n
    beta = np.zeros(len(f)) if start is None else start.copy()
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    grad = c - q @ beta
    for _ in range(max_iter):
        moved = 0.0
        for k in range(len(f)):
            if q[k, k] == 0:
                continue
            z = grad[k] + q[k, k] * beta[k]
            new = np.sign(z) * max(abs(z) - l1, 0.0) / (q[k, k] + l2)
            d = new - beta[k]
            if d:
                beta[k] = new
                grad -= q[:, k] * d
                moved = max(moved, abs(d))
        if moved < tol:
            break
    return beta


def fold_moments(df: DataFrame, cols: Sequence[str], plan: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population std of every train window, from one scan (for scalers)."""
    g = prefix_gram(df, cols, windows_of(plan), keys)
    fields = _key_fields(df, keys) + ["train_start_ord bigint", "train_end_ord bigint"] + [f"`mean_{c}` double, `std_{c}` double" for c in cols]

    def fn(key, m: Moments) -> pd.DataFrame:
        vals = [x for i in range(len(cols)) for x in (m.mean[i], m.sd[i])]
        return pd.DataFrame([[*key, *vals]], columns=[*g_by, *[f"{s}_{c}" for c in cols for s in ("mean", "std")]])

    g_by = g.by
    return per_group(g, fn, ", ".join(fields))


def _key_fields(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema] if keys else []


def ridge_fits(df: DataFrame, target: str, features: Sequence[str], windows: Sequence[tuple[int, int]], keys: Sequence[str] = (),
               options: Mapping[str, Sequence[str]] | None = None, alphas: Sequence[float] = (1.0,), engine: str = "auto") -> DataFrame:
    """Ridge coefficients per train window, feature option and penalty (lazy).

    ``(keys…, train_start_ord, train_end_ord, fs_option, alpha, n, intercept,
    beta, beta_std, means)``; beta has one entry per feature, 0 where it is not used.
    """
    features = list(features)
    opts = {k: [features.index(f) for f in v] for k, v in (options or {"all": features}).items()}
    g = prefix_gram(df, [*features, target], windows, keys, engine)
    p = len(features)
    by = g.by

    def fn(key, m: Moments) -> pd.DataFrame:
        out = []
        for name, idx in opts.items():
            for a in alphas:
                b0, b, bs = ridge_solve(m, idx, p, a)
                full, full_std = np.zeros(p), np.zeros(p)
                full[idx], full_std[idx] = b, bs
                out.append([*key, name, float(a), int(m.n), b0, full, full_std, m.mean[:p]])
        return pd.DataFrame(out, columns=[*by, "fs_option", "alpha", "n", "intercept", "beta", "beta_std", "means"])

    schema = ", ".join([*_key_fields(df, keys), "train_start_ord bigint", "train_end_ord bigint", "fs_option string", "alpha double",
                        "n bigint", "intercept double", "beta array<double>", "beta_std array<double>", "means array<double>"])
    return per_group(g, fn, schema)


def linear_score(features: Sequence[str], beta: str = "beta", intercept: str = "intercept") -> Column:
    """Prediction as plain column arithmetic (stays in codegen)."""
    out = F.col(intercept)
    for i, f in enumerate(features):
        out = out + F.get(F.col(beta), F.lit(i)) * F.col(f)
    return out


def backtest_ridge(df: DataFrame, target: str, features: Sequence[str], plan: DataFrame, keys: Sequence[str] = (),
                   options: Mapping[str, Sequence[str]] | None = None, alphas: Sequence[float] = (1.0,), carry: Sequence[str] = (),
                   model: str = "ridge", engine: str = "auto") -> DataFrame:
    """Refit per fold and predict its test rows: one pass for all folds and options.

    Train statistics come from cumulative Gram matrices; test rows meet folds by
    their ordinal and coefficients by the fold's train end, both equi-joins.
    """
    rows = complete(df.select(*dict.fromkeys([*keys, *carry, "period", "ord", target, *features])), [target, *features])
    fits = ridge_fits(rows, target, features, windows_of(plan), keys, options, alphas, engine)
    tests = rows.join(fold_periods(plan), "ord")
    # written first, so that its size is known and the test rows need not be shuffled to meet it
    slim = settle(fits.select(*keys, "train_end_ord", "fs_option", "alpha", "intercept", "beta"))
    scored = null_safe(tests, slim, [*keys, "train_end_ord"])
    return scored.select(*dict.fromkeys([*keys, *carry]), F.lit(model).alias("model"), "fs_option", "alpha", "fold_id", "horizon", "period",
                         F.col(target).alias("actual"), linear_score(features).alias("predicted"))


def backtest_tree(df: DataFrame, target: str, features: Sequence[str], plan: DataFrame, kind: str = "random_forest", keys: Sequence[str] = (),
                  seed: int = 42, candidates: Sequence[Mapping] | None = None, cuts: Sequence[np.ndarray] | None = None, max_series: int = 1000, **params) -> DataFrame:
    """Refit per key and distinct train window, and predict the test rows of all folds; see ``trees.fit_units``.

    All windows, keys and ``candidates`` (parameter sets; the rows then have a column ``cand``) grow in the same passes, and
    rows are scored where they lie. With ``keys`` every series has its own models; more than ``max_series`` are an error,
    as models are held on the driver. A series without train rows in a window has no prediction there.
    """
    rows = complete(df.select(*dict.fromkeys([*keys, "period", "ord", target, *features])), [target, *features])
    spark, windows = df.sparkSession, windows_of(plan)
    shift, series = 1 << 40, 1
    if keys:
        names = rows.select(*keys).distinct().orderBy(*keys).limit(max_series + 1).collect()
        if len(names) > max_series:
            raise ValueError(f"more than {max_series} series")
        series = max(1, len(names))
        index = spark.createDataFrame([(*r, i) for i, r in enumerate(names)], ", ".join([*_key_fields(df, keys), "__k bigint"]))
        rows = null_safe(rows, index, list(keys))
    else:
        rows = rows.withColumn("__k", F.lit(0).cast("bigint"))
    sets = [dict(c) for c in candidates] if candidates is not None else [dict(params)]
    units = [(k * shift + a, k * shift + b, c) for c in sets for k in range(series) for a, b in windows]
    models = fit_units(rows.withColumn("ord", F.col("__k") * shift + F.col("ord")), target, features, units, kind, seed, cuts)
    place = spark.createDataFrame([(e, i) for i, (_, e) in enumerate(windows)], "train_end_ord bigint, __w bigint")
    # written first, so that its size is known and the test rows need not be shuffled to meet it
    tests = rows.join(settle(fold_periods(plan).join(place, "train_end_ord")), "ord")
    if candidates is not None:
        tests = tests.withColumn("cand", F.explode(F.sequence(F.lit(0), F.lit(len(sets) - 1))))
        keys = ["cand", *keys]
    which = (F.col("cand") * series if candidates is not None else F.lit(0)) * len(windows) + F.col("__k") * len(windows) + F.col("__w")
    scored = predict_by(tests, {i: m for i, m in enumerate(models) if m is not None}, which, "predicted", [*keys, "fold_id", "horizon", "period", target]).where("predicted is not null")
    return scored.select(*keys, F.lit(kind).alias("model"), "fold_id", "horizon", "period", F.col(target).cast("double").alias("actual"), "predicted")


fit_tree = fit_trees   # one tree model on all rows


def fit_final_ridge(df: DataFrame, target: str, features: Sequence[str], alpha: float = 1.0, by: Sequence[str] = (), engine: str = "auto") -> DataFrame:
    """Ridge on all rows: ``(by…, n, intercept, beta, beta_std, means)``."""
    features = list(features)
    g: Gram = gram(df, [*features, target], by, engine)
    p = len(features)
    names = g.by

    def fn(key, m: Moments) -> pd.DataFrame:
        b0, b, bs = ridge_solve(m, range(p), p, alpha)
        return pd.DataFrame([[*(key if names else ()), int(m.n), b0, b, bs, m.mean[:p]]], columns=[*names, "n", "intercept", "beta", "beta_std", "means"])

    schema = ", ".join([*_key_fields(df, by), "n bigint", "intercept double", "beta array<double>", "beta_std array<double>", "means array<double>"])
    return per_group(g, fn, schema)


def coefficient_table(fit: DataFrame, features: Sequence[str], by: Sequence[str] = (), standardized: bool = True) -> DataFrame:
    """One row per feature, largest coefficient first."""
    col = "beta_std" if standardized else "beta"
    names = F.array(*[F.lit(f) for f in features])
    rows = fit.select(*by, F.inline(F.arrays_zip(names.alias("feature"), F.col(col).alias("coefficient"))))
    rows = rows.toDF(*by, "feature", "coefficient")
    return rows.withColumn("abs_coefficient", F.abs("coefficient")).orderBy(*by, F.desc("abs_coefficient"), "feature")


def tree_importance_table(spark, model: TreeModel) -> DataFrame:
    return spark.createDataFrame([(f, float(v)) for f, v in zip(model.features, model.importances())], "feature string, importance double")
