"""Wrapper methods: RFE, sequential and exhaustive selection with ridge.

Training statistics come from Gram tables (features² numbers per fold on the
driver); each search step scores all its candidates in one pass over the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reuse, settle
from .folds import contiguous_kfold, period_axis
from .gram import Moments, complete, gram, moments_local, per_group
from .modelling import fit_tree, ridge_solve

CELLS = 2_000_000   # numbers per scoring product: bounds the memory of a task


def score_candidates(rows: DataFrame, features: Sequence[str], target: str, intervals: Sequence[tuple[int, int, int]],
                     models: dict[int, tuple[np.ndarray, np.ndarray]], ord_col: str = "ord") -> DataFrame:
    """Σ|error| and n of every candidate per interval group, in one pass.

    ``intervals`` are (first ord, last ord, group); ``models`` gives a group's
    coefficient matrix (features × candidates) and intercepts. Tasks emit one
    partial sum per group and candidate, never per row.
    """
    feats = list(features)
    slim = rows.select(*[F.col(f).cast("double").alias(f) for f in feats], F.col(target).cast("double").alias("__t"), F.col(ord_col).alias("__ord"))

    def run(batches):
        sums = {g: np.zeros(b.shape[1]) for g, (b, _) in models.items()}
        counts = dict.fromkeys(models, 0)
        for batch in batches:
            o = batch["__ord"].to_numpy()
            x, y = batch[feats].to_numpy(dtype=float), batch["__t"].to_numpy(dtype=float)
            for lo, hi, g in intervals:
                at = np.flatnonzero((o >= lo) & (o <= hi))
                if not len(at):
                    continue
                b, b0 = models[g]
                step = max(1, CELLS // max(1, b.shape[1]))
                for s in range(0, len(at), step):
                    part = at[s:s + step]
                    sums[g] += np.abs(y[part, None] - (x[part] @ b + b0)).sum(axis=0)
                counts[g] += len(at)
        for g, v in sums.items():
            if counts[g]:
                yield pd.DataFrame({"grp": np.int64(g), "cand": np.arange(len(v), dtype="int64"), "abs_sum": v, "n": np.int64(counts[g])})

    parts = slim.mapInPandas(run, "grp bigint, cand bigint, abs_sum double, n bigint")
    return parts.groupBy("grp", "cand").agg(F.sum("abs_sum").alias("abs_sum"), F.sum("n").alias("n")).withColumn("mae", F.col("abs_sum") / F.col("n"))


class RidgeCV:
    """Contiguous k-fold ridge: block matrices once, then candidates by rows."""

    def __init__(self, df: DataFrame, features: Sequence[str], target: str, cv: int = 5, alpha: float = 1.0, standardize: bool = False, engine: str = "auto"):
        self.features, self.target, self.alpha, self.standardize = list(features), target, alpha, standardize
        self.rows = reuse(complete(df.select(*dict.fromkeys(["ord", target, *features])), [target, *features]))
        blocks = contiguous_kfold(period_axis(self.rows.withColumn("period", F.col("ord"))), cv).collect()
        spans: dict[int, list[int]] = {}
        for r in blocks:
            spans.setdefault(r["block"], []).append(r["ord"])
        self.spans = [(min(o), max(o), b) for b, o in sorted(spans.items())]
        label = F.lit(None).cast("int")
        for lo, hi, b in self.spans:
            label = F.when(F.col("ord").between(lo, hi), F.lit(b)).otherwise(label)
        g = gram(self.rows.withColumn("__blk", label), [*features, target], ["__blk"], engine)
        per = {k[0]: m for k, m in moments_local(g).items()}
        total = sum(m.raw for m in per.values())
        self.total = Moments.of(total, g.shift, g.scale)
        self.train = {b: Moments.of(total - m.raw, g.shift, g.scale) for b, m in per.items()}
        self.test = per

    def scores(self, subsets: Sequence[Sequence[int]]) -> pd.DataFrame:
        """Mean and std over folds of the MAE of each feature subset."""
        p = len(self.features)
        models = {}
        for b, m in self.train.items():
            beta, b0 = np.zeros((p, len(subsets))), np.zeros(len(subsets))
            for c, idx in enumerate(subsets):
                b0[c], coef, _ = ridge_solve(m, idx, p, self.alpha, self.standardize)
                beta[list(idx), c] = coef
            models[b] = (beta, b0)
        table = score_candidates(self.rows, self.features, self.target, self.spans, models)
        per = table.groupBy("cand").agg(F.avg("mae").alias("mean_mae"), F.stddev_pop("mae").alias("std_mae"))
        return per.toPandas().sort_values("cand").reset_index(drop=True)

    def close(self) -> None:
        self.rows.unpersist()


def rfe_ridge(df: DataFrame, features: Sequence[str], target: str, keep: int = 10, alpha: float = 1.0, standardize: bool = False, engine: str = "auto") -> DataFrame:
    """Drop the smallest |coefficient| step by step; one scan, repeated solves."""
    names, p = list(features), len(features)
    g = gram(df, [*names, target], (), engine)

    def fn(key, m: Moments) -> pd.DataFrame:
        alive, rank = list(range(p)), np.ones(p, dtype="int32")
        while len(alive) > min(keep, p):
            _, beta, _ = ridge_solve(m, alive, p, alpha, standardize)
            worst = int(np.argmin(np.abs(beta)))
            rank[alive[worst]] = len(alive) - min(keep, p) + 1
            alive.pop(worst)
        return pd.DataFrame({"feature": names, "ranking": rank, "selected": rank == 1})

    out = per_group(g, fn, "feature string, ranking int, selected boolean")
    return out.select(F.lit("rfe_ridge").alias("method"), "*")


def rfe_forest(df: DataFrame, features: Sequence[str], target: str, keep: int = 10, seed: int = 42, **params) -> DataFrame:
    """The same with forest importances (50 trees of depth 5): one fit per step."""
    p = {"trees": 50, "depth": 5, **params}
    rows = reuse(complete(df.select(*features, target), [*features, target]))
    alive, rank = list(features), {f: 1 for f in features}
    while len(alive) > keep:
        model = fit_tree(rows, target, alive, "random_forest", seed, **p)
        worst = min(zip(model.importances(), alive))[1]
        rank[worst] = len(alive) - keep + 1
        alive.remove(worst)
    rows.unpersist()
    return df.sparkSession.createDataFrame([("rfe_forest", f, rank[f], rank[f] == 1) for f in features],
                                           "method string, feature string, ranking int, selected boolean")


def sequential_select(df: DataFrame, features: Sequence[str], target: str, keep: int = 10, direction: str = "forward", cv: int = 5,
                      alpha: float = 1.0, standardize: bool = False, engine: str = "auto") -> DataFrame:
    """Greedy forward or backward search by cross-validated MAE, one pass per step."""
    model = RidgeCV(df, features, target, cv, alpha, standardize, engine)
    p = len(model.features)
    keep = min(keep, p)
    chosen = [] if direction == "forward" else list(range(p))
    step_of, mae_of = {}, {}
    step = 0
    while len(chosen) != keep:
        step += 1
        if direction == "forward":
            moves = [k for k in range(p) if k not in chosen]
            subsets = [sorted([*chosen, k]) for k in moves]
        else:
            moves = list(chosen)
            subsets = [[j for j in chosen if j != k] for k in moves]
        s = model.scores(subsets)["mean_mae"].to_numpy()
        best = int(np.argmin(s))
        k = moves[best]
        chosen = subsets[best]
        step_of[k], mae_of[k] = step, float(s[best])
    model.close()
    name = "sfs" if direction == "forward" else "sbs"
    rows = [(name, f, i in chosen, step_of.get(i, 0), mae_of.get(i)) for i, f in enumerate(model.features)]
    return df.sparkSession.createDataFrame(rows, "method string, feature string, selected boolean, step int, mae double")


SUBSETS, BUFFER = 2_000, 200_000   # subsets that a task solves, and rows that it holds, at a time


def subset_at(rank: int, p: int, low: int, high: int) -> tuple[int, ...]:
    """The subset of 0..p-1 at place ``rank`` among those of low..high members: by size, then in lexicographic order."""
    for size in range(low, high + 1):
        n = comb(p, size)
        if rank < n:
            break
        rank -= n
    out, at = [], 0
    for left in range(size, 0, -1):
        while rank >= comb(p - at - 1, left - 1):
            rank -= comb(p - at - 1, left - 1)
            at += 1
        out.append(at)
        at += 1
    return tuple(out)


def exhaustive_select(df: DataFrame, features: Sequence[str], target: str, low: int = 1, high: int = 5, cv: int = 5, alpha: float = 1.0,
                      standardize: bool = False, engine: str = "auto") -> DataFrame:
    """All subsets of size low..high of all features with the mean and std of their cross-validated error: one row each.

    No list of subsets exists anywhere: every task unranks a range after the other, solves its subsets from the folds' Gram
    matrices (features² numbers each) and adds up their errors on its own rows; the sums of a subset meet in a shuffle. The
    best is that of the least error, then fewest features, then lowest rank.
    """
    model = RidgeCV(df, features, target, cv, alpha, standardize, engine)
    feats, p = model.features, len(model.features)
    high = min(high, p)
    total = sum(comb(p, size) for size in range(low, high + 1))
    spans, train, y = model.spans, model.train, "__t"
    slim = model.rows.select(*[F.col(f).cast("double").alias(f) for f in feats], F.col(target).cast("double").alias(y), F.col("ord").alias("__ord"))

    def sums(part: pd.DataFrame):
        o, x, t = part["__ord"].to_numpy(), part[feats].to_numpy(dtype=float), part[y].to_numpy()
        folds = [(b, np.flatnonzero((o >= lo) & (o <= hi))) for lo, hi, b in spans]
        for start in range(0, total, SUBSETS):
            chosen = [subset_at(r, p, low, high) for r in range(start, min(total, start + SUBSETS))]
            for b, at in folds:
                if not len(at):
                    continue
                beta, b0 = np.zeros((p, len(chosen))), np.zeros(len(chosen))
                for c, idx in enumerate(chosen):
                    b0[c], coef, _ = ridge_solve(train[b], idx, p, alpha, standardize)
                    beta[list(idx), c] = coef
                step = max(1, CELLS // len(chosen))
                found = np.zeros(len(chosen))
                for s in range(0, len(at), step):
                    some = at[s:s + step]
                    found += np.abs(t[some, None] - (x[some] @ beta + b0)).sum(axis=0)
                yield pd.DataFrame({"rank": np.arange(start, start + len(chosen)), "fold": np.int64(b), "abs_sum": found, "n": np.int64(len(at))})

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= BUFFER:
                yield from sums(pd.concat(held))
                held, rows = [], 0
        if rows:
            yield from sums(pd.concat(held))

    parts = slim.mapInPandas(run, "rank bigint, fold bigint, abs_sum double, n bigint")
    per = parts.groupBy("rank", "fold").agg((F.sum("abs_sum") / F.sum("n")).alias("mae")).groupBy("rank").agg(F.avg("mae").alias("mean_mae"), F.stddev_pop("mae").alias("std_score"))

    def name(batches):
        for batch in batches:
            idx = [subset_at(int(r), p, low, high) for r in batch["rank"]]
            yield pd.DataFrame({"rank": batch["rank"], "features": [[feats[i] for i in c] for c in idx], "n_features": [len(c) for c in idx], "mean_score": -batch["mean_mae"], "std_score": batch["std_score"]})

    named = settle(per.mapInPandas(name, "rank bigint, features array<string>, n_features int, mean_score double, std_score double"))
    model.close()
    best = named.agg(F.min(F.struct(-F.col("mean_score"), "n_features", "rank"))["rank"].alias("rank"))
    return named.withColumn("selected", F.col("rank") == best.scalar()).drop("rank")


def run_wrappers(df: DataFrame, features: Sequence[str], target: str, keep: int = 10, cv: int = 5, seed: int = 42, engine: str = "auto", **tree) -> DataFrame:
    """``(category, method, feature, score, selected)`` of RFE and both sequential searches."""
    parts = [
        rfe_ridge(df, features, target, keep, engine=engine).withColumn("score", -F.col("ranking").cast("double")),
        rfe_forest(df, features, target, keep, seed, **tree).withColumn("score", -F.col("ranking").cast("double")),
        sequential_select(df, features, target, keep, "forward", cv, engine=engine).withColumn("score", -F.col("mae")),
        sequential_select(df, features, target, keep, "backward", cv, engine=engine).withColumn("score", F.col("mae")),
    ]
    out = None
    for t in parts:
        t = t.select(F.lit("wrapper").alias("category"), "method", "feature", "score", "selected")
        out = t if out is None else out.unionByName(t)
    return out
