"""Hyper-parameter search as tables: candidates are rows, folds are scored together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import reuse
from .evaluate import HORIZON_WEIGHTS, horizon_weight
from .gram import complete, moments_local, prefix_gram, windows_of
from .modelling import backtest_tree, ridge_solve
from .trees import BOOSTING, FOREST
from .wrappers import score_candidates

PENALTY = 0.1   # fixed value: weight of the spread of the horizon errors


def spread(d: int, seed: int = 42) -> list[tuple[float, float]]:
    """(step, shift) of each of ``d`` coordinates: steps are powers of 1 / g, g the root above 1 of x^(d + 1) = x + 1."""
    g = 2.0
    for _ in range(60):
        g = (1 + g) ** (1 / (d + 1))
    return [(g ** -(j + 1) % 1, (0.5 + seed * g ** -(j + 2)) % 1) for j in range(d)]


def param_candidates(spark: SparkSession, space: Mapping[str, Mapping], n: int, seed: int = 42) -> DataFrame:
    """``n`` points of a space of int, uniform, log_uniform and categorical parameters, spread evenly.

    Parameter j of candidate i is the fraction of shift_j + (i + 1) a_j (see ``spread``), a low-discrepancy sequence in plain
    arithmetic: a row is the same on any cluster and in any partition, and n points are the first n of more.
    """
    out = spark.range(n).withColumnRenamed("id", "candidate")
    for (name, spec), (step, shift) in zip(space.items(), spread(len(space), seed)):
        x = F.lit(shift) + (F.col("candidate") + 1) * F.lit(step)
        u = x - F.floor(x)
        kind = spec["type"]
        if kind == "int":
            v = F.floor(spec["low"] + u * (spec["high"] - spec["low"] + 1)).cast("int")
        elif kind == "uniform":
            v = spec["low"] + u * (spec["high"] - spec["low"])
        elif kind == "log_uniform":
            lo, hi = float(np.log(spec["low"])), float(np.log(spec["high"]))
            v = F.exp(lo + u * (hi - lo))
        elif kind == "categorical":
            v = F.get(F.array(*[F.lit(c) for c in spec["choices"]]), F.floor(u * len(spec["choices"])).cast("int"))
        else:
            raise ValueError(f"unknown parameter type {kind!r}")
        out = out.withColumn(name, v)
    return out


def fitness(fold_mae: DataFrame, by: Sequence[str], horizons: Sequence[int], weights: Mapping[int, float] = HORIZON_WEIGHTS, penalty: float = PENALTY) -> DataFrame:
    """Σ w·(mean fold MAE) over horizons plus the penalised spread between horizons.

    A horizon without folds makes the fitness infinite.
    """
    per = fold_mae.groupBy(*by, "horizon").agg(F.avg("mae").alias("mae"))
    out = per.groupBy(*by).agg(F.sum(horizon_weight(weights) * F.col("mae")).alias("weighted_mae"),
                               F.stddev_pop("mae").alias("horizon_spread_penalty"), F.count(F.lit(1)).alias("__h"))
    score = F.col("weighted_mae") + penalty * F.col("horizon_spread_penalty")
    return out.withColumn("fitness", F.when(F.col("__h") < len(horizons), F.lit(float("inf"))).otherwise(score)).drop("__h")


def sweep_ridge(df: DataFrame, target: str, features: Sequence[str], plan: DataFrame, alphas: Sequence[float],
                options: Mapping[str, Sequence[str]] | None = None, weights: Mapping[int, float] = HORIZON_WEIGHTS, penalty: float = PENALTY,
                engine: str = "auto") -> DataFrame:
    """Every (option, penalty) over all folds: one scan for the matrices, one for the errors."""
    feats, p = list(features), len(features)
    opts = {k: [feats.index(f) for f in v] for k, v in (options or {"all": feats}).items()}
    labels = [(o, float(a)) for o in opts for a in alphas]
    rows = reuse(complete(df.select(*dict.fromkeys(["ord", target, *feats])), [target, *feats]))
    folds = plan.select("fold_id", "horizon", "train_start_ord", "train_end_ord", "test_start_ord", "test_end_ord").collect()
    g = prefix_gram(rows, [*feats, target], windows_of(plan), (), engine)
    solved = {}
    for key, m in moments_local(g).items():
        b, b0 = np.zeros((p, len(labels))), np.zeros(len(labels))
        for c, (o, a) in enumerate(labels):
            b0[c], coef, _ = ridge_solve(m, opts[o], p, a)
            b[opts[o], c] = coef
        solved[key] = (b, b0)
    spans = [(f["test_start_ord"], f["test_end_ord"], f["fold_id"]) for f in folds]
    models = {f["fold_id"]: solved[(f["train_start_ord"], f["train_end_ord"])] for f in folds}
    scored = score_candidates(rows, feats, target, spans, models)
    spark = df.sparkSession
    cand = spark.createDataFrame([(i, o, a) for i, (o, a) in enumerate(labels)], "cand bigint, fs_option string, alpha double")
    fold = spark.createDataFrame([(f["fold_id"], f["horizon"]) for f in folds], "grp bigint, horizon int")
    per = scored.join(fold, "grp").join(cand, "cand").select("cand", "fs_option", "alpha", F.col("grp").alias("fold_id"), "horizon", "mae")
    return fitness(per, ["cand", "fs_option", "alpha"], sorted({f["horizon"] for f in folds}), weights, penalty)


def sweep_tree(df: DataFrame, target: str, features: Sequence[str], plan: DataFrame, kind: str, candidates: Sequence[Mapping], seed: int = 42,
               weights: Mapping[int, float] = HORIZON_WEIGHTS, penalty: float = PENALTY, cuts: Sequence | None = None) -> DataFrame:
    """The same for tree models: all candidates and train windows grow in the same passes.

    A candidate whose parameters are not known or out of range scores infinity.
    """
    horizons = [r[0] for r in plan.select("horizon").distinct().collect()]
    label = [", ".join(f"{k}={v}" for k, v in c.items()) for c in candidates]
    sound = [i for i, c in enumerate(candidates) if _sound(kind, c)]
    spark = df.sparkSession
    named = spark.createDataFrame(list(enumerate(label)), "cand int, params string")
    if not sound:
        return named.select("cand", "params", F.lit(None).cast("double").alias("weighted_mae"), F.lit(None).cast("double").alias("horizon_spread_penalty"), F.lit(float("inf")).alias("fitness"))
    preds = backtest_tree(df, target, features, plan, kind, (), seed, [candidates[i] for i in sound], cuts)
    place = F.array(*[F.lit(i) for i in sound])
    mae = preds.groupBy(F.get(place, F.col("cand")).alias("cand"), "fold_id", "horizon").agg(F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("mae"))
    scored = fitness(mae, ["cand"], horizons, weights, penalty)
    return named.join(scored, "cand", "left").withColumn("fitness", F.coalesce("fitness", F.lit(float("inf"))))


def _sound(kind: str, params: Mapping) -> bool:
    """Whether the parameters are known, positive and of a depth up to 16."""
    known = FOREST if kind == "random_forest" else BOOSTING
    return all(k in known and isinstance(v, (int, float)) and v > 0 for k, v in params.items()) and 1 <= params.get("depth", 1) <= 16


def sweep_history(scores: DataFrame, batch: int, order: str = "cand", by: Sequence[str] = ()) -> DataFrame:
    """Best so far and mean fitness per batch of candidates."""
    per = scores.groupBy(*by, F.floor(F.col(order) / batch).alias("iteration")).agg(
        F.min("fitness").alias("__best"), F.avg("fitness").alias("mean_fitness"))
    w = W.partitionBy(*by, F.lit(0)).orderBy("iteration").rowsBetween(W.unboundedPreceding, 0)
    return per.withColumn("best_fitness", F.min("__best").over(w)).drop("__best")


def sweep_summary(best: DataFrame, option: str = "fs_option", model: str = "model") -> DataFrame:
    """Per option: number of models, mean and best fitness, best model."""
    return best.groupBy(option).agg(F.count(F.lit(1)).alias("n_models"), F.avg("fitness").alias("avg_fitness"), F.min("fitness").alias("best_fitness"),
                                    F.min(F.struct("fitness", model))[model].alias("best_model"))
