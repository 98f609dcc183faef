"""Walk-forward folds as a small table on the period axis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import small_table

HORIZONS = (1, 2, 4)
PLAN_SCHEMA = ("fold_id int, horizon int, train_start date, train_end date, test_start date, test_end date, train_start_ord bigint, "
               "train_end_ord bigint, test_start_ord bigint, test_end_ord bigint, train_size int, test_size int")


def period_axis(panel: DataFrame, cols: Sequence[str] = ()) -> DataFrame:
    """Distinct usable periods with their position: at most one row per calendar period.

    A period counts when at least one row has a value in all of ``cols``.
    """
    usable = panel.na.drop(subset=list(cols)) if cols else panel
    axis = usable.groupBy("ord").agg(F.min("period").alias("period"))
    listed = axis.agg(F.sort_array(F.collect_list(F.struct("ord", "period"))).alias("axis"))
    return listed.select(F.posexplode("axis").alias("pos", "p")).select("pos", "p.ord", "p.period")


def fold_plan(axis: DataFrame, min_train: int = 40, test: int = 4, horizons: Sequence[int] = HORIZONS, window: int | None = None) -> DataFrame:
    """One row per fold; fold ids run across horizons.

    For horizon h the train window ends at position e = min_train − 1, + test, …
    while e + h + test ≤ n; the test window is the ``test`` positions from e + h.
    ``window`` keeps only the last periods of the train window (rolling start).

    The plan has one row per fold and is needed by every later step, so it is
    computed once here and becomes a literal table: no step scans the facts for
    the period axis again.
    """
    listed = axis.agg(F.sort_array(F.collect_list(F.struct("pos", "ord", "period"))).alias("axis"))
    start = min_train - 1
    hs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(h).alias("horizon")) for i, h in enumerate(horizons)])
    ends = listed.select("axis", F.size("axis").alias("n"), F.explode(hs).alias("h")).select(
        "axis", "h.i", "h.horizon",
        F.filter(F.sequence(F.lit(start), F.greatest(F.lit(start), F.col("n") - F.col("h.horizon") - test), F.lit(test)),
                 lambda e: e + F.col("h.horizon") + test <= F.col("n")).alias("es"))
    rows = ends.select("axis", "i", "horizon", F.explode("es").alias("e"))
    first = F.lit(0) if window is None else F.greatest(F.lit(0), F.col("e") - window + 1)
    at = lambda p, f: F.get(F.col("axis"), p)[f]
    plan = rows.select(
        (F.row_number().over(W.orderBy("i", "e")) - 1).cast("int").alias("fold_id"), "horizon",
        at(first, "period").alias("train_start"), at(F.col("e"), "period").alias("train_end"),
        at(F.col("e") + F.col("horizon"), "period").alias("test_start"),
        at(F.col("e") + F.col("horizon") + test - 1, "period").alias("test_end"),
        at(first, "ord").alias("train_start_ord"), at(F.col("e"), "ord").alias("train_end_ord"),
        at(F.col("e") + F.col("horizon"), "ord").alias("test_start_ord"),
        at(F.col("e") + F.col("horizon") + test - 1, "ord").alias("test_end_ord"),
        (F.col("e") - first + 1).cast("int").alias("train_size"), F.lit(test).alias("test_size"))
    return pin(plan)


def pin(plan: DataFrame) -> DataFrame:
    names = [f.strip().split(" ")[0] for f in PLAN_SCHEMA.split(",")]
    return small_table(plan.sparkSession, [tuple(r) for r in plan.select(*names).collect()], PLAN_SCHEMA)


def expanding_plan(axis: DataFrame, **kw) -> DataFrame:
    return fold_plan(axis, **{**kw, "window": None})


def folds_by_horizon(plan: DataFrame, horizon: int) -> DataFrame:
    return plan.where(F.col("horizon") == horizon)


def fold_periods(plan: DataFrame, roles: Sequence[str] = ("test",)) -> DataFrame:
    """The plan spread to one row per fold and ordinal, so rows meet folds by equality."""
    parts = []
    for role in roles:
        parts.append(plan.select("fold_id", "horizon", "train_end_ord", F.lit(role).alias("role"),
                                 F.explode(F.sequence(f"{role}_start_ord", f"{role}_end_ord")).alias("ord")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def assign_folds(df: DataFrame, plan: DataFrame, roles: Sequence[str] = ("test",)) -> DataFrame:
    """Rows of each fold with their role; an equi-join on the ordinal.

    The test side repeats a row at most once per horizon. The train side repeats
    it once per later fold, so linear models use cumulative Gram matrices instead.
    """
    return df.join(fold_periods(plan, roles), "ord")


def leakage_violations(assigned: DataFrame) -> DataFrame:
    """Folds whose train rows do not all lie before their test rows (empty = sound)."""
    per = assigned.groupBy("fold_id").agg(
        F.max(F.when(F.col("role") == "train", F.col("ord"))).alias("train_last"),
        F.min(F.when(F.col("role") == "test", F.col("ord"))).alias("test_first"))
    return per.where(F.col("train_last") >= F.col("test_first"))


def validate_no_leakage(plan: DataFrame) -> DataFrame:
    """Per fold: gap between train end and test start and the verdict."""
    gap = F.col("test_start_ord") - F.col("train_end_ord")
    return plan.select("fold_id", "horizon", gap.cast("int").alias("gap"),
                       ((gap >= 1) & (F.col("train_start_ord") <= F.col("train_end_ord"))).alias("valid"))


def contiguous_kfold(axis: DataFrame, k: int = 5) -> DataFrame:
    """Unshuffled contiguous blocks of the period axis: (ord, block 0..k-1)."""
    return axis.select("ord", "period", (F.ntile(k).over(W.orderBy("pos")) - 1).alias("block"))
