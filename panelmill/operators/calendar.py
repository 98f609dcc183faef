"""From fact tables to gap-free panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.period import ordinal, step, truncate
from .distributed import attach_stats


def period_spine(spark: SparkSession, start, end, grain: str = "quarter") -> DataFrame:
    """Every period from start to end, both included."""
    kind = "timestamp" if grain == "hour" else "date"
    series = F.explode(F.sequence(F.lit(start).cast(kind), F.lit(end).cast(kind), step(grain)))
    out = spark.range(1).select(series.alias("period"))
    return out.withColumn("ord", ordinal(F.col("period"), grain))


def to_period(facts: DataFrame, ts: str, keys: Sequence[str], aggs: Mapping[str, Column], grain: str = "quarter") -> DataFrame:
    """Roll fact rows up to one row per key and period (map-side combined)."""
    at = truncate(F.col(ts), grain)
    rolled = facts.groupBy(*keys, at.alias("period")).agg(*[c.alias(n) for n, c in aggs.items()])
    return rolled.withColumn("ord", ordinal(F.col("period"), grain))


def coarsen(panel: DataFrame, keys: Sequence[str], cols: Sequence[str], grain: str = "year", how: str = "sum") -> DataFrame:
    """Roll a panel up to a coarser grain by sum or mean."""
    fn = {"sum": F.sum, "mean": F.avg}[how]
    return to_period(panel.drop("ord"), "period", keys, {c: fn(c) for c in cols}, grain)


def align_to_spine(panel: DataFrame, keys: Sequence[str] = (), grain: str = "quarter", start=None, end=None,
                   per_key: bool = False) -> DataFrame:
    """Gap-free calendar for every key; NULL where a period has no row.

    Bounds are given, or the table's, or with ``per_key`` each series' own. The
    calendar is generated from the bounds of each key, so only one row per key
    is shuffled to build it.
    """
    keys = list(keys)
    kind = "timestamp" if grain == "hour" else "date"
    lo = F.lit(start).cast(kind) if start is not None else F.col("__lo")
    hi = F.lit(end).cast(kind) if end is not None else F.col("__hi")
    bounds = panel.groupBy(*keys).agg(F.min("period").alias("__lo"), F.max("period").alias("__hi"))
    if keys and not per_key and (start is None or end is None):
        bounds = attach_stats(bounds.drop("__lo", "__hi"), {"__lo": F.min("period"), "__hi": F.max("period")}, source=panel)
    spine = bounds.select(*keys, F.explode(F.sequence(lo, hi, step(grain))).alias("period"))
    values = [c for c in panel.columns if c not in (*keys, "period", "ord")]
    right = panel.select(*[F.col(k).alias(f"__r_{k}") for k in keys], F.col("period").alias("__r_period"), *values)
    cond = F.col("period") == F.col("__r_period")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    out = spine.join(right, cond, "left").select(*keys, "period", *values)
    return out.withColumn("ord", ordinal(F.col("period"), grain))


def incomplete_periods(aligned: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """How many periods of each key miss at least one value."""
    missing = F.lit(False)
    for c in cols:
        missing = missing | F.col(c).isNull()
    return aligned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_periods"), F.count(F.when(missing, 1)).alias("n_incomplete"))
