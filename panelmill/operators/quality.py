"""Quality audit and cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .distributed import BLOCK, attach_stats, null_safe, quantiles, to_long

NULL_DOUBLE = "CAST(NULL AS DOUBLE)"


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [c.name for c in df.schema if isinstance(c.dataType, T.NumericType) and c.name not in skip]


def _present(df: DataFrame, name: str):
    """A value that counts: not NULL, and for floats not NaN."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.nanvl(c, F.lit(None).cast(df.schema[name].dataType))
    return c


def _tidy(one: DataFrame, rows: list) -> DataFrame:
    return one.select(F.inline(F.array(*rows)))


def missing_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One pass over all columns: missing count and share, and the type."""
    cols = list(cols or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(_present(df, c)).alias(f"c{i}") for i, c in enumerate(cols)])
    rows = [F.struct(
        F.lit(c).alias("column"), (F.col("n") - F.col(f"c{i}")).alias("missing_count"),
        F.try_divide((F.col("n") - F.col(f"c{i}")) * 100.0, F.col("n")).alias("missing_pct"),
        F.lit(df.schema[c].dataType.simpleString()).alias("dtype")) for i, c in enumerate(cols)]
    return _tidy(one, rows).orderBy(F.desc("missing_pct"), "column")


def constant_columns(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.99) -> DataFrame:
    """Share of the most frequent value per column, and the verdict.

    Numeric: mode share of the non-null values. Other types: at most one value.
    """
    cols = list(cols or df.columns)
    numeric = set(numeric_columns(df))
    text = df.select(*[_present(df, c).cast("string").alias(c) for c in cols])
    counts = text.unpivot([], cols, "column", "value").where(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("column").agg(
        F.try_divide(F.max("n") * 1.0, F.sum("n")).alias("mode_share"), F.count(F.lit(1)).alias("n_values"))
    # a column without any value has no row above; text columns of that kind count as constant
    names = df.sparkSession.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(c in numeric).alias("numeric")) for c in cols])).alias("s")).select("s.*")
    out = names.join(per, "column", "left")
    verdict = F.when(F.col("numeric"), F.coalesce(F.col("mode_share") >= threshold, F.lit(False))).otherwise(
        F.coalesce(F.col("n_values"), F.lit(0)) <= 1)
    return out.select("column", "mode_share", F.coalesce("n_values", F.lit(0)).cast("bigint").alias("n_values"),
                      verdict.alias("is_constant"))


def iqr_bounds(df: DataFrame, cols: Sequence[str], k: float = 1.5, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, variable, n, q1, q3, lower, upper)`` from exact quartiles."""
    long = to_long(df, cols, by)
    q = quantiles(long, [0.25, 0.75], [*by, "variable"])
    q1, q3 = F.col("q")[0], F.col("q")[1]
    return q.select(*by, "variable", "n", q1.alias("q1"), q3.alias("q3"),
                    (q1 - k * (q3 - q1)).alias("lower"), (q3 + k * (q3 - q1)).alias("upper"))


def _flagged(df, cols, by, bounds):
    """Values beside their group's fences, which are written first: rows stay in place where the planner sees that they are few."""
    return null_safe(to_long(df, cols, by).where(F.col("value").isNotNull()),
                     settle(bounds.select(*by, "variable", "lower", "upper")), [*by, "variable"])


def _outlier_summary(long: DataFrame, flag, by: Sequence[str]) -> DataFrame:
    out = long.groupBy(*by, "variable").agg(
        F.count(F.when(flag, 1)).alias("n_outliers"), F.count(F.lit(1)).alias("n_values"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return out.withColumn("pct_outliers", F.col("n_outliers") * 100.0 / F.col("n_values"))


def outliers_iqr(df: DataFrame, cols: Sequence[str], k: float = 1.5, by: Sequence[str] = (), keep_zero: bool = False) -> DataFrame:
    """Columns with values outside the quartile fences."""
    bounds = iqr_bounds(df, cols, k, by)
    flag = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    out = _outlier_summary(_flagged(df, cols, by, bounds), flag, by)
    return out if keep_zero else out.where("n_outliers > 0")


def outlier_rows(df: DataFrame, cols: Sequence[str], row_keys: Sequence[str], k: float = 1.5, by: Sequence[str] = ()) -> DataFrame:
    """The outlying values themselves with their row key and the fences."""
    bounds = iqr_bounds(df, cols, k, by)
    ids = [*by, *[r for r in row_keys if r not in by]]
    long = to_long(df, cols, ids).where(F.col("value").isNotNull())
    hit = null_safe(long, settle(bounds.select(*by, "variable", "lower", "upper")), [*by, "variable"])
    return hit.where((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")))


def outliers_zscore(df: DataFrame, cols: Sequence[str], z: float = 3.0, ddof: int = 1, by: Sequence[str] = (), keep_zero: bool = False) -> DataFrame:
    """Columns with |value − mean| / std above ``z``; ``ddof`` picks the std."""
    sd = F.stddev_samp if ddof == 1 else F.stddev_pop
    long = to_long(df, cols, by).where(F.col("value").isNotNull())
    long = attach_stats(long, {"__m": F.avg("value"), "__s": sd("value")}, [*by, "variable"])
    flag = (F.col("__s") > 0) & (F.abs((F.col("value") - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0))) > z)
    out = _outlier_summary(long, flag, by)
    return out if keep_zero else out.where("n_outliers > 0")


def medians(long: DataFrame, by: Sequence[str]) -> DataFrame:
    q = quantiles(long, [0.5], by)
    return q.select(*by, F.col("q")[0].alias("median"))


def outliers_mad(df: DataFrame, cols: Sequence[str], cutoff: float = 3.5, by: Sequence[str] = ()) -> DataFrame:
    """Counts of modified z-scores above the cutoff; 0 where the MAD is 0."""
    keys = [*by, "variable"]
    long = to_long(df, cols, by).where(F.col("value").isNotNull())
    dev = null_safe(long, settle(medians(long, keys)), keys).withColumn("__d", F.abs(F.col("value") - F.col("median")))
    mad = settle(medians(dev.select(*keys, F.col("__d").alias("value")), keys).withColumnRenamed("median", "mad"))
    # Fixed value: 0.6745 scales the MAD to a normal standard deviation.
    score = F.when(F.col("mad") != 0, 0.6745 * F.col("__d") / F.nullif(F.col("mad"), F.lit(0.0)))
    out = null_safe(dev, mad, keys).groupBy(*keys).agg(
        F.count(F.when(score > cutoff, 1)).alias("n_outliers"), F.count(F.lit(1)).alias("n_values"),
        F.max("median").alias("median"), F.max("mad").alias("mad"))
    return out.withColumn("pct_outliers", F.col("n_outliers") * 100.0 / F.col("n_values"))


def temporal_gaps(panel: DataFrame, keys: Sequence[str] = (), max_step_days: int = 100) -> DataFrame:
    """Consecutive periods more than ``max_step_days`` apart.

    The previous period is found inside ordinal blocks plus the last period of
    the nearest earlier block, so a very long series is not one task.
    """
    keys = list(keys)
    day = F.unix_date(F.to_date("period"))
    rows = panel.select(*keys, "period").withColumn("__blk", F.floor(day / BLOCK))
    ends = rows.groupBy(*keys, "__blk").agg(F.max("period").alias("__last"))
    over = W.partitionBy(*keys, F.lit(0)).orderBy("__blk")
    ends = ends.select(*keys, "__blk", F.lag("__last").over(over).alias("__before"))
    inner = W.partitionBy(*keys, "__blk").orderBy("period")
    out = null_safe(rows, ends, [*keys, "__blk"]).withColumn(
        "gap_from", F.coalesce(F.lag("period").over(inner), F.col("__before")))
    out = out.select(*keys, "gap_from", F.col("period").alias("gap_to"), F.datediff("period", "gap_from").alias("gap_days"))
    return out.where(F.col("gap_days") > max_step_days)


def gap_summary(panel: DataFrame, keys: Sequence[str] = (), max_step_days: int = 100) -> DataFrame:
    """Per key: number of gaps, first and last period, number of periods."""
    keys = list(keys)
    base = panel.groupBy(*keys).agg(F.min("period").alias("start"), F.max("period").alias("end"), F.count(F.lit(1)).alias("n_periods"))
    gaps = temporal_gaps(panel, keys, max_step_days).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gaps"))
    if keys:
        out = null_safe(base, gaps, keys, "left")
    else:
        out = base.withColumn("n_gaps", gaps.scalar())
    return out.withColumn("n_gaps", F.coalesce("n_gaps", F.lit(0)))


def describe_numeric(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Counts, moments, exact quartiles, range, IQR, cv % and shape per column."""
    keys = [*by, "variable"]
    long = to_long(df, cols, by)
    # moments about a pilot value lose no digits: centre on the group mean first
    base = attach_stats(long, {"__mu": F.avg("value")}, keys)
    d = F.col("value") - F.col("__mu")
    m = base.groupBy(*keys).agg(
        F.count("value").alias("count"), F.count(F.when(F.col("value").isNull(), 1)).alias("missing"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg(d * d).alias("__m2"), F.avg(d * d * d).alias("__m3"), F.avg(d * d * d * d).alias("__m4"))
    q = quantiles(long, [0.25, 0.5, 0.75], keys).drop("n")
    out = null_safe(m, q, keys, "left")
    return out.select(
        *keys, "count", "missing", (F.col("missing") * 100.0 / (F.col("missing") + F.col("count"))).alias("missing_pct"),
        "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max",
        (F.col("max") - F.col("min")).alias("range"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"),
        (F.try_divide("std", "mean") * 100).alias("cv"),
        F.try_divide(F.col("__m3"), F.pow("__m2", F.lit(1.5))).alias("skewness"),
        (F.try_divide(F.col("__m4"), F.col("__m2") * F.col("__m2")) - 3).alias("kurtosis"))


def quality_report(df: DataFrame, cols: Sequence[str], period: str | None = None, keys: Sequence[str] = (), max_step_days: int = 100) -> DataFrame:
    """Tidy bundle ``(section, variable, metric, value)`` of all audits."""

    def melt(part: DataFrame, section: str, name: str, metrics: Sequence[str]) -> DataFrame:
        wide = part.select(F.lit(section).alias("section"), F.col(name).alias("variable"),
                           *[F.col(m).cast("double").alias(m) for m in metrics])
        return wide.unpivot(["section", "variable"], list(metrics), "metric", "value")

    size = df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns))).withColumn("v", F.lit("table"))
    parts = [
        melt(size, "summary", "v", ["n_rows", "n_columns"]),
        melt(missing_report(df, cols), "missing", "column", ["missing_count", "missing_pct"]),
        melt(constant_columns(df, cols), "constant", "column", ["mode_share", "is_constant"]),
        melt(outliers_iqr(df, cols), "outliers", "variable", ["n_outliers", "pct_outliers", "min", "max", "mean", "std"]),
        melt(describe_numeric(df, cols), "statistics", "variable", ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]),
    ]
    if period:
        panel = df.select(*keys, F.col(period).alias("period"))
        gaps = gap_summary(panel, keys, max_step_days)
        label = F.concat_ws("/", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("table")
        parts.append(melt(gaps.withColumn("v", label), "gaps", "v", ["n_gaps", "n_periods"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def column_verdicts(df: DataFrame, cols: Sequence[str], drop_constant: bool = True, max_missing_pct: float = 50.0) -> dict[str, str]:
    """Columns to drop and why. One small result (one row per column) comes to the driver."""
    out: dict[str, str] = {}
    if drop_constant:
        out.update({r["column"]: "constant" for r in constant_columns(df, cols).where("is_constant").collect()})
    rest = [c for c in cols if c not in out]
    if rest:
        high = missing_report(df, rest).where(F.col("missing_pct") > max_missing_pct)
        out.update({r["column"]: "high_missing" for r in high.collect()})
    return out


def drop_constant(df: DataFrame, cols: Sequence[str], threshold: float = 0.99) -> DataFrame:
    gone = [r["column"] for r in constant_columns(df, cols, threshold).where("is_constant").collect()]
    return df.drop(*gone)


def drop_high_missing(df: DataFrame, cols: Sequence[str], max_missing_pct: float = 50.0) -> DataFrame:
    return df.drop(*column_verdicts(df, cols, False, max_missing_pct))


def interpolate_linear(panel: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), ord_col: str = "ord", size: int = BLOCK) -> DataFrame:
    """Straight line between known neighbours on the gap-free calendar.

    Leading missing values stay missing, trailing ones take the last value. The
    neighbours are looked up inside ordinal blocks; block ends carry the nearest
    known value of earlier and later blocks.
    """
    keys = list(keys)
    known = {c: F.when(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).isNotNull(),
                       F.struct(F.col(ord_col).alias("o"), F.col(c).cast("double").alias("v"))) for c in cols}
    blk = panel.withColumn("__blk", F.floor(F.col(ord_col) / size))
    for c in cols:
        blk = blk.withColumn(f"__k_{c}", known[c])
    ends = blk.groupBy(*keys, "__blk").agg(*[f(f"__k_{c}").alias(f"{tag}_{c}") for c in cols for f, tag in ((F.max, "__hi"), (F.min, "__lo"))])
    over = W.partitionBy(*keys, F.lit(0)).orderBy("__blk")
    ends = ends.select(
        *keys, "__blk",
        *[F.max(f"__hi_{c}").over(over.rowsBetween(W.unboundedPreceding, -1)).alias(f"__before_{c}") for c in cols],
        *[F.min(f"__lo_{c}").over(over.rowsBetween(1, W.unboundedFollowing)).alias(f"__after_{c}") for c in cols])
    inner = W.partitionBy(*keys, "__blk").orderBy(ord_col)
    back, ahead = inner.rowsBetween(W.unboundedPreceding, 0), inner.rowsBetween(0, W.unboundedFollowing)
    out = null_safe(blk, ends, [*keys, "__blk"]).select(
        "*",
        *[F.coalesce(F.last(f"__k_{c}", True).over(back), F.col(f"__before_{c}")).alias(f"__p_{c}") for c in cols],
        *[F.coalesce(F.first(f"__k_{c}", True).over(ahead), F.col(f"__after_{c}")).alias(f"__n_{c}") for c in cols])

    def filled(c: str):
        p, n = F.col(f"__p_{c}"), F.col(f"__n_{c}")
        line = p["v"] + (n["v"] - p["v"]) * (F.col(ord_col) - p["o"]) / (n["o"] - p["o"])
        return F.when(F.col(f"__k_{c}").isNotNull(), F.col(c).cast("double")).when(p.isNotNull() & n.isNotNull(), line).otherwise(p["v"])

    return out.select(*[filled(c).alias(c) if c in cols else F.col(c) for c in panel.columns])


def clean(panel: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), max_missing_pct: float = 50.0) -> tuple[DataFrame, DataFrame]:
    """Drop constant and mostly missing columns, interpolate, and log what was done."""
    verdicts = column_verdicts(panel, cols, True, max_missing_pct)
    rest = [c for c in cols if c not in verdicts]
    before = missing_report(panel, rest) if rest else None
    out = panel.drop(*verdicts)
    numeric = [c for c in rest if c in numeric_columns(panel)]
    if numeric:
        out = interpolate_linear(out, numeric, keys)
    dropped = panel.sparkSession.createDataFrame(
        [(c, f"dropped_{why}", None) for c, why in sorted(verdicts.items())], "column string, action string, missing_count bigint")
    if before is None:
        return out, dropped
    filled = before.where("missing_count > 0").where(F.col("column").isin(numeric)).select(
        "column", F.lit("interpolated").alias("action"), "missing_count")
    left = missing_report(out, rest).where("missing_count > 0").select("column", F.lit("remaining").alias("action"), "missing_count")
    return out, dropped.unionByName(filled).unionByName(left)


def drop_incomplete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with a value in every column (NaN counts as missing)."""
    return df.na.drop(subset=list(cols))
