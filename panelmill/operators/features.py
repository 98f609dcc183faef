"""Feature engineering: projections and block-wise window functions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.period import parse_period, season_number
from .distributed import Blocks, attach_stats

ROLL = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def target_transform(panel: DataFrame, col: str, keys: Sequence[str] = (), transform: str = "log", name: str = "target") -> DataFrame:
    """ln(y), the change of ln(y), or y itself."""
    if transform == "log":
        return panel.withColumn(name, F.ln(col))
    if transform == "delta_log":
        b = Blocks(panel, keys, back=1)
        return b.select((F.ln(F.col(col)) - b.at(F.ln(F.col(col)), -1)).alias(name))
    if transform in (None, "none"):
        return panel.withColumn(name, F.col(col).cast("double"))
    raise ValueError(f"unknown transform {transform!r}")


def transform_metadata(panel: DataFrame, raw: str, transformed: str, by: Sequence[str] = ()) -> DataFrame:
    return panel.groupBy(*by).agg(
        F.min(raw).alias("original_min"), F.max(raw).alias("original_max"), F.avg(raw).alias("original_mean"),
        F.min(transformed).alias("transformed_min"), F.max(transformed).alias("transformed_max"))


def inverse_transform(col: Column, transform: str = "log") -> Column:
    if transform == "log":
        return F.exp(col)
    if transform in (None, "none"):
        return col
    raise ValueError("only log and none can be inverted row by row")


def lag_features(panel: DataFrame, cols: Sequence[str], lags: Sequence[int] = (1, 2, 3, 4), keys: Sequence[str] = ()) -> DataFrame:
    b = Blocks(panel, keys, back=max(lags))
    return b.select(*[b.at(c, -k).alias(f"{c}_lag{k}") for c in cols for k in lags])


def rolling_features(panel: DataFrame, cols: Sequence[str], windows: Sequence[int] = (4, 8), fns: Sequence[str] = ("mean", "std"),
                     keys: Sequence[str] = (), shift: int = 0) -> DataFrame:
    """Trailing statistics over n periods; ``shift`` moves the frame back, so a leak guard costs no second pass."""
    b = Blocks(panel, keys, back=max(windows) - 1 + shift)
    return b.select(*[
        ROLL[f](c).over(b.frame(-(n - 1) - shift, -shift)).alias(f"{c}_roll{n}_{f}")
        for c in cols for n in windows for f in fns])


def shift_features(panel: DataFrame, cols: Sequence[str], k: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """Columns replaced by their value k periods earlier."""
    b = Blocks(panel, keys, back=k)
    out = b.select(*[b.at(c, -k).alias(f"__s_{c}") for c in cols])
    return out.select(*[F.col(f"__s_{c}").alias(c) if c in cols else F.col(c) for c in panel.columns])


def season_dummies(grain: str = "quarter", period: str = "period") -> list[Column]:
    """0/1 columns for every season but the first."""
    n, tag = (4, "Q") if grain == "quarter" else (12, "M")
    return [(season_number(F.col(period), grain) == s).cast("int").alias(f"{tag}{s}") for s in range(2, n + 1)]


def season_sincos(grain: str = "quarter", period: str = "period") -> list[Column]:
    n = 4 if grain == "quarter" else 12
    angle = 2 * math.pi * (season_number(F.col(period), grain) - 1) / n
    return [F.sin(angle).alias("season_sin"), F.cos(angle).alias("season_cos")]


# Default shock intervals, both ends included.
SHOCKS = {"COVID": ("2020Q1", "2021Q4"), "EnergyCrisis": ("2022Q1", "2023Q4")}


def shock_dummies(shocks: Mapping[str, tuple[str, str]] = SHOCKS, period: str = "period") -> list[Column]:
    return [F.col(period).cast("date").between(parse_period(F.lit(a)), parse_period(F.lit(b))).cast("int").alias(n)
            for n, (a, b) in shocks.items()]


def growth_log(panel: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), shift: int = 0) -> DataFrame:
    """Change of ln; a series with values ≤ 0 is first raised by 1 % of its smallest positive value."""
    stats = {}
    for c in cols:
        stats[f"__lo_{c}"] = F.min(c)
        stats[f"__pos_{c}"] = F.min(F.when(F.col(c) > 0, F.col(c)))
    withs = attach_stats(panel, stats, keys)
    for c in cols:
        raised = F.when(F.col(f"__lo_{c}") <= 0, F.col(c) + F.col(f"__pos_{c}") * 0.01).otherwise(F.col(c))
        withs = withs.withColumn(f"__g_{c}", F.ln(raised))
    b = Blocks(withs.drop(*stats), keys, back=1 + shift)
    out = b.select(*[(b.at(f"__g_{c}", -shift) - b.at(f"__g_{c}", -1 - shift)).alias(f"{c}_dlog") for c in cols])
    return out.drop(*[f"__g_{c}" for c in cols])


def difference(panel: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    b = Blocks(panel, keys, back=1)
    return b.select(*[(F.col(c) - b.at(c, -1)).alias(f"{c}_diff") for c in cols])


def ratio_features(panel: DataFrame, num: str, dens: Sequence[str], keys: Sequence[str] = (), shift: int = 0, default: float | None = None) -> DataFrame:
    """num per den; a zero denominator gives NULL (or ``default``)."""

    def ratio(d: str) -> Column:
        r = F.try_divide(F.col(num).cast("double"), F.nullif(F.col(d).cast("double"), F.lit(0.0)))
        return F.when(F.col(d) == 0, F.lit(default)).otherwise(r) if default is not None else r

    if not shift:
        return panel.select("*", *[ratio(d).alias(f"{num}_per_{d}") for d in dens])
    b = Blocks(panel, keys, back=shift)
    return b.select(*[b.at(ratio(d), -shift).alias(f"{num}_per_{d}") for d in dens])


def degree_features(col: str, base: float = 18.0) -> list[Column]:
    """Heating and cooling degrees against a base; a missing value stays missing."""
    def over(x: Column) -> Column:
        return F.when(F.col(col).isNotNull(), F.greatest(F.lit(0.0), x))

    return [over(F.lit(base) - F.col(col)).alias("HDD_proxy"), over(F.col(col) - F.lit(base)).alias("CDD_proxy")]


def horizon_target(panel: DataFrame, col: str, h: int, keys: Sequence[str] = ()) -> DataFrame:
    """The value h periods ahead on each row."""
    b = Blocks(panel, keys, ahead=h)
    return b.select(b.at(col, h).alias(f"{col}_h{h}"))


def engineer_features(panel: DataFrame, target: str, keys: Sequence[str] = (), grain: str = "quarter", transform: str = "log",
                      lag_cols: Sequence[str] | None = None, lags: Sequence[int] = (1, 2, 3, 4),
                      rolling: Sequence[int] = (), rolling_fns: Sequence[str] = ("mean", "std"),
                      growth: Sequence[str] = (), ratios: Sequence[str] = (), ratio_shift: int = 1,
                      degree_col: str | None = None, degree_base: float = 18.0,
                      season: str = "dummies", shocks: Mapping[str, tuple[str, str]] = SHOCKS) -> tuple[DataFrame, dict[str, str]]:
    """All features in a fixed order, with their categories.

    Every window shares one blocked specification, so the plan has one shuffle
    and one sort whatever the number of features.
    """
    originals = [c.name for c in panel.schema if isinstance(c.dataType, T.NumericType) and c.name not in (target, "ord", *keys)]
    lag_cols = [target] if lag_cols is None else list(lag_cols)
    category = {c: "original" for c in originals}
    base, grown = panel, []
    if growth:
        stats = {}
        for c in growth:
            stats[f"__lo_{c}"], stats[f"__pos_{c}"] = F.min(c), F.min(F.when(F.col(c) > 0, F.col(c)))
        base = attach_stats(panel, stats, keys)
        for c in growth:
            raised = F.when(F.col(f"__lo_{c}") <= 0, F.col(c) + F.col(f"__pos_{c}") * 0.01).otherwise(F.col(c))
            base = base.withColumn(f"__g_{c}", F.ln(raised))
        base = base.drop(*stats)
    back = max([1, ratio_shift, *lags, *[n for n in rolling]]) + 1
    b = Blocks(base, keys, back=back)
    out: list[Column] = []

    def add(col: Column, name: str, kind: str) -> None:
        category[name] = kind
        out.append(col.alias(name))

    if transform == "delta_log":
        out.append((F.ln(F.col(target)) - b.at(F.ln(F.col(target)), -1)).alias("target"))
    else:
        out.append((F.ln(F.col(target)) if transform == "log" else F.col(target).cast("double")).alias("target"))
    for c in lag_cols:
        for k in lags:
            add(b.at(c, -k), f"{c}_lag{k}", "lag")
    for n in rolling:
        for f in rolling_fns:
            add(ROLL[f](target).over(b.frame(-n, -1)), f"{target}_roll{n}_{f}", "rolling")
    for c in growth:
        s = 1 if c == target else 0
        add(b.at(f"__g_{c}", -s) - b.at(f"__g_{c}", -1 - s), f"{c}_dlog", "growth")
    for d in ratios:
        r = F.try_divide(F.col(target).cast("double"), F.nullif(F.col(d).cast("double"), F.lit(0.0)))
        add(b.at(r, -ratio_shift) if ratio_shift else r, f"{target}_per_{d}", "ratio")
    if degree_col:
        for c, n in zip(degree_features(degree_col, degree_base), ("HDD_proxy", "CDD_proxy")):
            add(c, n, "degree")
    seasons = season_dummies(grain) if season == "dummies" else season_sincos(grain)
    names = ([f"{'Q' if grain == 'quarter' else 'M'}{s}" for s in range(2, 5 if grain == "quarter" else 13)]
             if season == "dummies" else ["season_sin", "season_cos"])
    for c, n in zip(seasons, names):
        add(c, n, "seasonality")
    for c, n in zip(shock_dummies(shocks), shocks):
        add(c, n, "shock")
    wide = b.select(*out)
    return wide.drop(*[f"__g_{c}" for c in growth]), category


def feature_dictionary(df: DataFrame, category: Mapping[str, str], approx: bool = False) -> DataFrame:
    """Per feature: type, distinct values, range, mean, missing share, category."""
    from .distributed import to_long

    cols = list(category)
    long = to_long(df, cols)
    # distinct values by two-level aggregation: value counts first, then per feature
    vc = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("c"))
    if approx:
        per = long.groupBy("variable").agg(
            F.approx_count_distinct("value").alias("n_unique"), F.min("value").alias("min"), F.max("value").alias("max"),
            F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"), F.count("value").alias("present"))
    else:
        per = vc.groupBy("variable").agg(
            F.count("value").alias("n_unique"), F.min("value").alias("min"), F.max("value").alias("max"),
            F.try_divide(F.sum(F.col("value") * F.col("c")), F.sum(F.when(F.col("value").isNotNull(), F.col("c")))).alias("mean"),
            F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("c"))), F.lit(0)).alias("present"))
    kind, dtype = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in reversed(cols):
        kind = F.when(F.col("variable") == c, F.lit(category[c])).otherwise(kind)
        dtype = F.when(F.col("variable") == c, F.lit(df.schema[c].dataType.simpleString())).otherwise(dtype)
    return per.select(F.col("variable").alias("feature"), dtype.alias("dtype"), "n_unique", "min", "max", "mean",
                      ((F.col("n") - F.col("present")) * 100.0 / F.col("n")).alias("missing_pct"), kind.alias("category"))


def lookback_sequences(panel: DataFrame, cols: Sequence[str], length: int, keys: Sequence[str] = (), pad: bool = False) -> DataFrame:
    """The last ``length`` feature vectors before each row as ARRAY<ARRAY<DOUBLE>>.

    Without ``pad`` rows lacking a full history are dropped; with it the
    sequence is filled up front with its own first vector (or the row's own).
    """
    vec = F.array(*[F.col(c).cast("double") for c in cols])
    b = Blocks(panel.withColumn("__vec", vec), keys, back=length)
    seq = F.collect_list("__vec").over(b.frame(-length, -1))
    out = b.select(seq.alias("sequence"))
    if pad:
        head = F.when(F.size("sequence") > 0, F.col("sequence")[0]).otherwise(F.col("__vec"))
        out = out.withColumn("sequence", F.concat(F.array_repeat(head, F.lit(length) - F.size("sequence")), F.col("sequence")))
    else:
        out = out.where(F.size("sequence") == length)
    return out.drop("__vec")


def scale(df: DataFrame, cols: Sequence[str], how: str = "standard", by: Sequence[str] = (), fit_on: Column | None = None, suffix: str = "_scaled") -> DataFrame:
    """Scale with statistics of the training rows only (``fit_on``).

    standard: (x − mean) / population std; minmax: to [0, 1]; robust:
    (x − median) / IQR. A flat column is only centred.
    """
    from .distributed import null_safe, quantiles, to_long

    train = df.where(fit_on) if fit_on is not None else df
    if how == "robust":
        q = quantiles(to_long(train, cols, by), [0.25, 0.5, 0.75], [*by, "variable"])
        # keyed by group only: one map per group, at most one entry per column
        pairs = q.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("variable", "q"))).alias("__q"))
        out = null_safe(df, pairs, list(by), "left") if by else df.withColumn("__q", pairs.scalar())

        def robust(c):
            t = F.col("__q")[c]
            iqr = t[2] - t[0]
            return (F.col(c) - t[1]) / F.when(iqr == 0, F.lit(1.0)).otherwise(iqr)

        return out.select(*df.columns, *[robust(c).alias(c + suffix) for c in cols])
    stats = {}
    for c in cols:
        if how == "standard":
            stats[f"__a_{c}"], stats[f"__b_{c}"] = F.avg(c), F.stddev_pop(c)
        elif how == "minmax":
            stats[f"__a_{c}"], stats[f"__b_{c}"] = F.min(c).cast("double"), (F.max(c) - F.min(c)).cast("double")
        else:
            raise ValueError(f"unknown scaler {how!r}")
    out = attach_stats(df, stats, by, source=train)
    return out.select(*df.columns, *[
        ((F.col(c) - F.col(f"__a_{c}")) / F.when(F.col(f"__b_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"__b_{c}"))).alias(c + suffix)
        for c in cols])
