"""Statistical profile: shape, normality, trend, stationarity, seasonality."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.stat import KolmogorovSmirnovTest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pvalues import f_pvalue, r2_to_f
from ..session import settle
from .distributed import Blocks, attach_stats, null_safe, prefix_sums, to_long
from .gram import Gram, Moments, gram, per_group
from .modelling import _key_fields


def distribution_profile(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), min_n: int = 8) -> DataFrame:
    """Skewness and kurtosis with labels, Jarque–Bera and a suggested type."""
    keys = [*by, "variable"]
    long = to_long(df, cols, by).where(F.col("value").isNotNull())
    d = F.col("value") - F.col("__m")
    m = attach_stats(long, {"__m": F.avg("value")}, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(d * d).alias("m2"), F.avg(d * d * d).alias("m3"), F.avg(d * d * d * d).alias("m4"))
    s = F.try_divide(F.col("m3"), F.pow("m2", F.lit(1.5)))
    k = F.try_divide(F.col("m4"), F.col("m2") * F.col("m2")) - 3
    out = m.where(F.col("n") >= min_n).select(*keys, "n", s.alias("skewness"), k.alias("kurtosis"))
    s, k = F.col("skewness"), F.col("kurtosis")
    jb = F.col("n") / 6 * (s * s + k * k / 4)
    # Label bounds ±0.5 and ±1, significance 5 %.
    out = out.withColumn("skew_label", F.when(F.abs(s) < 0.5, "Approximately symmetric").when(s > 0, "Right-skewed").otherwise("Left-skewed"))
    out = out.withColumn("kurt_label", F.when(F.abs(k) < 0.5, "Mesokurtic").when(k > 0, "Leptokurtic").otherwise("Platykurtic"))
    out = out.withColumn("jarque_bera", jb).withColumn("jb_p", F.exp(-F.col("jarque_bera") / 2)).withColumn("is_normal", F.col("jb_p") > 0.05)
    kind = F.when(F.col("is_normal"), "Normal/Gaussian").when(s > 1, "Log-normal or Exponential").when(
        s < -1, "Left-skewed (consider reflection)").otherwise("Non-normal (consider transformation)")
    return out.withColumn("distribution_type", kind)


def normality_ks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Kolmogorov–Smirnov against a normal with the column's mean and std, at any n."""
    one = df.agg(*[f(c).alias(f"{t}{i}") for i, c in enumerate(cols) for f, t in ((F.avg, "m"), (F.stddev_samp, "s"))]).first()
    out = None
    for i, c in enumerate(cols):
        rows = df.select(F.col(c).cast("double").alias("x")).na.drop()
        t = KolmogorovSmirnovTest.test(rows, "x", "norm", float(one[f"m{i}"]), float(one[f"s{i}"]))
        t = t.select(F.lit(c).alias("variable"), "statistic", F.col("pValue").alias("p_value"), (F.col("pValue") > 0.05).alias("is_normal"))
        out = t if out is None else out.unionByName(t)
    return out


def trend_test(panel: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), ord_col: str = "ord") -> DataFrame:
    """Least-squares line on the period position: slope, r², p, has_trend."""
    long = to_long(panel, cols, [*keys, ord_col]).where(F.col("value").isNotNull())
    y, x = F.col("value"), F.col(ord_col)
    g = long.groupBy(*keys, "variable").agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"))
    return g.withColumn("p_value", f_pvalue(r2_to_f(F.col("r2"), F.col("n")), F.lit(1), F.col("n") - 2)).withColumn(
        "has_trend", F.col("p_value") < 0.05)


# Fixed value: asymptotic 5 % critical value of the unit-root test with a constant.
ADF_CRITICAL = -2.86


def adf_test(panel: DataFrame, col: str, keys: Sequence[str] = (), lags: int | None = None, max_lag: int | None = None, engine: str = "auto") -> DataFrame:
    """Augmented Dickey–Fuller with a constant: ``(keys…, n, lags, statistic, is_stationary)``.

    Without ``lags`` the number of lagged differences is picked by AIC, on the rows that all candidates share, up to
    ``max_lag`` or the bound 12 (n / 100)^(1/4) (a fixed rule) of each key's number of values; the regression is then refitted on all rows that the
    chosen lag leaves. Lagged levels and differences are block-wise window columns; one Gram per key holds the regressions
    of every lag count as sub-matrices. A key with too few values has no statistic.
    """
    keys = list(keys)
    if lags is not None:
        bound, tops = lags, None
    else:
        n = F.col("__n")
        own = F.greatest(F.lit(0), F.least(F.ceil(12 * F.pow(n / 100, F.lit(0.25))), F.floor(n / 2) - 2))
        own = own if max_lag is None else F.least(own, F.lit(max_lag))
        tops = settle(panel.groupBy(*keys).agg(F.count(col).alias("__n")).select(*keys, own.cast("int").alias("lags")))
        bound = tops.agg(F.max("lags")).first()[0] or 0   # one number: the widest regression
    b = Blocks(panel, keys, back=bound + 1)
    y = F.col(col).cast("double")
    diff = lambda k: b.at(y, -k) - b.at(y, -k - 1)
    wide = settle(b.select((y - b.at(y, -1)).alias("__d"), b.at(y, -1).alias("__l"), *[diff(k).alias(f"__d{k}") for k in range(1, bound + 1)])
                  .select(*keys, "__d", "__l", *[f"__d{k}" for k in range(1, bound + 1)]))
    cols = ["__l", *[f"__d{k}" for k in range(1, bound + 1)], "__d"]
    t = len(cols) - 1

    def solve(m: Moments, k: int) -> tuple[float, float] | None:
        """(AIC, t statistic) of the regression with k lagged differences."""
        idx = list(range(k + 1))
        a, c = m.cross[np.ix_(idx, idx)], m.cross[idx, t]
        if m.n <= k + 2 or np.linalg.cond(a) > 1e14:
            return None
        beta = np.linalg.solve(a, c)
        rss = max(m.cross[t, t] - beta @ c, 1e-300)
        se = np.sqrt(rss / (m.n - k - 2) * np.linalg.inv(a)[0, 0])
        return m.n * np.log(rss / m.n) + 2 * (k + 2), float(beta[0] / se)

    def gram_upto(limits: DataFrame | None) -> Gram:
        """Regressions with at most each key's ``lags``: differences beyond them do not matter, so rows that lack them take part."""
        met = wide.withColumn("lags", F.lit(lags)) if limits is None else null_safe(wide, limits, keys) if keys else wide.join(limits)
        own = met.select(*keys, "lags", "__d", "__l", *[F.when(F.lit(k) <= F.col("lags"), F.col(f"__d{k}")).otherwise(0.0).alias(f"__d{k}") for k in range(1, bound + 1)])
        return gram(own, cols, [*keys, "lags"], engine)

    fields = _key_fields(panel, keys)
    best = None
    if tops is not None:
        def pick(key, m: Moments) -> pd.DataFrame:
            found = [(r[0], k) for k in range(int(key[-1]) + 1) if (r := solve(m, k)) is not None]
            return pd.DataFrame([[*key[:-1], min(found)[1] if found else None]], columns=[*keys, "lags"])

        best = settle(per_group(gram_upto(tops), pick, ", ".join([*fields, "lags int"])).where("lags is not null"))
    g = gram_upto(best)

    def refit(key, m: Moments) -> pd.DataFrame:
        k = int(key[-1])
        found = solve(m, k)
        return pd.DataFrame([[*key[:-1], int(m.n), k, found[1] if found else None]], columns=[*keys, "n", "lags", "statistic"])

    out = per_group(g, refit, ", ".join([*fields, "n bigint", "lags int", "statistic double"]))
    return out.withColumn("is_stationary", F.col("statistic") < ADF_CRITICAL)


# Published level-stationarity critical values and their p.
KPSS_TABLE = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))


def kpss_test(panel: DataFrame, col: str, keys: Sequence[str] = (), lags: int | None = None, ord_col: str = "ord") -> DataFrame:
    """Level stationarity: η = Σ S² / (n² σ²), Newey–West variance with Bartlett weights; ``lags`` None: from the data.

    The data-driven number of lags is that of Hobijn, Franses and Ooms (2004): autocovariances up to n^(2/9) give the ratio s
    of their first moment to their sum, and floor(1.1447 (s²)^(1/3) n^(1/3)) lags are used. Partial sums run in two levels
    and lags inside blocks, so a long series is spread over many tasks. p is interpolated in the table, within [.01, .10].
    """
    keys = list(keys)
    base = panel.where(F.col(col).isNotNull()).select(*keys, ord_col, F.col(col).cast("double").alias("__y"))
    res = settle(attach_stats(base, {"__m": F.avg("__y")}, keys).withColumn("__e", F.col("__y") - F.col("__m")).drop("__m", "__y"))
    cum = prefix_sums(res, {"__s": F.col("__e")}, keys, ord_col)
    top = cum.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__s") * F.col("__s")).alias("__ss"))

    def products(upto: int) -> DataFrame:
        """Sums of e(t) e(t - k) of every key: __p0, __p1, ..."""
        b = Blocks(res, keys, ord_col, back=max(upto, 1))
        lagged = b.select(*[(F.col("__e") * b.at("__e", -k)).alias(f"__p{k}") for k in range(1, upto + 1)])
        return lagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col("__e") * F.col("__e")).alias("__p0"),
                                         *[F.coalesce(F.sum(f"__p{k}"), F.lit(0.0)).alias(f"__p{k}") for k in range(1, upto + 1)])

    if lags is None:
        longest = res.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
        few = int(longest ** (2 / 9))
        n = F.col("__n")
        own = F.floor(F.pow(n, F.lit(2 / 9)))
        terms = [F.when(F.lit(k) <= own, F.col(f"__p{k}") / (n / 2)).otherwise(0.0) for k in range(1, few + 1)]
        s0, s1 = F.col("__p0") / n, F.lit(0.0)
        for k, term in enumerate(terms, 1):
            s0, s1 = s0 + term, s1 + k * term
        s = F.try_divide(s1, s0)
        auto = F.least(F.floor(1.1447 * F.pow(s * s, F.lit(1 / 3)) * F.pow(n, F.lit(1 / 3))), n - 1)
        chosen = settle(products(few).select(*keys, F.coalesce(auto, F.lit(0)).cast("int").alias("lags")))
        upto = chosen.agg(F.max("lags")).first()[0] or 0
        sums = null_safe(products(upto), chosen, keys) if keys else products(upto).join(chosen)
    else:
        upto, sums = lags, products(lags).withColumn("lags", F.lit(lags))
    var = F.col("__p0")
    for k in range(1, upto + 1):
        var = var + F.when(F.lit(k) <= F.col("lags"), 2 * (1 - k / (F.col("lags") + 1)) * F.col(f"__p{k}")).otherwise(0.0)
    low = sums.select(*keys, "lags", var.alias("__var"))
    out = null_safe(top, low, keys) if keys else top.join(low)
    eta = F.try_divide(F.col("__ss"), F.col("n") * F.col("__var"))
    out = out.withColumn("statistic", eta)
    s = F.col("statistic")
    p = F.when(s <= KPSS_TABLE[0][0], F.lit(KPSS_TABLE[0][1]))
    for (c0, p0), (c1, p1) in zip(KPSS_TABLE, KPSS_TABLE[1:]):
        p = p.when(s <= c1, F.lit(p0) + (s - c0) * ((p1 - p0) / (c1 - c0)))
    p = p.when(s.isNotNull(), F.lit(KPSS_TABLE[-1][1]))
    return out.withColumn("p_value", p).withColumn("is_stationary", F.col("p_value") > 0.05).drop("__ss", "__var")


def seasonal_stats(df: DataFrame, col: str, season, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, season.alias("season")).agg(
        F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max"), F.count(col).alias("count"))


def seasonal_anova(df: DataFrame, col: str, season, by: Sequence[str] = ()) -> DataFrame:
    """One-way analysis of variance from per-season counts, means and squares."""
    per = df.where(F.col(col).isNotNull()).groupBy(*by, season.alias("season")).agg(
        F.count(F.lit(1)).alias("c"), F.avg(col).alias("m"), F.var_pop(col).alias("v"))
    g = per.groupBy(*by).agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("c") * F.col("v")).alias("__within"),
        (F.sum(F.col("c") * F.col("m") * F.col("m")) - F.sum(F.col("c") * F.col("m")) * F.sum(F.col("c") * F.col("m")) / F.sum("c")).alias("__between"))
    f = F.try_divide(F.col("__between") / F.nullif(F.col("k") - 1, F.lit(0)), F.col("__within") / F.nullif(F.col("n") - F.col("k"), F.lit(0)))
    return g.withColumn("f_statistic", f).withColumn("p_value", f_pvalue(F.col("f_statistic"), F.col("k") - 1, F.col("n") - F.col("k"))).withColumn(
        "is_seasonal", F.col("p_value") < 0.05).drop("__within", "__between")


def profile_findings(distribution: DataFrame, outliers: DataFrame, stationarity: DataFrame, trend: DataFrame, correlation: DataFrame,
                     order: Sequence[str] | None = None) -> DataFrame:
    """Rule-based flags ``(section, variable, finding)`` from the profile tables."""
    from .gram import high_correlations

    def flag(df: DataFrame, cond, section: str, finding: str, variable=None) -> DataFrame:
        v = variable if variable is not None else F.col("variable")
        return df.where(cond).select(F.lit(section).alias("section"), v.alias("variable"), F.lit(finding).alias("finding"))

    pair = high_correlations(correlation, 0.8, order)
    parts = [
        flag(distribution, ~F.col("is_normal"), "distribution", "non_normal"),
        flag(distribution, F.abs("skewness") > 1, "distribution", "highly_skewed"),
        flag(outliers, F.col("pct_outliers") > 5, "outliers", "more_than_5_pct"),
        flag(stationarity, ~F.col("is_stationary"), "stationarity", "non_stationary"),
        flag(trend, F.col("has_trend"), "stationarity", "trending"),
        flag(pair, F.lit(True), "correlation", "above_0.8", F.concat_ws("-", "var1", "var2")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
