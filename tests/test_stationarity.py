"""Unit-root and stationarity tests with lags from the data, against numpy."""

import math

import numpy as np
import pytest

from panelmill.operators import profile as P


def slow_adf(y):
    """Lag by AIC on common rows, then least squares on all rows of that lag."""
    d, n = np.diff(y), len(y)
    top = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)

    def fit(k, start):
        t = np.arange(start, len(d))
        x = np.column_stack([np.ones(len(t)), y[t], *[d[t - j] for j in range(1, k + 1)]])
        beta, *_ = np.linalg.lstsq(x, d[t], rcond=None)
        rss = ((d[t] - x @ beta) ** 2).sum()
        se = math.sqrt(rss / (len(t) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
        return len(t) * math.log(rss / len(t)) + 2 * x.shape[1], beta[1] / se, len(t)

    best = min(range(top + 1), key=lambda k: fit(k, top)[0])
    _, statistic, rows = fit(best, best)
    return rows, best, statistic


def slow_kpss(y):
    n, e = len(y), y - y.mean()
    gamma = lambda i: (e[i:] @ e[:n - i])
    few = int(n ** (2 / 9))
    s0 = gamma(0) / n + sum(gamma(i) / (n / 2) for i in range(1, few + 1))
    s1 = sum(i * gamma(i) / (n / 2) for i in range(1, few + 1))
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    var = (gamma(0) + 2 * sum(gamma(i) * (1 - i / (lags + 1)) for i in range(1, lags + 1))) / n
    return lags, (np.cumsum(e) ** 2).sum() / n**2 / var


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(5)
    out, rows = {}, []
    for k, (n, rho) in enumerate(((300, 0.6), (90, 1.0), (40, 0.9))):
        y = np.zeros(n)
        for t in range(1, n):
            y[t] = rho * y[t - 1] + rng.normal() + (0.5 * (y[t - 1] - y[t - 2]) if t > 1 else 0)
        out[k] = y
        rows += [(k, t, float(v)) for t, v in enumerate(y)]
    return out, spark.createDataFrame(rows, "k int, ord long, v double")


def test_unit_root_lag_and_refit(series):
    out, df = series
    got = {r["k"]: r for r in P.adf_test(df, "v", ["k"]).collect()}
    for k, y in out.items():
        rows, lags, statistic = slow_adf(y)
        assert (got[k]["n"], got[k]["lags"]) == (rows, lags) and np.isclose(got[k]["statistic"], statistic)
    one = P.adf_test(df.where("k = 0"), "v").first()
    assert np.isclose(one["statistic"], slow_adf(out[0])[2]) and one["is_stationary"]


def test_stationarity_bandwidth(series):
    out, df = series
    got = {r["k"]: r for r in P.kpss_test(df, "v", ["k"]).collect()}
    for k, y in out.items():
        lags, statistic = slow_kpss(y)
        assert got[k]["lags"] == lags and np.isclose(got[k]["statistic"], statistic)
    assert np.isclose(P.kpss_test(df.where("k = 1"), "v").first()["statistic"], slow_kpss(out[1])[1])
