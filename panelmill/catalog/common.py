"""Registry of catalog queries: a Spark callable, an output spec, and oracle SQL.

The spec names the output columns and their kind, e.g. ``"n_name:s y:2 n:i"``:
s text, i integer, d date, t timestamp, b boolean, a digit rounds a double.
The same spec shapes both sides, so only the values are left to compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _spark_col(name: str, kind: str):
    c = F.col(f"`{name}`")
    if kind == "s":
        return c.cast("string").alias(name)
    if kind == "i":
        return c.cast("bigint").alias(name)
    if kind == "d":
        return c.cast("date").alias(name)
    if kind == "t":
        return c.cast("timestamp").alias(name)
    if kind == "b":
        return c.cast("boolean").alias(name)
    return (F.round(c.cast("double"), int(kind)) + F.lit(0.0)).alias(name)


def _sql_col(name: str, kind: str) -> str:
    types = {"s": "VARCHAR", "i": "BIGINT", "d": "DATE", "t": "TIMESTAMP", "b": "BOOLEAN"}
    if kind in types:
        return f'CAST("{name}" AS {types[kind]}) AS "{name}"'
    return f'round(CAST("{name}" AS DOUBLE), {kind}) + 0.0 AS "{name}"'


def query(name: str, spec: str, sql: str | None = None):
    fields = [tuple(f.rsplit(":", 1)) for f in spec.split()]

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, sf_dir).select(*[_spark_col(n, k) for n, k in fields])

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            body = ", ".join(_sql_col(n, k) for n, k in fields)
            ORACLE[name] = f"SELECT {body} FROM (\n{sql.strip()}\n) AS q"
        return run

    return wrap


# ---- oracle building blocks: the panels of plans/panels.py in SQL -------------

REGION_QUARTER = """
rq AS (
  SELECT r_name, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, sum(o_totalprice) AS y,
         CAST(floor((year(date_trunc('quarter', o_orderdate))*12 + month(date_trunc('quarter', o_orderdate)) - 1)/3) AS BIGINT) AS ord
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL)"""

NATION_MONTH = """
nm AS (
  SELECT n_name, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, sum(o_totalprice) AS y,
         CAST(count(*) AS DOUBLE) AS n_orders, avg(o_totalprice) AS avg_price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY ALL)"""

NATION_ALIGNED = NATION_MONTH + """,
cal AS (SELECT CAST(unnest(generate_series((SELECT min(period) FROM nm)::TIMESTAMP, (SELECT max(period) FROM nm)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS period),
na AS (
  SELECT k.n_name, cal.period, nm.y, nm.n_orders, nm.avg_price, CAST(year(cal.period)*12 + month(cal.period) - 1 AS BIGINT) AS ord
  FROM (SELECT DISTINCT n_name FROM nm) k CROSS JOIN cal LEFT JOIN nm ON nm.n_name = k.n_name AND nm.period = cal.period)"""

NATION_QUARTER = """
nq AS (
  SELECT n_name, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, sum(o_totalprice) AS y,
         CAST(count(*) AS DOUBLE) AS n_orders, avg(o_totalprice) AS avg_price,
         CAST(floor((year(date_trunc('quarter', o_orderdate))*12 + month(date_trunc('quarter', o_orderdate)) - 1)/3) AS BIGINT) AS ord
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY ALL)"""

# the quarterly panel on the gap-free calendar
QUARTER_ALIGNED = NATION_QUARTER.replace("nq AS", "nq0 AS") + """,
qcal AS (SELECT CAST(unnest(generate_series((SELECT min(period) FROM nq0)::TIMESTAMP, (SELECT max(period) FROM nq0)::TIMESTAMP, INTERVAL 3 MONTH)) AS DATE) AS period),
nq AS (SELECT k.n_name, qcal.period, nq0.y, nq0.n_orders, CAST(floor((year(qcal.period)*12 + month(qcal.period) - 1)/3) AS BIGINT) AS ord
  FROM (SELECT DISTINCT n_name FROM nq0) k CROSS JOIN qcal LEFT JOIN nq0 ON nq0.n_name = k.n_name AND nq0.period = qcal.period)"""

MONTH_SERIES = """
ms AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, sum(o_totalprice) AS y, CAST(count(*) AS DOUBLE) AS n_orders,
         CAST(count(DISTINCT o_custkey) AS DOUBLE) AS n_cust, avg(o_totalprice) AS avg_price,
         CAST(year(date_trunc('month', o_orderdate))*12 + month(date_trunc('month', o_orderdate)) - 1 AS BIGINT) AS ord
  FROM orders GROUP BY ALL)"""

EVENTS_HOUR = """
eh AS (
  SELECT event_type, date_trunc('hour', ts) AS period, CAST(count(*) AS DOUBLE) AS n, sum(value) AS total, avg(value) AS mean,
         CAST(floor(epoch(date_trunc('hour', ts))/3600) AS BIGINT) AS ord
  FROM events GROUP BY ALL)"""

LINE_ROWS = """
lr AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_brand, CAST(date_trunc('month', l_shipdate) AS DATE) AS period,
         ln(l_extendedprice*(1-l_discount)*(1+l_tax)) AS target, l_quantity, l_extendedprice, l_extendedprice/l_quantity AS unit_price,
         l_discount, l_tax, CAST(p_size AS DOUBLE) AS p_size, p_retailprice, s_acctbal,
         sin(2*3.141592653589793*dayofyear(l_shipdate)/365.25) AS doy_sin, cos(2*3.141592653589793*dayofyear(l_shipdate)/365.25) AS doy_cos,
         CAST(year(l_shipdate)*12 + month(l_shipdate) - 1 AS BIGINT) AS ord
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""

SUPPLIERS = """
sa AS (
  SELECT l_suppkey, round(sum(l_extendedprice*(1-l_discount)),4) AS revenue, round(avg(l_discount),6) AS discount,
         CAST(count(*) AS DOUBLE) AS lines, round(stddev_samp(l_quantity),6) AS spread
  FROM lineitem GROUP BY l_suppkey)"""

PARTS = """
pa AS (
  SELECT p_brand, l_partkey, round(sum(l_extendedprice*(1-l_discount)),4) AS revenue, round(avg(l_discount),6) AS discount,
         CAST(count(*) AS DOUBLE) AS lines, coalesce(round(stddev_samp(l_quantity),6),0.0) AS spread
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, l_partkey)"""

# walk-forward folds over an axis CTE ``ax(pos, ord, period)`` with n periods
def folds_sql(axis: str, min_train: int, test: int = 4, horizons=(1, 2, 4)) -> str:
    hs = ", ".join(f"({i},{h})" for i, h in enumerate(horizons))
    return f"""
ax AS (SELECT row_number() OVER (ORDER BY ord) - 1 AS pos, ord, period FROM (SELECT ord, min(period) AS period FROM {axis} GROUP BY ord)),
fp AS (
  SELECT row_number() OVER (ORDER BY i, e) - 1 AS fold_id, h AS horizon, e FROM (VALUES {hs}) AS hs(i, h),
         LATERAL (SELECT unnest(generate_series({min_train - 1}, (SELECT count(*) FROM ax), {test})) AS e)
  WHERE e + h + {test} <= (SELECT count(*) FROM ax)),
pl AS (
  SELECT fold_id, horizon, a.period AS train_start, b.period AS train_end, c.period AS test_start, d.period AS test_end,
         a.ord AS train_start_ord, b.ord AS train_end_ord, c.ord AS test_start_ord, d.ord AS test_end_ord, e + 1 AS train_size, {test} AS test_size
  FROM fp JOIN ax a ON a.pos = 0 JOIN ax b ON b.pos = e JOIN ax c ON c.pos = e + horizon JOIN ax d ON d.pos = e + horizon + {test} - 1)"""


# lag-1 forecasts of ln(y) on the aligned nation panel over walk-forward test rows
NAIVE_PREDICTIONS = NATION_ALIGNED + "," + folds_sql("na", 40) + """,
ly AS (SELECT n_name, period, ord, ln(y) AS actual, lag(ln(y), 1) OVER w AS naive, lag(ln(y), 12) OVER w AS seasonal FROM na WINDOW w AS (PARTITION BY n_name ORDER BY ord)),
preds AS (
  SELECT n_name, m.model, fold_id, horizon, period, actual, CASE WHEN m.model = 'naive' THEN naive ELSE seasonal END AS predicted
  FROM ly JOIN pl ON ly.ord BETWEEN pl.test_start_ord AND pl.test_end_ord CROSS JOIN (VALUES ('naive'), ('seasonal')) AS m(model)
  WHERE actual IS NOT NULL AND CASE WHEN m.model = 'naive' THEN naive ELSE seasonal END IS NOT NULL)"""
