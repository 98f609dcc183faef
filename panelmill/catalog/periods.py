"""Scans, sources, sinks and the period axis."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.period import format_quarter, parse_period, season_label, season_number
from ..operators.calendar import align_to_spine, coarsen, incomplete_periods, period_spine, to_period
from ..plans.panels import events_hour, month_series, nation_panel, table
from ..session import run_folder
from ..sources.schema import resolve_schema, validate_schema
from ..sources.tables import read_table, write_table
from .common import EVENTS_HOUR, MONTH_SERIES, NATION_ALIGNED, NATION_MONTH, query


@query("s1_read_table", "o_orderstatus:s n:i total:2", """
SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1""")
def s1(spark, sf):
    return read_table(spark, f"{sf}/orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@query("s1_read_table_filtered", "o_orderstatus:s n:i total:2", """
SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1""")
def s1b(spark, sf):
    """The filter reaches the scan."""
    df = read_table(spark, f"{sf}/orders")
    return df.where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@query("s2_write_table", "year:i n:i total:2", """
SELECT year(o_orderdate) AS year, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1""")
def s2(spark, sf):
    orders = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    path = write_table(orders, f"{run_folder(spark)}/s2-{uuid.uuid4().hex}", partition_by=["year"])
    return spark.read.parquet(path).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@query("s2_write_table_csv", "n_name:s period:d y:2 n_orders:0", f"WITH {NATION_MONTH} SELECT * FROM nm")
def s2csv(spark, sf):
    panel = nation_panel(spark, sf)
    path = write_table(panel, f"{run_folder(spark)}/s2-{uuid.uuid4().hex}.csv", fmt="csv")
    return read_table(spark, path, panel.schema)


# Aliases used by the schema queries.
ALIASES = {"date": ["Quarter", "Date", "Period", "orderdate"], "target": ["totalprice", "y"]}
FIELDS = {"date": "timestamp", "target": "double", "orderpriority": "string", "o_orderstatus": "int", "population": "double"}


@query("s3_resolve_schema", "date:t target:2 orderpriority:s o_orderstatus:i population:2", """
SELECT o_orderdate AS date, o_totalprice AS target, o_orderpriority AS orderpriority,
       try_cast(o_orderstatus AS INT) AS o_orderstatus, CAST(NULL AS DOUBLE) AS population FROM orders""")
def s3(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_totalprice", "y")
    return resolve_schema(orders, FIELDS, ALIASES)


@query("s3_validate_schema", "logical:s actual:s status:s n_rows:i n_cast_failed:i", """
SELECT * FROM (VALUES
 ('date','o_orderdate','ok',0),('target','y','ok',0),('orderpriority','o_orderpriority','ok',0),('o_orderstatus','o_orderstatus','ok',1),
 ('population',NULL,'missing',0),(NULL,'o_orderkey','extra',0),(NULL,'o_custkey','extra',0)) AS v(logical, actual, status, bad),
 (SELECT count(*) AS n_rows FROM orders),
 LATERAL (SELECT CASE WHEN bad = 1 THEN (SELECT count(*) FROM orders WHERE try_cast(o_orderstatus AS INT) IS NULL) ELSE 0 END AS n_cast_failed)""")
def s3b(spark, sf):
    return validate_schema(table(spark, sf, "orders").withColumnRenamed("o_totalprice", "y"), FIELDS, ALIASES)


@query("s4_parse_period", "o_orderkey:i period:d", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(date_trunc('quarter', o_orderdate) AS DATE) END AS period FROM orders""")
def s4(spark, sf):
    y, q = F.year("o_orderdate").cast("string"), F.quarter("o_orderdate").cast("string")
    form = F.col("o_orderkey") % 5
    text = (F.when(form == 0, F.concat(y, F.lit("Q"), q)).when(form == 1, F.concat(y, F.lit("-Q"), q))
            .when(form == 2, F.concat(y, F.lit(" Q"), q)).when(form == 3, F.concat(y, F.lit("."), q)).otherwise(F.concat(y, F.lit("Q7"))))
    return table(spark, sf, "orders").select("o_orderkey", text.alias("text")).select("o_orderkey", parse_period(F.col("text")).alias("period"))


@query("s5_format_period", "label:s year:i n:i", """
SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS label, year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1, 2""")
def s5(spark, sf):
    return table(spark, sf, "orders").groupBy(format_quarter(F.col("o_orderdate")).alias("label"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("s6_period_spine", "period:d n_orders:i", """
WITH sp AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1994-01-01', TIMESTAMP '2002-10-01', INTERVAL 3 MONTH)) AS DATE) AS period)
SELECT period, count(o_orderkey) AS n_orders FROM sp LEFT JOIN orders ON date_trunc('quarter', o_orderdate) = period GROUP BY 1""")
def s6(spark, sf):
    spine = period_spine(spark, "1994-01-01", "2002-10-01")
    n = to_period(table(spark, sf, "orders"), "o_orderdate", [], {"n_orders": F.count(F.lit(1))}).drop("period")
    return spine.join(n, "ord", "left").na.fill(0, ["n_orders"])


@query("s7_align_to_spine", "n_name:s period:d ord:i y:2 n_orders:0", f"WITH {NATION_ALIGNED} SELECT * FROM na")
def s7(spark, sf):
    return align_to_spine(nation_panel(spark, sf), ["n_name"], "month")


@query("s7_align_events_hour", "event_type:s n_periods:i n_incomplete:i", f"""
WITH {EVENTS_HOUR},
sp AS (SELECT unnest(generate_series((SELECT min(period) FROM eh), (SELECT max(period) FROM eh), INTERVAL 1 HOUR)) AS period)
SELECT k.event_type, count(*) AS n_periods, count(*) FILTER (eh.n IS NULL) AS n_incomplete
FROM (SELECT DISTINCT event_type FROM eh) k CROSS JOIN sp LEFT JOIN eh ON eh.event_type = k.event_type AND eh.period = sp.period GROUP BY 1""")
def s7b(spark, sf):
    return incomplete_periods(align_to_spine(events_hour(spark, sf), ["event_type"], "hour"), ["n", "total"], ["event_type"])


@query("s8_to_period", "n_name:s period:d y:2 n_orders:0 avg_price:6", f"WITH {NATION_MONTH} SELECT * FROM nm")
def s8(spark, sf):
    return nation_panel(spark, sf)


@query("s8_coarsen_year", "n_name:s period:d y:2 avg_n:6", f"""
WITH {NATION_MONTH} SELECT n_name, CAST(date_trunc('year', period) AS DATE) AS period, sum(y) AS y, avg(n_orders) AS avg_n FROM nm GROUP BY 1, 2""")
def s8b(spark, sf):
    panel = nation_panel(spark, sf)
    mean = coarsen(panel, ["n_name"], ["n_orders"], "year", "mean").select("n_name", "period", F.col("n_orders").alias("avg_n"))
    return coarsen(panel, ["n_name"], ["y"], "year", "sum").join(mean, ["n_name", "period"])


@query("s9_seasonal_index", "season:i month:i label:s n:i", f"""
WITH {MONTH_SERIES} SELECT quarter(period) AS season, month(period) AS month, 'Q' || quarter(period) AS label, count(*) AS n FROM ms GROUP BY ALL""")
def s9(spark, sf):
    p = F.col("period")
    return month_series(spark, sf).groupBy(season_number(p).alias("season"), season_number(p, "month").alias("month"), season_label(p).alias("label")).agg(F.count(F.lit(1)).alias("n"))
