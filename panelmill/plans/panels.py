"""Panels and row tables built from the star schema; inputs of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.calendar import align_to_spine, to_period
from ..sources.tables import read_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation")
    return (orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
            .join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "n_name", "n_regionkey"))


def region_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue per region and quarter of all orders."""
    region = table(spark, sf_dir, "region")
    facts = orders_by_nation(spark, sf_dir).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return to_period(facts, "o_orderdate", ["r_name"], {"y": F.sum("o_totalprice")}, "quarter")


def nation_panel(spark: SparkSession, sf_dir: str, grain: str = "month") -> DataFrame:
    """Revenue, orders and mean price per nation and period (may have gaps)."""
    facts = orders_by_nation(spark, sf_dir)
    return to_period(facts, "o_orderdate", ["n_name"], {
        "y": F.sum("o_totalprice"), "n_orders": F.count(F.lit(1)).cast("double"),
        "avg_price": F.avg("o_totalprice")}, grain)


def nation_aligned(spark: SparkSession, sf_dir: str, grain: str = "month") -> DataFrame:
    return align_to_spine(nation_panel(spark, sf_dir, grain), ["n_name"], grain)


def month_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One keyless monthly series with four variables."""
    orders = table(spark, sf_dir, "orders")
    # distinct customers per month through a pre-aggregation: no wide distinct set in one task
    month = F.to_date(F.date_trunc("month", "o_orderdate"))
    per_customer = orders.groupBy(month.alias("period"), "o_custkey").agg(
        F.sum("o_totalprice").alias("s"), F.count(F.lit(1)).alias("n"))
    rolled = per_customer.groupBy("period").agg(
        F.sum("s").alias("y"), F.sum("n").cast("double").alias("n_orders"),
        F.count(F.lit(1)).cast("double").alias("n_cust"),
        (F.sum("s") / F.sum("n")).alias("avg_price"))
    from ..functions.period import ordinal

    return rolled.withColumn("ord", ordinal(F.col("period"), "month"))


def events_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_period(table(spark, sf_dir, "events"), "ts", ["event_type"], {
        "n": F.count(F.lit(1)).cast("double"), "total": F.sum("value"), "mean": F.avg("value")}, "hour")


# The feature names of the line-item regression table.
LINE_FEATURES = ["l_quantity", "l_extendedprice", "unit_price", "l_discount", "l_tax",
                 "p_size", "p_retailprice", "s_acctbal", "doy_sin", "doy_cos"]


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: log of the charged price and ten features, by ship month."""
    from ..functions.period import ordinal

    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    angle = 2 * 3.141592653589793 * F.dayofyear("l_shipdate") / 365.25
    rows = (line.join(part, F.col("l_partkey") == F.col("p_partkey"))
            .join(supplier, F.col("l_suppkey") == F.col("s_suppkey")))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_brand",
        F.to_date(F.date_trunc("month", "l_shipdate")).alias("period"),
        F.log(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("target"),
        "l_quantity", "l_extendedprice", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        "l_discount", "l_tax", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", "s_acctbal",
        F.sin(angle).alias("doy_sin"), F.cos(angle).alias("doy_cos"),
    ).withColumn("ord", ordinal(F.col("period"), "month"))


def supplier_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as alternatives: revenue, discount, lines, spread of quantity."""
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy("l_suppkey").agg(
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("discount"),
        F.count(F.lit(1)).cast("double").alias("lines"),
        F.round(F.stddev_samp("l_quantity"), 6).alias("spread"))


def part_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as alternatives inside their brand."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("discount"),
        F.count(F.lit(1)).cast("double").alias("lines"),
        F.coalesce(F.round(F.stddev_samp("l_quantity"), 6), F.lit(0.0)).alias("spread"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")


# Criterion kinds and weights of the alternative tables.
ALT_CRITERIA = {"revenue": "benefit", "discount": "cost", "lines": "benefit", "spread": "cost"}
ALT_WEIGHTS = {"revenue": 0.4, "discount": 0.25, "lines": 0.2, "spread": 0.15}


def naive_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last-month and same-month-last-year forecasts of log revenue on walk-forward test rows."""
    from ..operators.distributed import Blocks
    from ..operators.folds import assign_folds, fold_plan, period_axis

    panel = nation_aligned(spark, sf_dir).withColumn("actual", F.ln("y"))
    b = Blocks(panel, ["n_name"], back=12)
    wide = b.select(b.at("actual", -1).alias("naive"), b.at("actual", -12).alias("seasonal"))
    tests = assign_folds(wide, fold_plan(period_axis(panel), 40))
    long = tests.unpivot(["n_name", "fold_id", "horizon", "period", "actual"], ["naive", "seasonal"], "model", "predicted")
    return long.where(F.col("actual").isNotNull() & F.col("predicted").isNotNull())
