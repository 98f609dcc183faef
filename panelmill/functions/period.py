"""Period literals and ordinals as column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months per calendar grain.
GRAIN_MONTHS = {"month": 1, "quarter": 3, "year": 12}

# The accepted text forms, 1999Q1, 1999-Q1 and 1999 Q1.
QUARTER_TEXT = r"^\s*(\d{4})[- ]*Q([1-4])\s*$"


def parse_quarter(text: Column) -> Column:
    """``YYYYQn``, ``YYYY-Qn`` or ``YYYY Qn`` to the quarter's first day, else NULL."""
    year = F.regexp_extract(text, QUARTER_TEXT, 1)
    quarter = F.regexp_extract(text, QUARTER_TEXT, 2)
    return F.when(
        year != "",
        F.make_date(year.try_cast("int"), (quarter.try_cast("int") - 1) * 3 + 1, F.lit(1)),
    )


def parse_decimal_quarter(value: Column) -> Column:
    """``1999.1`` … ``1999.4`` to the quarter's first day, else NULL."""
    x = value.cast("double")
    year = F.floor(x)
    quarter = F.round((x - year) * 10).cast("int")
    return F.when(
        quarter.between(1, 4), F.make_date(year.cast("int"), (quarter - 1) * 3 + 1, F.lit(1))
    )


def parse_period(text: Column) -> Column:
    """Quarter text or decimal quarter, whichever fits."""
    return F.coalesce(parse_quarter(text), parse_decimal_quarter(text.try_cast("double")))


def format_quarter(period: Column) -> Column:
    return F.concat(F.year(period).cast("string"), F.lit("Q"), F.quarter(period).cast("string"))


def season_number(period: Column, grain: str = "quarter") -> Column:
    return F.quarter(period) if grain == "quarter" else F.month(period)


def season_label(period: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(period).cast("string"))


def ordinal(period: Column, grain: str = "quarter") -> Column:
    """Integer position on the calendar: neighbouring periods differ by one."""
    if grain in GRAIN_MONTHS:
        months = F.year(period).cast("bigint") * 12 + F.month(period) - 1
        return F.floor(months / GRAIN_MONTHS[grain]).cast("bigint")
    if grain == "day":
        return F.unix_date(F.to_date(period)).cast("bigint")
    if grain == "hour":
        return F.floor(F.unix_seconds(period.cast("timestamp")) / 3600).cast("bigint")
    raise ValueError(f"unknown grain {grain!r}")


def truncate(ts: Column, grain: str) -> Column:
    """First instant of the period; a date for calendar grains, a timestamp for hours."""
    cut = F.date_trunc(grain, ts)
    return cut if grain == "hour" else F.to_date(cut)


def step(grain: str, n: int = 1) -> Column:
    unit = {"month": "MONTH", "year": "YEAR", "day": "DAY", "hour": "HOUR"}
    if grain == "quarter":
        return F.expr(f"INTERVAL {3 * n} MONTH")
    return F.expr(f"INTERVAL {n} {unit[grain]}")
