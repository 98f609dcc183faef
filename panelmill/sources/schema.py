"""Logical column names resolved from metadata, and a report on the result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def find_column(columns: Sequence[str], logical: str, aliases: Mapping[str, Sequence[str]]) -> str | None:
    """Exact name ignoring case, then an alias, then a name that contains the logical one."""
    lowered = {c.lower(): c for c in reversed(list(columns))}
    for wanted in (logical, *aliases.get(logical.lower(), ())):
        if wanted.lower() in lowered:
            return lowered[wanted.lower()]
    return next((c for c in columns if logical.lower() in c.lower()), None)


def auto_detect(columns: Sequence[str], aliases: Mapping[str, Sequence[str]]) -> dict:
    """Date and target by the first alias contained in a name; the rest are features."""
    found: dict = {}
    for role in ("date", "target"):
        hit = next((c for a in aliases.get(role, ()) for c in columns if a.lower() in c.lower()), None)
        if hit is not None:
            found[role] = hit
    found["features"] = [c for c in columns if c not in (found.get("date"), found.get("target"))]
    return found


def resolve_schema(df: DataFrame, fields: Mapping[str, str], aliases: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """One projection of logical names with their types; NaN becomes NULL.

    ``fields`` maps a logical name to a Spark type. A value that does not cast
    is NULL (counted by ``validate_schema``); a column that is missing is NULL.
    """
    aliases = aliases or {}
    out = []
    for logical, dtype in fields.items():
        actual = find_column(df.columns, logical, aliases)
        if actual is None:
            out.append(F.lit(None).cast(dtype).alias(logical))
            continue
        value = F.col(f"`{actual}`").try_cast(dtype)
        if dtype in ("double", "float"):
            value = F.nanvl(value, F.lit(None).cast(dtype))
        out.append(value.alias(logical))
    return df.select(*out)


def validate_schema(df: DataFrame, fields: Mapping[str, str], aliases: Mapping[str, Sequence[str]] | None = None,
                    required: Sequence[str] = ("date", "target")) -> DataFrame:
    """Tidy report ``(logical, actual, status, n_rows, n_cast_failed)``.

    Status is ok, error (a required field is absent), missing, or extra (a
    column no field maps to). Cast failures come from one aggregation.
    """
    aliases = aliases or {}
    mapping = {f: find_column(df.columns, f, aliases) for f in fields}
    entries = []
    for logical, actual in mapping.items():
        status = "ok" if actual else ("error" if logical in required else "missing")
        failed = F.lit(0).cast("bigint")
        if actual:
            col = F.col(f"`{actual}`")
            failed = F.count(F.when(col.isNotNull() & col.try_cast(fields[logical]).isNull(), 1))
        entries.append((logical, actual, status, failed))
    for extra in [c for c in df.columns if c not in mapping.values()]:
        entries.append((None, extra, "extra", F.lit(0).cast("bigint")))
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *[e[3].alias(f"f{i}") for i, e in enumerate(entries)])
    rows = F.array(*[
        F.struct(F.lit(lg).cast("string").alias("logical"), F.lit(ac).cast("string").alias("actual"),
                 F.lit(st).alias("status"), F.col("n_rows"), F.col(f"f{i}").alias("n_cast_failed"))
        for i, (lg, ac, st, _) in enumerate(entries)])
    return one.select(F.inline(rows))
