"""Reading and writing tables: parquet first, CSV where there is no parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet, else CSV; a path without a readable table is retried with the other extension."""
    stem = path.rsplit(".", 1)[0] if path.endswith((".parquet", ".csv")) else path
    tries = [path] if path.endswith((".parquet", ".csv")) else [path, f"{path}.parquet"]
    tries += [p for p in (f"{stem}.parquet", f"{stem}.csv") if p not in tries]
    error: Exception | None = None
    for candidate in tries:
        try:
            if candidate.endswith(".csv"):
                reader = spark.read.option("header", True)
                return reader.schema(schema).csv(candidate) if schema else reader.option("inferSchema", True).csv(candidate)
            return spark.read.parquet(candidate)
        except AnalysisException as e:  # path missing or not parquet: next form
            error = error or e
    raise error


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                mode: str = "errorifexists") -> str:
    """Write a table; arrays and structs become JSON text when the format is CSV."""
    if fmt == "csv":
        from pyspark.sql import functions as F

        nested = (T.ArrayType, T.StructType, T.MapType)
        df = df.select(*[
            F.to_json(c.name).alias(c.name) if isinstance(c.dataType, nested) else F.col(c.name)
            for c in df.schema])
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path
