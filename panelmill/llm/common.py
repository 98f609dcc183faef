"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: int, limit: int, field: int | None = None) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of a batch whose texts hold about ``limit`` bytes (one row at least); texts may be a struct's field."""
    texts = batch.column(column)
    sizes = pc.binary_length(texts if field is None else texts.field(field)).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if start < len(sizes):
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: int = 0) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def doc_key(text: Column) -> Column:
    """Digest that tells rows of the same id apart; null and empty texts differ."""
    return F.coalesce(F.md5(text), F.lit("null"))


def nest(docs: DataFrame, **more: Column) -> DataFrame:
    """All columns of ``docs`` in one struct ``row``, beside new columns that so cannot clash with them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(name) for name, c in more.items()])


def unnest(nested: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """Columns of the struct ``row`` again, and ``more`` beside them."""
    return nested.select(*[F.col("row").getField(c).alias(c) for c in columns], *more)


def with_text(row: pa.StructArray, at: int, texts: list[str | None]) -> pa.StructArray:
    """The struct array with new values in the column at place ``at``."""
    parts = [pa.array(texts, f.type) if i == at else row.field(i) for i, f in enumerate(row.type)]
    return pa.StructArray.from_arrays(parts, fields=list(row.type))


def maybe_in(rows: DataFrame, mark: str, members: DataFrame, bits: int = 24) -> DataFrame:
    """``rows`` with the column ``maybe``: false only where the hash ``mark`` (long) is not among those of ``members``.

    The members' hashes set bits in a table of 2**bits bits, 2 MB, which Spark builds in pieces of 4 KB and broadcasts; as
    members grow more rows are marked in vain, never fewer than there should be.
    """
    slot = F.pmod(F.col(mark), F.lit(1 << bits))
    table = members.select(slot.alias("slot")).groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bitmap"))
    met = rows.withColumn("slot", slot).withColumn("at", F.expr("bitmap_bit_position(slot)")).join(F.broadcast(table), F.expr("bitmap_bucket_number(slot)") == F.col("bucket"), "left")
    bit = F.expr("coalesce(shiftright(cast(conv(hex(substring(bitmap, cast(at div 8 as int) + 1, 1)), 16, 10) as int), cast(at % 8 as int)) % 2 = 1, false)")
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], bit.alias("maybe"))


def fresh(columns: Sequence[str], name: str) -> str:
    """``name``, with as many underscores as it takes to be none of ``columns`` in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
