"""Building blocks that keep every operator free of unbounded groups.

* ``attach_stats``   – per-group statistics put back on the rows
* ``Blocks``         – window functions over a long series cut into ordinal blocks
* ``prefix_sums``    – cumulative sums in two levels (inside blocks, over blocks)
* ``running_before`` – running sums in a global order by a sample sort
* ``quantiles``      – exact interpolated quantiles between sketched brackets
* ``value_ranks``    – exact ranks of all values without a global sort task
* ``permuted``       – a keyed permutation of columns that does not depend on the layout
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle

BLOCK = 4096       # ordinals per block of a long series


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` that also matches NULL keys; right keys are dropped."""
    if not keys:
        raise ValueError("keys needed")
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    joined = left.join(renamed, cond, how)
    return joined.drop(*[f"__r_{k}" for k in keys]) if how != "left_anti" and how != "left_semi" else joined


def attach_stats(df: DataFrame, stats: dict[str, Column], by: Sequence[str] = (), source: DataFrame | None = None) -> DataFrame:
    """Add group statistics to every row.

    With ``by`` the group table is aggregated and written first, so its true
    size is known when the join is planned: below Spark's broadcast limit the
    rows are not shuffled at all, above it a sort-merge join with AQE skew
    splitting takes over. Without ``by`` the single row comes in as an
    uncorrelated scalar subquery.
    """
    base = source if source is not None else df
    if by:
        table = settle(base.groupBy(*by).agg(*[c.alias(n) for n, c in stats.items()]))
        return null_safe(df, table, list(by), "left")
    one = base.agg(F.struct(*[c.alias(n) for n, c in stats.items()]).alias("s"))
    out = df.withColumn("__s", one.scalar())
    return out.select(*df.columns, *[F.col("__s").getField(n).alias(n) for n in stats])


class Blocks:
    """A panel cut into blocks of consecutive ordinals with overlapping halos.

    A bounded frame (lag k, rolling n) of a row needs rows at most ``back``
    ordinals before and ``ahead`` after it. Those few rows are copied into the
    neighbouring block, so one task sorts one block and not one series, even if
    a single series holds most of the table. Frames are RANGE frames on the
    ordinal: gaps count as missing periods, as on the gap-free calendar.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], ord_col: str = "ord",
                 back: int = 0, ahead: int = 0, size: int = BLOCK):
        self.keys, self.ord = list(keys), ord_col
        self.columns = df.columns
        home = F.floor(F.col(ord_col) / size)
        lo = F.floor((F.col(ord_col) - ahead) / size)
        hi = F.floor((F.col(ord_col) + back) / size)
        if back or ahead:
            self.df = df.withColumn("__blk", F.explode(F.sequence(lo, hi))).withColumn(
                "__own", F.col("__blk") == home)
        else:
            self.df = df.withColumn("__blk", home).withColumn("__own", F.lit(True))
        self.spec = W.partitionBy(*self.keys, "__blk").orderBy(ord_col)

    def at(self, col: Column | str, offset: int) -> Column:
        """Value ``offset`` periods away (negative = earlier)."""
        return F.max(col).over(self.spec.rangeBetween(offset, offset))

    def frame(self, start: int, end: int):
        return self.spec.rangeBetween(start, end)

    def select(self, *cols) -> DataFrame:
        """Evaluate window expressions and keep each row once, in its own block."""
        return self.df.select("*", *cols).where("__own").drop("__blk", "__own")


def prefix_sums(df: DataFrame, cols: dict[str, Column], keys: Sequence[str] = (),
                ord_col: str = "ord", size: int = BLOCK, inclusive: bool = True) -> DataFrame:
    """Running sums over a series of any length, in two levels."""
    keys = list(keys)
    blk = df.withColumn("__blk", F.floor(F.col(ord_col) / size))
    for name, expr in cols.items():
        blk = blk.withColumn(f"__v_{name}", expr)
    sums = blk.groupBy(*keys, "__blk").agg(*[F.sum(f"__v_{n}").alias(f"__b_{n}") for n in cols])
    over = W.partitionBy(*keys, F.lit(0)).orderBy("__blk").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, "__blk", *[F.coalesce(F.sum(f"__b_{n}").over(over), F.lit(0.0)).alias(f"__o_{n}") for n in cols])
    end = W.currentRow if inclusive else -1
    inner = W.partitionBy(*keys, "__blk").orderBy(ord_col).rowsBetween(W.unboundedPreceding, end)
    out = null_safe(blk, sums, [*keys, "__blk"])
    out = out.select(*df.columns, *[
        (F.col(f"__o_{n}") + F.coalesce(F.sum(f"__v_{n}").over(inner), F.lit(0.0))).alias(n) for n in cols])
    return out


def to_long(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = (),
            name: str = "variable", value: str = "value") -> DataFrame:
    """Wide to long; all value columns as DOUBLE, NaN as NULL."""
    wide = df.select(*ids, *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in cols])
    return wide.unpivot(list(ids), list(cols), name, value)


ROWS_A_RANGE = 1_000_000   # rows of a range of a sorted table, about


def running_before(table: DataFrame, keys: Sequence[str], order: Sequence, weight: str, name: str = "before") -> DataFrame:
    """Add to every row the sum of ``weight`` over the rows of its keys that come earlier in ``order``.

    A sample sort: rows go to ranges of (keys, order) whose number grows with the table, each task adds up its sorted range,
    and one number a range, and then one a key, closes the gaps. No group is sorted as a whole, however large; rows of equal
    keys and order must be one row.
    """
    keys = list(keys)
    pinned = settle(table)   # the ranges are sampled from it before they are made
    ranges = max(int(pinned.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pinned.count() // ROWS_A_RANGE))
    by = [*[F.col(k) for k in keys], *order]
    placed = pinned.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("__pid", F.spark_partition_id())
    names, at = [*placed.columns, "__local"], placed.columns.index(weight)

    def run(batches):
        total = 0
        for batch in batches:
            w = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.cumsum(w)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto - w + total)], names=names)
            total += int(upto[-1]) if len(upto) else 0

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema)
    local = settle(placed.mapInArrow(run, f"{kinds}, __local bigint"))
    sizes = local.groupBy("__pid").agg(F.max(F.col("__local") + F.col(weight)).alias("__t"))
    over = W.orderBy("__pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = settle(sizes.select("__pid", F.coalesce(F.sum("__t").over(over), F.lit(0)).alias("__o")))
    summed = local.join(offsets, "__pid").withColumn("__g", F.col("__o") + F.col("__local")).drop("__pid", "__o", "__local")
    if not keys:
        return summed.withColumnRenamed("__g", name)
    starts = settle(summed.groupBy(*keys).agg(F.min("__g").alias("__first")))
    return null_safe(summed, starts, keys).withColumn(name, F.col("__g") - F.col("__first")).drop("__g", "__first")


ACCURACY = 2000   # of the sketch that brackets a quantile
MARGIN = 4        # brackets reach this many times its error to either side


def quantiles(long: DataFrame, probs: Sequence[float], by: Sequence[str] = ("variable",),
              value: str = "value") -> DataFrame:
    """Exact quantiles with linear interpolation: ``(by…, n, q ARRAY)``.

    A mergeable sketch gives two edges around each wanted rank. One pass keeps the values inside these brackets, merged with
    their count, and counts the others by the gap between edges that they fall in; running sums over that small table name
    the exact values. Edges are written first, so rows are not shuffled where they are few. A value that fills half of the
    table is one row. The values themselves are written before that: sums that another run adds up in another order would
    lie beside their brackets.
    """
    by = list(by)
    rows = settle(long.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias(value)))
    found = order_values(rows, probs, by, value, lambda p, n: [F.floor(p * (n - 1)), F.ceil(p * (n - 1))])
    aggs = []
    for i, p in enumerate(probs):
        pos = p * (F.first("n") - 1)
        lo = F.max(F.when((F.col("i") == i) & (F.col("side") == 0), F.col("v")))
        hi = F.max(F.when((F.col("i") == i) & (F.col("side") == 1), F.col("v")))
        aggs.append(lo + (hi - lo) * (pos - F.floor(pos)))
    return found.groupBy(*by).agg(F.first("n").alias("n"), F.array(*aggs).alias("q"))


def order_values(rows: DataFrame, probs: Sequence[float], by: Sequence[str], value: str, ranks_of: Callable[[float, Column], list[Column]]) -> DataFrame:
    """``(by…, n, i, side, v, below, ties)``: the value at each rank (from 0) of ``ranks_of(p, n)`` for the i-th of ``probs``.

    ``rows`` has ``by`` and doubles without nulls, the same ones whenever it is read. Ranks lie within one of p (n - 1).
    """
    cuts = sorted({min(1.0, max(0.0, p + side * MARGIN / ACCURACY)) for p in probs for side in (-1, 1)})
    edges = settle(rows.groupBy(*by).agg(F.percentile_approx(value, cuts, ACCURACY).alias("__e"), F.count(F.lit(1)).alias("__n"), F.min(value).alias("__min"), F.max(value).alias("__max")))
    pairs = []
    for p in probs:
        low, high = (min(1.0, max(0.0, p + side * MARGIN / ACCURACY)) for side in (-1, 1))
        lo = F.col("__min") if low == 0.0 else F.get("__e", F.lit(cuts.index(low)))
        hi = F.col("__max") if high == 1.0 else F.get("__e", F.lit(cuts.index(high)))
        pairs.append((lo, hi))
    bounds = settle(edges.select(*by, "__n", *[c.alias(f"__{s}{i}") for i, pair in enumerate(pairs) for s, c in zip("lh", pair)]))
    met = null_safe(rows, bounds, by) if by else rows.join(bounds)   # without keys: one row
    v = F.col(value)
    inside = reduce(lambda a, b: a | b, [v.between(F.col(f"__l{i}"), F.col(f"__h{i}")) for i in range(len(probs))])
    steps = [F.when(F.col(f"__{s}{i}") <= v, F.col(f"__{s}{i}")) for i in range(len(probs)) for s in "lh"]
    key = F.when(inside, v).otherwise(F.coalesce(F.greatest(*steps), F.lit(float("-inf"))))
    counts = met.groupBy(*by, key.alias("__k"), inside.alias("__in")).agg(F.count(F.lit(1)).alias("__c"), F.max("__n").alias("__n"))
    sums = running_before(counts, by, [F.col("__k"), F.col("__in").desc()], "__c", "__before")
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), r.cast("bigint").alias("r"))
                      for i, p in enumerate(probs) for side, r in enumerate(ranks_of(p, F.col("__n")))])
    hits = F.filter(ranks, lambda t: (t["r"] >= F.col("__before")) & (t["r"] < F.col("__before") + F.col("__c")))
    return sums.withColumn("__t", F.explode(hits)).select(
        *by, F.col("__n").alias("n"), F.col("__t.i").alias("i"), F.col("__t.side").alias("side"),
        F.when(F.col("__in"), F.col("__k")).otherwise(F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")).alias("v"),
        F.col("__before").alias("below"), F.col("__c").alias("ties"))


def value_ranks(long: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``(by…, value, ties, below)``: how many rows lie below each distinct value.

    The average rank of a value is ``below + (ties + 1) / 2``. Distinct values are counted first and then sorted by ranges.
    """
    counted = long.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties"))
    return running_before(counted, by, [F.col(value)], "ties", "below").select(*by, value, "ties", "below")


def average_rank(df: DataFrame, value: str, by: Sequence[str] = (), descending: bool = False,
                 name: str = "rank", truncate: bool = True) -> DataFrame:
    """Average rank of ``value`` inside each group, ties shared, cut to an integer."""
    by = list(by)
    ranked = df.withColumn("__v", -F.col(value) if descending else F.col(value))
    table = value_ranks(ranked, by, "__v")
    rank = F.col("below") + (F.col("ties") + 1) / 2
    rank = F.floor(rank).cast("int") if truncate else rank
    return null_safe(ranked, table, [*by, "__v"], "left").withColumn(name, rank).drop("__v", "ties", "below")


PERMUTED = 4096    # rows of a bucket that exchange their values, about


def permuted(df: DataFrame, cols: Sequence[str], ids: Sequence[str], repeats: int = 1, seed: int = 42, only: int | None = None, name: str = "__p") -> DataFrame:
    """Every row with the values of ``cols`` of another row: a struct ``name`` (an array of ``repeats`` structs without ``only``).

    A digest of the row's ``ids`` deals rows to buckets of about PERMUTED; inside a bucket repeat r orders rows by the digest
    of ids, seed and r, and each takes the values of the next one, the last those of the first. Rows are shuffled and sorted
    once, by bucket, whatever the number of repeats; orders are made a bucket at a time. So a result depends on the
    rows alone, not on how they lie, every value is used once, and no row number or join is needed. ``only`` gives one repeat.
    Rows of equal ids are ordered by their values.
    """
    return exchanged(dealt(df, cols, ids), cols, repeats, seed, only, name)


def dealt(df: DataFrame, cols: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """The rows by bucket (``__bucket``) with the ``__key`` of their ids: what ``permuted`` shuffles, the same for all repeats."""
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ids])
    buckets = max(1, -(-df.count() // PERMUTED))
    bucket = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % buckets
    keyed = df.withColumn("__bucket", bucket).withColumn("__key", key.cast("binary"))
    return keyed.repartition("__bucket").sortWithinPartitions("__bucket", *cols)


def exchanged(placed: DataFrame, cols: Sequence[str], repeats: int = 1, seed: int = 42, only: int | None = None, name: str = "__p") -> DataFrame:
    """``permuted`` of rows that are ``dealt``; no shuffle."""
    cols = list(cols)
    rounds = [only] if only is not None else list(range(repeats))
    tails = [f"|{seed}|{r}".encode() for r in rounds]
    columns = [c for c in placed.columns if c not in ("__bucket", "__key")]
    at = [columns.index(c) for c in cols]

    def partners(keys: Sequence[bytes], tail: bytes) -> np.ndarray:
        """The row whose values each row takes; rows of equal keys keep their order."""
        d = np.frombuffer(b"".join([hashlib.md5(k + tail).digest() for k in keys]), ">u8").reshape(-1, 2)
        order = np.lexsort((d[:, 1], d[:, 0]))
        out = np.empty(len(order), dtype=np.int64)
        out[order] = np.roll(order, -1)
        return out

    def turned(rows: pa.Table) -> pa.RecordBatch:
        """Whole buckets, with the values of the partners."""
        one = [pa.concat_arrays(c.chunks) for c in rows.columns]
        b, keys = one[-2].to_numpy(), one[-1].to_pylist()
        ends = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
        take = np.empty((len(b), len(tails)), dtype=np.int64)
        for lo, hi in zip(ends, ends[1:]):
            for i, tail in enumerate(tails):
                take[lo:hi, i] = lo + partners(keys[lo:hi], tail)
        flat = pa.array(take.ravel())
        got = pa.StructArray.from_arrays([one[i].take(flat) for i in at], names=cols)
        if only is None:
            got = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(tails)), pa.int32()), got)
        return pa.RecordBatch.from_arrays([*one[:len(columns)], got], names=[*columns, name])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            b = t["__bucket"].to_numpy()
            whole = int(np.searchsorted(b, b[-1]))   # the last bucket may go on
            held = t.slice(whole)
            if whole:
                yield turned(t.slice(0, whole))
        if held is not None:
            yield turned(held)

    values = T.StructType([placed.schema[c] for c in cols])
    schema = T.StructType([*[placed.schema[c] for c in columns], T.StructField(name, values if only is not None else T.ArrayType(values))])
    return placed.select(*columns, "__bucket", "__key").mapInArrow(run, schema)
