"""Cross-product (Gram) tables: one pass over the rows serves every linear method."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SQL_LIMIT = 8    # vector entries up to which plain SQL sums are used (36 sums keep generated code small enough to compile)


@dataclass
class Gram:
    """Rows ``(by…, i, j, v)`` with i ≤ j; entry 0 is the constant 1.

    Entries are sums of (x − shift) / scale so that large values do not cancel;
    shift and scale have one number per column.
    """

    table: DataFrame
    cols: list[str]
    by: list[str]
    shift: np.ndarray
    scale: np.ndarray

    @property
    def size(self) -> int:
        return len(self.cols) + 1


def complete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def gram(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), engine: str = "auto", center: bool = True) -> Gram:
    """Σ z zᵀ per group, combined on the map side.

    Few columns: SQL sums inside whole-stage codegen. Many: numpy products per
    Arrow batch, one partial matrix per task and group, summed after a shuffle of
    matrices only. A group that holds most rows is reduced where the rows lie.
    """
    cols, by = list(cols), list(by)
    rows = complete(df.select(*dict.fromkeys([*by, *cols])), cols)
    p = len(cols)
    shift, scale = np.zeros(p), np.ones(p)
    if center:
        # one row with two numbers per column comes to the driver
        one = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        if one["m0"] is not None:
            shift = np.array([float(one[f"m{i}"]) for i in range(p)])
            scale = np.array([float(one[f"s{i}"]) or 1.0 for i in range(p)])
    z = [((F.col(c).cast("double") - float(shift[i])) / float(scale[i])).alias(f"z{i + 1}") for i, c in enumerate(cols)]
    zed = rows.select(*by, *z)
    if engine == "sql" or (engine == "auto" and p + 1 <= SQL_LIMIT):
        table = _gram_sql(zed, p, by)
    else:
        table = _gram_arrow(zed, p, by)
    return Gram(table, cols, by, shift, scale)


def _gram_sql(zed: DataFrame, p: int, by: list[str]) -> DataFrame:
    entry = lambda i: F.lit(1.0) if i == 0 else F.col(f"z{i}")
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    sums = zed.groupBy(*by).agg(*[F.sum(entry(i) * entry(j)).alias(f"g{i}_{j}") for i, j in pairs])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"g{i}_{j}").alias("v")) for i, j in pairs])
    return sums.select(*by, F.inline(cells))


def _gram_arrow(zed: DataFrame, p: int, by: list[str]) -> DataFrame:
    zc = [f"z{i + 1}" for i in range(p)]
    iu, ju = np.triu_indices(p + 1)

    def partial(batches):
        acc: dict = {}
        for batch in batches:
            groups = batch.groupby(by, dropna=False, sort=False) if by else [((), batch)]
            for key, g in groups:
                x = np.empty((len(g), p + 1))
                x[:, 0] = 1.0
                x[:, 1:] = g[zc].to_numpy(dtype=float)
                m = x.T @ x
                acc[key] = acc[key] + m if key in acc else m
            if len(acc) > 2000:   # many groups: hand partial sums on, keep memory flat
                yield from emit(acc)
                acc = {}
        yield from emit(acc)

    def emit(acc):
        for key, m in acc.items():
            out = pd.DataFrame({"i": iu.astype("int32"), "j": ju.astype("int32"), "v": m[iu, ju]})
            for at, name in enumerate(by):
                out.insert(at, name, [key[at] if isinstance(key, tuple) else key] * len(out))
            yield out

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in zed.select(*by).schema] if by else []
    parts = zed.mapInPandas(partial, ", ".join([*fields, "i int", "j int", "v double"]))
    return parts.groupBy(*by, "i", "j").agg(F.sum("v").alias("v"))


def windows_of(plan: DataFrame) -> list[tuple[int, int]]:
    """Distinct train windows of a plan (fold-sized, comes to the driver)."""
    rows = plan.select("train_start_ord", "train_end_ord").distinct().collect()
    return sorted((r[0], r[1]) for r in rows)


def segment(windows: Sequence[tuple[int, int]], ord_col: str = "ord") -> Column:
    """Label of the piece of the axis a row falls in; NULL outside all windows."""
    marks = sorted({e for _, e in windows} | {s - 1 for s, _ in windows})
    first = min(s for s, _ in windows)
    out = F.lit(None).cast("bigint")
    for m in reversed(marks):
        out = F.when(F.col(ord_col) <= m, F.lit(m).cast("bigint")).otherwise(out)
    return F.when(F.col(ord_col) >= first, out)


def prefix_gram(df: DataFrame, cols: Sequence[str], windows: Sequence[tuple[int, int]], keys: Sequence[str] = (), engine: str = "auto") -> Gram:
    """Gram of every train window from one scan.

    Windows are unions of consecutive pieces of the axis, so rows are reduced to
    one matrix per piece and only those matrices are added up per window.
    """
    keys = list(keys)
    tagged = df.withColumn("__seg", segment(windows)).where(F.col("__seg").isNotNull())
    g = gram(tagged, cols, [*keys, "__seg"], engine)
    member = F.array(*[F.struct(F.lit(s).cast("bigint").alias("s"), F.lit(e).cast("bigint").alias("e")) for s, e in windows])
    spread = g.table.withColumn("__w", F.explode(F.filter(member, lambda w: (F.col("__seg") >= w["s"]) & (F.col("__seg") <= w["e"]))))
    out = spread.groupBy(*keys, F.col("__w.s").alias("train_start_ord"), F.col("__w.e").alias("train_end_ord"), "i", "j").agg(F.sum("v").alias("v"))
    return Gram(out, g.cols, [*keys, "train_start_ord", "train_end_ord"], g.shift, g.scale)


class Moments:
    """Count, means and centred cross-products in original units (numpy)."""

    def __init__(self, cells: pd.DataFrame, shift: np.ndarray, scale: np.ndarray):
        p = len(shift) + 1
        m = np.zeros((p, p))
        i, j, v = cells["i"].to_numpy(), cells["j"].to_numpy(), cells["v"].to_numpy(dtype=float)
        m[i, j] = v
        m[j, i] = v
        self._finish(m, shift, scale)

    @classmethod
    def of(cls, m: np.ndarray, shift: np.ndarray, scale: np.ndarray) -> Moments:
        self = cls.__new__(cls)
        self._finish(m, shift, scale)
        return self

    def _finish(self, m, shift, scale):
        self.raw = m
        self.n = m[0, 0]
        mean = m[0, 1:] / self.n
        c = m[1:, 1:] - self.n * np.outer(mean, mean)
        c[np.abs(c) < 1e-12 * self.n] = 0.0
        self.mean = shift + scale * mean
        self.cross = c * np.outer(scale, scale)
        self.sd = np.sqrt(np.maximum(np.diag(self.cross), 0.0) / self.n)

    def corr(self) -> np.ndarray:
        d = np.where(self.sd > 0, self.sd, 1.0)
        return self.cross / self.n / np.outer(d, d)


def per_group(g: Gram, fn, schema: str) -> DataFrame:
    """Apply ``fn(key, Moments) -> DataFrame`` to the matrix of every group.

    A group has at most (columns + 1)² cells, whatever the number of rows.
    """
    by, shift, scale = g.by or ["__g"], g.shift, g.scale
    table = g.table if g.by else g.table.withColumn("__g", F.lit("all"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(key, Moments(pdf, shift, scale))

    return table.groupBy(*by).applyInPandas(run, schema)


def moments_local(g: Gram) -> dict[tuple, Moments]:
    """All matrices on the driver: groups × columns² cells (folds × features²)."""
    pdf = g.table.toPandas()
    if not g.by:
        return {(): Moments(pdf, g.shift, g.scale)}
    return {k if isinstance(k, tuple) else (k,): Moments(c, g.shift, g.scale) for k, c in pdf.groupby(g.by, dropna=False)}


def correlation_matrix(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), engine: str = "auto") -> DataFrame:
    """Long Pearson matrix ``(by…, var1, var2, correlation)`` from one scan."""
    g = gram(df, cols, by, engine)
    names, n_by = list(cols), len(by)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema] if by else []

    def fn(key, m: Moments) -> pd.DataFrame:
        r = m.corr()
        flat = m.sd == 0
        r[flat, :] = np.nan
        r[:, flat] = np.nan
        out = pd.DataFrame({"var1": np.repeat(names, len(names)), "var2": names * len(names), "correlation": r.ravel()})
        for at in range(n_by):
            out.insert(at, by[at], key[at])
        return out

    out = per_group(g, fn, ", ".join([*fields, "var1 string", "var2 string", "correlation double"]))
    return out.withColumn("correlation", F.nanvl("correlation", F.lit(None).cast("double")))


def correlation_wide(df: DataFrame, cols: Sequence[str], engine: str = "auto") -> DataFrame:
    long = correlation_matrix(df, cols, engine=engine)
    return long.groupBy("var1").pivot("var2", list(cols)).agg(F.first("correlation"))


def high_correlations(long: DataFrame, threshold: float = 0.7, order: Sequence[str] | None = None) -> DataFrame:
    """Upper-triangle pairs with |r| above the threshold and a strength label."""
    if order:
        rank = F.create_map(*[x for i, c in enumerate(order) for x in (F.lit(c), F.lit(i))])
        upper = rank[F.col("var1")] < rank[F.col("var2")]
    else:
        upper = F.col("var1") < F.col("var2")
    r = F.abs("correlation")
    return long.where(upper & (r > threshold)).withColumn("strength", F.when(r > 0.9, "Very High").otherwise("High"))
