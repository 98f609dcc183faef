"""Exact top-k inner products by a three-phase uniform threshold."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import shuffle_partitions

#: Rows in a block of candidates and of queries at most; a task holds one of each, and compares runs of them.
CANDIDATES, QUERIES, RUN_C, RUN_Q = 65_536, 8_192, 4_096, 1_024
#: Totals that the last phase resolved, and pairs that it was shown, for tests.
COUNTS = {"totals": 0, "pairs": 0}


def integer_vectors(table: DataFrame, vec_id: str, embedding: str, scale: float) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, x as double; rows that cannot take part are left out."""
    fit = F.col(embedding).isNotNull() & F.col(vec_id).isNotNull() & ~F.exists(
        embedding, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = table.where(fit).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _blocks(rows: DataFrame, blocks: int, width: int, kind: str, name: str) -> DataFrame:
    """(name, ids, data): rows dealt at random to ``blocks``, ids ascending, vectors of ``width`` components of type ``kind``."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        ids = table["vec_id"].to_numpy()
        lists = table["v"].combine_chunks()
        lengths, flat = np.asarray(lists.value_lengths()), np.asarray(lists.flatten(), dtype=np.int64)
        data = np.zeros((len(ids), width), dtype=kind)
        data[np.arange(width)[None, :] < lengths[:, None]] = flat   # shorter vectors end in zeros
        return pa.table({name: pa.array([table[name][0].as_py()], pa.int32()), "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "data": pa.array([data.tobytes()], pa.binary())})

    dealt = rows.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy(name).applyInArrow(run, f"{name} int, ids binary, data binary")


def _exact(q: np.ndarray, v: np.ndarray) -> type:
    """The float type in which the inner products are exact."""
    top = (int(np.abs(q.astype(np.int64)).max(initial=0)) + 1) * (int(np.abs(v.astype(np.int64)).max(initial=0)) + 1) * max(1, q.shape[1])
    if top >= 1 << 53:
        raise ValueError("components are too large for exact scores")
    return np.float32 if top < 1 << 24 else np.float64


def _lists(q: np.ndarray, v: np.ndarray, lists: int) -> Iterator[np.ndarray]:
    """Local scores: the inner products over each of ``lists`` runs of components, exact in the float type chosen."""
    kind = _exact(q, v)
    for part in np.array_split(np.arange(q.shape[1]), lists):
        yield q[:, part].astype(kind) @ v[:, part].astype(kind).T


def _own(ids: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the queries' own rows among a block of candidates."""
    at = np.minimum(np.searchsorted(others, ids), max(0, len(others) - 1))
    mine = np.flatnonzero(others[at] == ids) if len(others) else np.zeros(0, dtype=np.int64)
    return mine, at[mine]


def local_lists(qi: np.ndarray, q: np.ndarray, vi: np.ndarray, v: np.ndarray, k: int, lists: int) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1: (query, score) of up to k good candidates of each query: the best of what heads some local list."""
    mine, at = _own(qi, vi)
    total, heads = None, []
    for s in _lists(q, v, lists):
        total = s.copy() if total is None else total + s
        s[mine, at] = -np.inf
        heads.append(np.argpartition(-s, k - 1, axis=1)[:, :k] if s.shape[1] > k else np.tile(np.arange(s.shape[1]), (len(qi), 1)))
    total[mine, at] = -np.inf
    seen = np.sort(np.concatenate(heads, axis=1), axis=1)
    score = np.take_along_axis(total, seen, axis=1)
    score[:, 1:][seen[:, 1:] == seen[:, :-1]] = -np.inf   # heads several lists
    best = -np.sort(-score, axis=1)[:, :k]
    row, col = np.nonzero(np.isfinite(best))
    return qi[row], best[row, col].astype(np.int64)


def above(qi: np.ndarray, q: np.ndarray, cut: np.ndarray, vi: np.ndarray, v: np.ndarray, k: int, lists: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3: (query, candidate, score) of each query's k best candidates that reach its cutoff.

    A total of at least the cutoff needs some local score of at least cutoff / lists. And it needs, after each list, the sum
    so far plus what the lists to come can add: at most the product of the norms of the components left. Queries that a run
    cannot reach at all are left out before any product, entries as soon as a list rules them out; totals are formed of the
    rest.
    """
    left_q, left_v = _norms(q, lists), _norms(v, lists)
    COUNTS["pairs"] += len(qi) * len(vi)
    slack = 1 + 1e-5
    some = np.flatnonzero(left_q[0] * left_v[0].max(initial=0) * slack + 1 >= cut)
    if not len(some) or not len(vi):
        return qi[:0], vi[:0], np.zeros(0, dtype=np.int64)
    qi, q, cut, left_q = qi[some], q[some], cut[some], left_q[:, some]
    share = cut / lists
    parts = np.array_split(np.arange(q.shape[1]), lists)
    kind = _exact(q, v)
    q, v = q.astype(kind), v.astype(kind)
    mine, at = _own(qi, vi)
    dense = np.zeros((len(qi), len(vi)), dtype=kind)
    reach = np.zeros(dense.shape, dtype=bool)
    sparse = None
    for n, part in enumerate(parts):
        if sparse is None:   # many are left: one product of the list is cheaper than reading entries one by one
            s = q[:, part] @ v[:, part].T
            reach |= s >= share[:, None]
            dense += s
            rest = (left_q[n + 1] * slack).astype(np.float32)[:, None] * left_v[n + 1].astype(np.float32)[None] if n + 1 < lists else 0.0
            alive = dense + rest >= cut[:, None] - (n + 1 < lists)
            alive[mine, at] = False
            if n + 1 < lists and np.count_nonzero(alive) * 64 > dense.size:
                continue
            COUNTS["totals"] += dense.size if n + 1 == lists else 0
            row, col = sparse = np.nonzero(alive)
            total, seen = dense[row, col].astype(np.float64), reach[row, col]
            continue
        a, b = np.ascontiguousarray(q[:, part]), np.ascontiguousarray(v[:, part])
        s = np.concatenate([np.einsum("ij,ij->i", a[row[i:i + 100_000]], b[col[i:i + 100_000]]) for i in range(0, len(row), 100_000)] or [np.zeros(0)]).astype(np.float64)
        total += s
        seen |= s >= share[row]
        keep = total + left_q[n + 1][row] * left_v[n + 1][col] * slack + (n + 1 < lists) >= cut[row]
        row, col, total, seen = row[keep], col[keep], total[keep], seen[keep]
        COUNTS["totals"] += len(row) if n + 1 == lists else 0
    hit = seen & (total >= cut[row])
    row, col, score = row[hit], col[hit], total[hit].astype(np.int64)
    order = np.lexsort((vi[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    top = np.arange(len(row)) - np.searchsorted(row, row) < k
    return qi[row[top]], vi[col[top]], score[top]


def _norms(x: np.ndarray, lists: int) -> np.ndarray:
    """Norm of the components that are left before each list, and after the last: lists + 1 by rows."""
    squares = [(x[:, part].astype(np.float64) ** 2).sum(1) for part in np.array_split(np.arange(x.shape[1]), lists)]
    return np.sqrt(np.cumsum([np.zeros(len(x)), *squares[::-1]], axis=0)[::-1])


def top_k(table: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 64.0, lists: int = 4) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with every other row.

    Queries are the rows whose id ``every`` divides. A vector's components are floor(scale * x). Ties go to the smaller
    id; fewer than k candidates give all. Vectors that are null or hold null or non-finite components, and null ids, take
    no part; rows of one id count as one (the smallest vector); a shorter vector ends in zeros; an empty table has no row.

    Vectors lie in blocks, and each run of components is a list with local scores. Phase 1 gathers from every block the
    exact scores of what heads its lists; the k-th best over all blocks is a safe cutoff. It goes back to the blocks with
    the queries. Phase 2 takes entries that reach cutoff / lists on some list and that no list rules out, phase 3 resolves
    their totals, and a window ranks what reaches the cutoff, at most k from a run.
    """
    spark = table.sparkSession
    rows = settle(integer_vectors(table, vec_id, embedding, scale))
    asked = rows.where(F.col("vec_id") % every == 0)
    size = F.greatest(F.abs(F.coalesce(F.array_max("v"), F.lit(0))), F.abs(F.coalesce(F.array_min("v"), F.lit(0))))
    n, width, nq, most = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.count_if(F.col("vec_id") % every == 0), F.max(size)).first()
    if not nq:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, kind = max(1, width), "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    count = max(math.ceil(n / CANDIDATES), min(shuffle_partitions(spark), math.ceil(n / RUN_C)))
    blocks = math.ceil(nq / QUERIES)
    candidates = settle(_blocks(rows, count, width, kind, "cb"))
    queries = settle(_blocks(asked, blocks, width, kind, "qb"))

    def pairs(asking: DataFrame) -> DataFrame:
        """One copy of a block of either kind for each pair; blocks grow up to their limits before their number does."""
        dealt = candidates.withColumnsRenamed({"ids": "vi", "data": "v"}).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return dealt.join(asking, "qb").repartition(max(1, min(count * blocks, 4 * shuffle_partitions(spark))), "qb", "cb")

    def runs(ids: bytes, data: bytes, vi: bytes, v: bytes) -> Iterator[tuple]:
        i, x, j, y = np.frombuffer(ids, "<i8"), np.frombuffer(data, kind).reshape(-1, width), np.frombuffer(vi, "<i8"), np.frombuffer(v, kind).reshape(-1, width)
        for a in range(0, len(i), RUN_Q):
            for b in range(0, len(j), RUN_C):
                yield i[a:a + RUN_Q], x[a:a + RUN_Q], j[b:b + RUN_C], y[b:b + RUN_C]

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in zip(*[c.to_pylist() for c in batch.columns]):
                for run in runs(*cell):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in local_lists(*run, k, lists)], names=["query_id", "score"])

    def second(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *cell, known in zip(*[c.to_pylist() for c in batch.columns]):
                cutoff = {x["query_id"]: x["cutoff"] for x in known or ()}
                for qi, q, vi, v in runs(*cell):
                    cut = np.array([cutoff.get(x, -np.inf) for x in qi.tolist()])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in above(qi, q, cut, vi, v, k, lists)], names=["query_id", "vec_id", "score"])

    ranked = Window.partitionBy("query_id")
    gathered = pairs(queries).select("ids", "data", "vi", "v").mapInArrow(first, "query_id long, score long")
    best = gathered.withColumn("r", F.row_number().over(ranked.orderBy(F.desc("score")))).where(F.col("r") <= k)
    cutoffs = best.groupBy("query_id").agg(F.min("score").alias("cutoff"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
    packed = settle(cutoffs.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("qb")).agg(F.collect_list(F.struct("query_id", "cutoff")).alias("known")))
    entries = pairs(queries.join(packed, "qb", "left")).select("ids", "data", "vi", "v", "known").mapInArrow(second, "query_id long, vec_id long, score long")
    final = entries.withColumn("rank", F.row_number().over(ranked.orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return final.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
