"""Hard negatives of anchors by Fagin's threshold algorithm over per-dimension sorted lists."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import shuffle_partitions

#: Rows of a candidate stripe and of an anchor stripe at most; a task holds one of each. A stripe's lists are sorted in runs.
CANDIDATES, ANCHORS, RUN = 65_536, 8_192, 8_192
#: Depths of sorted access as shares of a run; the last round reads the lists to their end.
ROUNDS = (1 / 512, 1 / 128, 1 / 32)
#: Score of a place that no row holds.
_NONE = -np.iinfo(np.int64).max
#: Totals formed by random access, for tests.
COUNTS = {"totals": 0}


def scaled_rows(table: DataFrame, vec_id: str, embedding: str, label: str, scale: float) -> DataFrame:
    """(vec_id, label, v): floor(scale * x) of every component; rows that cannot take part are left out, rows of one id are one."""
    fit = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(embedding).isNotNull() & ~F.exists(
        embedding, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    kept = table.where(fit).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    return kept.groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("r")).select("vec_id", "r.label", "r.v")


class Run:
    """Candidates with their per-dimension lists; rows are ordered by id, so that places break ties."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, kind: type):
        self.ids, self.labels, self.v = ids, labels, v.astype(kind)
        self.up = np.argsort(self.v, axis=0, kind="stable").astype(np.int32)   # ascending lists; read from the end for positive signs
        self.sorted = np.take_along_axis(self.v, self.up, axis=0)
        self.norm = float(np.sqrt((self.v.astype(np.float64) ** 2).sum(1).max(initial=0)))
        n = len(ids)
        self.depths = sorted({min(n, max(1, math.ceil(n * r))) for r in ROUNDS if n * r >= 1} - {n})

    def threshold(self, a: np.ndarray, depth: int) -> np.ndarray:
        """Most that a row can score that no list has shown within ``depth`` entries, for each anchor."""
        return np.where(a > 0, a, 0) @ self.sorted[-depth] + np.where(a < 0, a, 0) @ self.sorted[depth - 1]

    def shown(self, a: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Rows at entries start..stop of every list, read from its top where the anchor is positive, else from its bottom."""
        n = len(self.ids)
        rows = [self.up[n - stop:n - start, a > 0].ravel(), self.up[start:stop, a < 0].ravel()]
        if not (a != 0).any():   # every row scores zero: any list shows all of them
            rows.append(np.arange(start, stop))
        return np.concatenate(rows)


def exact_kind(top: int, width: int) -> type:
    """Narrowest type in which the integer products of ``width`` components up to ``top`` are exact."""
    most = (top + 1) ** 2 * max(1, width)
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


class Tops:
    """The k best (score, id) of every anchor and window, best first; ties by smaller id."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k   # anchors x windows, both ends belong to the window
        self.score = np.full((*low.shape, k), _NONE)
        self.id = np.full((*low.shape, k), np.iinfo(np.int64).max)

    def floor(self) -> np.ndarray:
        """What an unseen row must reach to matter: the kth score, or the window's lower end while rows are missing."""
        kth = self.score[..., -1]
        return np.where(self.low > self.high, np.iinfo(np.int64).max, np.maximum(kth, self.low))

    def add(self, anchors: np.ndarray, scores: np.ndarray, ids: np.ndarray, fit: np.ndarray) -> None:
        """Rows of ``scores`` belong to ``anchors``; ``ids`` ascend; entries outside ``fit`` take no part."""
        k, none = self.k, _NONE
        for w in range(self.low.shape[1]):
            least = np.maximum(self.low[anchors, w], self.score[anchors, w, -1])
            inside = fit & (scores >= least[:, None]) & (scores <= self.high[anchors, w, None])
            some = np.flatnonzero(inside.any(1))
            if not len(some):
                continue
            inside, s = inside[some], scores[some]
            if np.count_nonzero(inside) > 16 * k * len(some):   # rows at or above each anchor's kth score in hand, ties included
                s = np.where(inside, s, none)
                inside &= s >= -np.partition(-s, k - 1, axis=1)[:, k - 1, None]
            row, col = np.nonzero(inside)
            order = np.lexsort((col, -s[row, col], row))   # at most k of each anchor, smaller ids first
            row, col = row[order], col[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, col, place = (x[place < k] for x in (row, col, place))
            new_s, new_i = np.full((len(some), k), none), np.full((len(some), k), np.iinfo(np.int64).max)
            new_s[row, place], new_i[row, place] = s[row, col], ids[col]
            at = anchors[some]
            both_s, both_i = np.concatenate([self.score[at, w], new_s], 1), np.concatenate([self.id[at, w], new_i], 1)
            best = np.lexsort((both_i, -both_s), axis=1)[:, :k]
            self.score[at, w], self.id[at, w] = np.take_along_axis(both_s, best, 1), np.take_along_axis(both_i, best, 1)


def threshold_search(run: Run, a_ids: np.ndarray, a_labels: np.ndarray, a: np.ndarray, tops: Tops, same: bool) -> None:
    """Bring ``tops`` up to date with a run's rows of the anchor's label (``same``), or of other labels.

    Sorted access reads the lists of all dimensions, each from the end that the anchor's sign favours, and random access
    forms the integer total of every row that comes up. An anchor stops once the threshold of the entries reached is
    strictly below the floor of each of its windows: what is unseen then scores less than all that counts, ties too.
    Anchors that the early rounds cannot stop, as no score of the run reaches their threshold, go on to the end at once.
    """
    n, kind = len(run.ids), run.v.dtype.type
    a = a.astype(kind)
    active = np.flatnonzero((tops.low <= tops.high).any(1))
    if n and len(active):   # the heads of the lists bound the whole run
        active = active[~(run.threshold(a[active], 1) < tops.floor().min(1)[active])]
    if not n or not len(active):
        return
    done = np.zeros(len(a), dtype=np.int64)
    seen: dict[int, np.ndarray] = {}
    if run.depths:
        # no floor can be above what the run's scores reach, or the floor of the runs before
        reach = np.maximum(np.sqrt((a.astype(np.float64) ** 2).sum(1)) * run.norm, tops.floor().min(1))
        early = active[run.threshold(a[active], run.depths[-1]) < reach[active]]
        for depth in run.depths:
            for i in early.tolist():
                mask = seen.setdefault(i, np.zeros(n, dtype=bool))
                rows = run.shown(a[i], int(done[i]), depth)
                new = np.unique(rows[~mask[rows]])
                mask[new] = True
                done[i] = depth
                COUNTS["totals"] += len(new)
                if len(new):
                    score = (run.v[new] @ a[i]).astype(np.int64)
                    fit = ((run.labels[new] == a_labels[i]) == same) & (run.ids[new] != a_ids[i])
                    tops.add(np.array([i]), score[None], run.ids[new], fit[None])
            floor = tops.floor().min(1)
            stopped = early[run.threshold(a[early], depth) < floor[early]]
            active = np.setdiff1d(active, stopped)
            early = np.setdiff1d(early, stopped)
    for some in np.array_split(active, max(1, math.ceil(len(active) / 256))):
        if not len(some):
            continue
        score = (a[some] @ run.v.T).astype(np.int64)
        fit = ((run.labels[None] == a_labels[some, None]) == same) & (run.ids[None] != a_ids[some, None])
        for r, i in enumerate(some.tolist()):
            if i in seen:   # had its totals formed before
                fit[r] &= ~seen[i]
        COUNTS["totals"] += fit.size - sum(int(seen[i].sum()) for i in some.tolist() if i in seen)
        tops.add(some, score, run.ids, fit)


def _stripes(rows: DataFrame, count: int, stripes: int, width: int, kind: str, name: str, extra: dict[str, str]) -> DataFrame:
    """(name, ids, labels, data, *extra): rows dealt at random to stripes, ids ascending; extra columns are matrices too."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        blobs = {"ids": table["vec_id"].to_numpy().astype("<i8").tobytes(), "labels": table["label"].to_numpy().astype("<i8").tobytes()}
        for column, size, dtype in [("v", width, kind), *[(c, int(s), "<i8") for c, s in extra.items()]]:
            lists = table[column].combine_chunks()
            lengths, flat = np.asarray(lists.value_lengths()), np.asarray(lists.flatten(), dtype=np.int64)
            data = np.zeros((table.num_rows, size), dtype=dtype)
            data[np.arange(size)[None, :] < lengths[:, None]] = flat   # shorter vectors end in zeros
            blobs["data" if column == "v" else column] = data.tobytes()
        return pa.table({name: pa.array([table[name][0].as_py()], pa.int32()), **{k: pa.array([b], pa.binary()) for k, b in blobs.items()}})

    dealt = rows.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(stripes)).cast("int"))
    return dealt.groupBy(name).applyInArrow(run, f"{name} int, ids binary, labels binary, data binary" + "".join(f", {c} binary" for c in extra))


def _search(candidates: DataFrame, anchors: DataFrame, c_stripes: int, a_stripes: int, width: int, top: int, kind: str, k: int, same: bool, windows: Callable[[dict, int], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(anchor_id, window, vec_id, score): up to k best rows of each anchor, window and candidate stripe.

    Every stripe of anchors meets every stripe of candidates in a task of its own, one copy of each.
    """
    spark = candidates.sparkSession
    exact = exact_kind(top, width)

    def pair(cells: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cells:
            for cell in batch.to_pylist():
                ids, labels = np.frombuffer(cell["ids"], "<i8"), np.frombuffer(cell["labels"], "<i8")
                v = np.frombuffer(cell["data"], kind).reshape(-1, width)
                a_ids, a_labels = np.frombuffer(cell["a_ids"], "<i8"), np.frombuffer(cell["a_labels"], "<i8")
                a = np.frombuffer(cell["a_data"], kind).reshape(-1, width)
                tops = Tops(*windows(cell, len(a_ids)), k)
                for at in range(0, len(ids), RUN):
                    threshold_search(Run(ids[at:at + RUN], labels[at:at + RUN], v[at:at + RUN], exact), a_ids, a_labels, a, tops, same)
                row, window, place = np.nonzero(tops.score > _NONE)
                yield pa.RecordBatch.from_arrays([pa.array(a_ids[row]), pa.array(window, pa.int64()), pa.array(tops.id[row, window, place]), pa.array(tops.score[row, window, place])], names=["anchor_id", "window", "vec_id", "score"])

    left = candidates.withColumn("as", F.explode(F.sequence(F.lit(0), F.lit(a_stripes - 1))))
    right = anchors.select(F.col("as"), *[F.col(c).alias(c if c in ("low", "high") else f"a_{c}") for c in anchors.columns if c != "as"])
    met = left.join(right, "as").repartition(max(1, min(c_stripes * a_stripes, shuffle_partitions(spark) * 4)), "as", "cs").drop("as", "cs")
    return met.mapInArrow(pair, "anchor_id long, window long, vec_id long, score long")


def mine(table: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id ``every`` divides; a score is the integer inner product of floor(scale * x). An anchor's
    positives are its ``positives`` best other rows of its label; for each, the ``negatives`` best rows of other labels
    whose score lies between ``low`` and ``high`` percent of the positive's. Ties go to the smaller id; fewer are all.
    Rows with a null id, label, vector or component, or one that is not finite, take no part; rows of one id count as one
    (the smallest vector, then label); a shorter vector ends in zeros; an empty table, or one without anchors, has no row.

    Candidates and anchors lie in stripes of bounded size. Both searches run the threshold algorithm in every pair of
    stripes, carry the best rows from run to run of a stripe, and a window over what the stripes return ranks them.
    """
    spark = table.sparkSession
    rows = settle(scaled_rows(table, vec_id, embedding, label, scale))
    asked = F.col("vec_id") % every == 0
    n, width, top, asking = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.greatest(F.abs(F.coalesce(F.array_max("v"), F.lit(0))), F.abs(F.coalesce(F.array_min("v"), F.lit(0))))), F.count_if(asked)).first()
    if not asking:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width, kind = max(1, width), "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    c_stripes = max(math.ceil(n / CANDIDATES), min(shuffle_partitions(spark), math.ceil(n / RUN)))
    a_stripes = math.ceil(asking / ANCHORS)
    candidates = settle(_stripes(rows, n, c_stripes, width, kind, "cs", {}))
    shape = (c_stripes, a_stripes, width, top, kind)
    least, most = _NONE + 1, np.iinfo(np.int64).max

    def everything(cell: dict, size: int) -> tuple[np.ndarray, np.ndarray]:
        return np.full((size, 1), least), np.full((size, 1), most)

    def between(cell: dict, size: int) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(cell["low"], "<i8").reshape(size, -1), np.frombuffer(cell["high"], "<i8").reshape(size, -1)

    by_anchor = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    first = _search(candidates, _stripes(rows.where(asked), asking, a_stripes, width, kind, "as", {}), *shape, positives, True, everything)
    best = settle(first.withColumn("place", F.row_number().over(by_anchor)).where(F.col("place") <= positives)
                  .select("anchor_id", F.col("place").cast("long").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # low * p <= 100 * s <= high * p, as whole numbers; a place without a positive has an empty window
    bounds = best.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "positive_score"))).alias("p"))
    # by hundreds, as a long score times a percentage may be no long
    ends = [F.array(*[F.coalesce(F.expr(f"(p[{i}L] - pmod(p[{i}L], 100)) div 100 * {percent} + cast({rounded}(pmod(p[{i}L], 100) * {percent} / 100) as long)"), F.lit(empty).cast("long"))
                      for i in range(1, positives + 1)]) for percent, rounded, empty in ((low, "ceil", 1), (high, "floor", 0))]
    asking_rows = rows.where(asked).join(bounds, rows["vec_id"] == bounds["anchor_id"]).select("vec_id", "label", "v", ends[0].alias("low"), ends[1].alias("high"))
    second = _search(candidates, _stripes(asking_rows, asking, a_stripes, width, kind, "as", {"low": str(positives), "high": str(positives)}), *shape, negatives, False, between)
    ranked = second.withColumn("rank", F.row_number().over(by_anchor)).where(F.col("rank") <= negatives)
    return ranked.withColumn("place", F.col("window") + 1).join(best, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def relabelled(table: DataFrame, divisor: int = 7, labels: int = 10) -> DataFrame:
    """The table with (label + 1) % ``labels`` where ``divisor`` divides vec_id: planted false labels."""
    return table.withColumn("label", F.when(F.col("vec_id") % divisor == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))


ORACLE = """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
               FROM embeddings
               WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
          FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score
          FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
    n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
                 row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
          FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
