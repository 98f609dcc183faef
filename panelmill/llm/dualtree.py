"""Ranked lexical search of documents for items by a dual-tree search with exact bounds."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import slices, texts_of

#: Distinct (item, term) pairs that one round of items may hold: bounds what is broadcast and the width of a batch.
ROUND = 65_536
#: Rows of a leaf and children of a node, in both hierarchies; bytes of a batch of documents as a matrix.
LEAF, FAN, BATCH = 8, 8, 32 << 20
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Leaf pairs whose scores were formed, and all leaf pairs, for tests.
COUNTS = {"formed": 0, "pairs": 0}


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of characters beyond ASCII; only A-Z are lower-cased."""
    return text.translate(_TERM).split()


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, item_id, terms, counts): one row for each distinct id and text with a term; ``item`` is a digest of both."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 4 << 20):
                found = [np.unique(np.array(terms_of(t), dtype=object), return_counts=True) for t in texts_of(part, 2)]
                terms = pa.array([t.tolist() for t, _ in found], pa.list_(pa.binary()))
                counts = pa.array([c.tolist() for _, c in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), terms, counts], names=["item", "item_id", "terms", "counts"])

    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text")).distinct()
    rows = rows.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text")
    return rows.mapInArrow(run, f"item long, item_id {rows.schema['item_id'].dataType.simpleString()}, terms array<binary>, counts array<long>").where(F.size("terms") > 0)


def document_vectors(docs: DataFrame, vocabulary: list[bytes], doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, terms, tfs): number of terms of every document that has one, and its terms of the vocabulary as
    little-endian 32-bit places and occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(shared.value)}
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                row, n, terms, tfs = [], [], [], []
                for i, t in enumerate(texts_of(part, 1)):
                    words = terms_of(t)
                    if words:
                        at, tf = np.unique(np.fromiter((x for x in map(place.get, words) if x is not None), dtype="<i4"), return_counts=True)
                        row.append(i)
                        n.append(len(words))
                        terms.append(at.astype("<i4").tobytes())
                        tfs.append(tf.astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms binary, tfs binary")


def document_frequencies(vectors: DataFrame, width: int) -> tuple[int, int, np.ndarray]:
    """N, L and df of every vocabulary term; each task adds up its documents before the shuffle."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df = np.zeros(2, dtype=np.int64), np.zeros(width, dtype=np.int64)
        for batch in batches:
            total += batch.num_rows, sum(batch.column(0).to_pylist())
            df += np.bincount(np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4"), minlength=width)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *at.tolist()], pa.int64()), pa.array([*total.tolist(), *df[at].tolist()], pa.int64())], names=["term", "df"])

    got = vectors.select("n", "terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(width + 2, dtype=np.int64)
    df[got["term"].to_numpy()] = got["df"].to_numpy()   # -2 and -1 are the last two
    return int(df[-2]), int(df[-1]), df[:-2]


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


def impacts(n: np.ndarray, tf: np.ndarray, n_docs: int, length: int, b: int = 75) -> np.ndarray:
    """What an occurrence count adds for each unit of weight: (10^9 tf) div (1000 tf + 8 m), m by the document's length."""
    m = 100 - b + (b * n * n_docs) // length
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Tree:
    """A hierarchy over the rows of a matrix of coordinates >= 0: each node holds the maxima of what is below it.

    Rows are brought together by their largest coordinates first, so that a leaf's rows share what they score by.
    ``levels[0]`` are the leaves of LEAF rows; FAN nodes of a level make one of the next, up to a single root.
    """

    def __init__(self, rows: np.ndarray):
        top = np.argsort(-rows, axis=1, kind="stable")[:, :3] if rows.shape[1] > 3 else np.zeros((len(rows), 1), dtype=np.int64)
        self.order = np.lexsort(top.T[::-1])
        self.rows = rows[self.order]
        self.levels = [self._maxima(self.rows, LEAF)]
        while len(self.levels[-1]) > 1:
            self.levels.append(self._maxima(self.levels[-1], FAN))

    @staticmethod
    def _maxima(rows: np.ndarray, size: int) -> np.ndarray:
        return np.maximum.reduceat(rows, np.arange(0, len(rows), size), axis=0)

    def children(self, level: int, node: np.ndarray) -> np.ndarray:
        """First and past-the-last child of each node, on the level below (-1: rows)."""
        size, most = (LEAF, len(self.rows)) if level == 0 else (FAN, len(self.levels[level - 1]))
        return np.stack([node * size, np.minimum(most, (node + 1) * size)])


class Best:
    """The k best (score, document) of every item; equal scores by ascending id."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score = np.zeros((items, k), dtype=np.int64)   # 0: none yet
        self.id = np.full((items, k), np.iinfo(np.int64).max)

    def add(self, items: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` (items x documents) of documents ``ids`` that were not added before."""
        hit = (scores > 0) & (scores >= self.score[items, -1:])
        some = np.flatnonzero(hit.any(1))
        if len(some):
            at = items[some]
            s = np.concatenate([self.score[at], np.where(hit[some], scores[some], 0)], axis=1)
            i = np.concatenate([self.id[at], np.broadcast_to(ids, (len(some), len(ids)))], axis=1)
            i = np.where(s > 0, i, np.iinfo(np.int64).max)
            best = np.lexsort((i, -s), axis=1)[:, :self.k]
            self.score[at], self.id[at] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)


def search(items: Tree, docs: Tree, ids: np.ndarray, best: Best) -> None:
    """Bring ``best`` (rows in the order of the items' tree) up to date with the documents of a tree.

    Pairs of nodes are visited from the roots down. The product of two nodes' maxima bounds every score below them; the
    pair goes, with the whole batch under it, if that is 0 or strictly below the weakest kth score of the node's items, so
    ties survive. Leaf pairs come in descending order of their bounds, and are tested again before their scores are formed.
    """
    for i in range(len(items.levels) - 1, -1, -1):
        if i == len(items.levels) - 1:
            d = len(docs.levels) - 1
            a, b = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        else:
            a, b = _down(items, i + 1, a, b)
        while True:   # the deeper tree goes down first, until both are level
            weakest = _weakest(best, items, i)
            bound = _bounds(items.levels[i], docs.levels[d], a, b)
            keep = (bound > 0) & (bound >= weakest[a])
            a, b, bound = a[keep], b[keep], bound[keep]
            if d <= i and (i > 0 or d == 0):
                break
            b, a = _down(docs, d, b, a)
            d -= 1
    leaves = len(items.levels[0]) * len(docs.levels[0])
    COUNTS["pairs"] += leaves
    order = np.argsort(-bound, kind="stable")
    a, b, bound = a[order], b[order], bound[order]
    for at in np.unique(a, return_index=True)[1].argsort(kind="stable").tolist():   # each item leaf, the best bound first
        leaf = np.unique(a)[at]
        mine = np.flatnonzero(a == leaf)
        lo, hi = items.children(0, np.array([leaf]))[:, 0]
        rows = np.arange(lo, hi)
        step, done = 4, 0
        while done < len(mine):   # growing batches of document leaves; what has fallen below the weakest kth score goes
            some = mine[done:done + step]
            some = some[bound[some] >= best.score[rows, -1].min()]
            done, step = done + step, step * 2
            if not len(some):
                break   # bounds descend
            first, last = docs.children(0, b[some])
            at_docs = np.concatenate([np.arange(x, y) for x, y in zip(first.tolist(), last.tolist())])
            COUNTS["formed"] += len(some)
            best.add(rows, (items.rows[rows] @ docs.rows[at_docs].T).astype(np.int64), ids[docs.order[at_docs]])


def _down(tree: Tree, level: int, node: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the nodes' children with the same partners."""
    first, last = tree.children(level, node)
    size = last - first
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum()), np.repeat(other, size)


def _weakest(best: Best, items: Tree, level: int) -> np.ndarray:
    """Smallest kth score of the items below each node of a level."""
    kth = np.minimum.reduceat(best.score[:, -1], np.arange(0, len(items.rows), LEAF))
    for _ in range(level):
        kth = np.minimum.reduceat(kth, np.arange(0, len(kth), FAN))
    return kth


def _bounds(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the nodes' maxima for pairs (a, b)."""
    if not len(a):
        return np.zeros(0)
    rows, cols = np.unique(a), np.unique(b)
    return (left[rows] @ right[cols].T)[np.searchsorted(rows, a), np.searchsorted(cols, b)]


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 for each item, equal scores by ascending id.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, only A-Z lower-cased. The score of a
    document sums weight times impact over the item's terms, repeats included, in whole numbers: weight
    floor(1000 ln((2N+2)/(2df+1))), impact (10^9 tf) div (1000 tf + 8 m), m = 25 + (75 n N) div L. Null text has no
    terms. A row of documents is a document, so repeated rows rank one after the other; a null id comes last among equal
    scores. Equal rows of items are one item; rows of one id with other texts are ranked each by itself. An empty table
    gives an empty result.

    Documents become sparse vectors over the items' terms, written once. Every task holds the hierarchy of the items, makes
    hierarchies of its documents batch by batch, and keeps the k best of each item from batch to batch; a window ranks what
    the tasks return. Items come in rounds of at most about ROUND terms, so what is broadcast is bounded.
    """
    spark = docs.sparkSession
    schema = f"item_id {items.schema[item_id].dataType.simpleString()}, rank int, doc_id {docs.schema[doc_id].dataType.simpleString()}, score long"
    asked = settle(item_terms(items, item_id, item_text))
    total = asked.agg(F.sum(F.size("terms"))).first()[0]
    if not total:
        return spark.createDataFrame([], schema)
    rounds = math.ceil(total / ROUND)
    found = None
    for r in range(rounds):
        some = asked.where(F.pmod(F.xxhash64("item", F.lit(7)), F.lit(rounds)) == r).orderBy("item").toArrow()
        if some.num_rows:
            part = _round(docs, some, k, doc_id, text)
            found = part if found is None else found.unionByName(part)
    names = asked.select(F.col("item").alias("of"), "item_id").distinct()
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
    return ranked.join(names, ranked["item"] == names["of"]).select("item_id", F.col("rank").cast("int").alias("rank"), F.col("doc_id").cast(docs.schema[doc_id].dataType).alias("doc_id"), "score")


def _round(docs: DataFrame, some: pa.Table, k: int, doc_id: str, text: str) -> DataFrame:
    """(item, doc_id, score): each task's k best documents of every item of a round."""
    spark = docs.sparkSession
    vocabulary = sorted({t for ts in some["terms"].to_pylist() for t in ts})
    place = {t: i for i, t in enumerate(vocabulary)}
    vectors = settle(document_vectors(docs, vocabulary, doc_id, text))
    n_docs, length, df = document_frequencies(vectors, len(vocabulary))
    w = weights(n_docs, df)
    sizes = [len(ts) for ts in some["terms"].to_pylist()]
    row = np.repeat(np.arange(some.num_rows), sizes)
    column = np.array([place[t] for ts in some["terms"].to_pylist() for t in ts])
    value = np.array([c for cs in some["counts"].to_pylist() for c in cs], dtype=np.int64) * w[column]
    per_item = np.bincount(row, value, some.num_rows).max(initial=0)
    if per_item * 1_000_000 >= 1 << 53:   # an impact is below 10^6
        raise ValueError("an item is too long for exact scores")
    shared = spark.sparkContext.broadcast((some["item"].to_numpy(), row, column, value, len(vocabulary)))
    last = np.iinfo(np.int64).max - 1   # a null id comes last

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, row, column, value, width = shared.value
        matrix = np.zeros((len(item), width))
        matrix[row, column] = value
        tree = Tree(matrix)
        best = Best(len(item), k)
        step = max(16, BATCH // (8 * width))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                terms, tfs = ([np.frombuffer(x, "<i4") for x in part.column(c).to_pylist()] for c in (2, 3))
                own = np.repeat(np.arange(part.num_rows), [len(t) for t in terms])
                tf, n = np.concatenate(tfs).astype(np.int64), part.column(1).to_numpy()
                dense = np.zeros((part.num_rows, width))
                dense[own, np.concatenate(terms)] = impacts(n[own], tf, n_docs, length)
                ids = part.column(0).fill_null(last).to_numpy()
                search(tree, Tree(dense), ids, best)
        r, c = np.nonzero(best.score)
        found = best.id[r, c]
        yield pa.RecordBatch.from_arrays([pa.array(item[tree.order[r]]), pa.array(found, pa.int64(), mask=found == last), pa.array(best.score[r, c])], names=["item", "doc_id", "score"])

    return vectors.mapInArrow(run, "item long, doc_id long, score long")


ORACLE = r"""
    WITH t AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    d AS (SELECT row, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM t WHERE len(terms) > 0),
    c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS length FROM d),
    q AS (SELECT item_id, text, term, CAST(count(*) AS BIGINT) AS repeats
          FROM (SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
    p AS (SELECT row, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, n_docs),
    s AS (SELECT q.item_id, q.text, p.row, p.doc_id,
                 CAST(sum(q.repeats * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * p.n * c.n_docs) // c.length)))) AS BIGINT) AS score
          FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY ALL)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST, row) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""
