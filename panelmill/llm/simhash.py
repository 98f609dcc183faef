"""SimHash near-duplicates: fingerprints, tiled exact comparison and connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import doc_key, nest, shuffle_partitions, slices, texts_of, unnest

#: Fingerprints in a tile, the unit that is shipped, and in a block, the unit that is compared or skipped.
TILE, BLOCK = 8192, 256
#: Rows of the tables below the documents that a task writes, about.
ROWS = 1 << 16
_WEIGHTS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def written(table: DataFrame, rows: int) -> DataFrame:
    """``settle`` by one task for each ROWS of about ``rows`` rows (two at least), however many shuffle partitions there are.

    Every file costs its executor processes and buffers, so a small table is a few files.
    """
    return settle(table.coalesce(max(2, -(-rows // ROWS))))


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of the text's word shingles, repeats included; 0 without a word."""
    words = text.lower().split()
    if not words:
        return 0
    n, h = max(1, len(words) - width + 1), xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        end = min(n, at + (1 << 16))
        if len(words) <= width:
            hashes = [h(b" ".join(words), seed)]
        elif width == 3:
            hashes = [h(b"%b %b %b" % w, seed) for w in zip(words[at:end], words[at + 1:end + 1], words[at + 2:end + 2])]
        else:
            hashes = [h(b" ".join(words[i:i + width]), seed) for i in range(at, end)]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int((_WEIGHTS[counts * 2 > n]).sum(dtype=np.uint64)) if n else 0


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, key (a digest of the text) and fp, the fingerprint as a signed 64-bit number; null and empty texts have 0."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 8 << 20):
                fp = np.array([fingerprint(t, width, seed) for t in texts_of(part, 2)], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp)], names=["doc_id", "key", "fp"])

    frame = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_key(F.col(text))).alias("key"), F.col(text).cast("string").alias("text"))
    return frame.mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, key long, fp long")


def _quarters(fp: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit quarters."""
    return np.stack([np.bitwise_count((fp >> np.uint64(s)) & np.uint64(0xFFFF)) for s in (48, 32, 16, 0)], axis=1).astype(np.int16)


def tiles(distinct: DataFrame, partitions: int) -> DataFrame:
    """(tile, cells, fps): fingerprints in the order of their halves' population counts, TILE at a time.

    ``cells`` are the pairs of half counts (as 64 * upper + lower) that a tile holds.
    """
    half = [F.bit_count(F.shiftrightunsigned("fp", 32)).alias("hi"), F.bit_count(F.col("fp").bitwiseAND(0xFFFFFFFF)).alias("lo")]
    ranged = distinct.select("fp", *half).repartitionByRange(partitions, "hi", "lo", "fp").sortWithinPartitions("hi", "lo", "fp")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def row(fp: np.ndarray) -> pa.RecordBatch:
            hi, lo = np.bitwise_count(fp >> np.uint64(32)).astype(int), np.bitwise_count(fp & np.uint64(0xFFFFFFFF)).astype(int)
            order = np.lexsort((*_quarters(fp).T[::-1], lo, hi))
            fp = fp[order]
            return pa.RecordBatch.from_arrays([
                pa.array([int(fp[0:1].view(np.int64)[0])], pa.int64()), pa.array([np.unique(hi * 64 + lo).tolist()], pa.list_(pa.int32())),
                pa.array([fp.astype("<u8").tobytes()], pa.binary())], names=["tile", "cells", "fps"])

        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            size += batch.num_rows
            while size >= TILE:
                fp = np.concatenate(held)
                yield row(fp[:TILE])
                held, size = [fp[TILE:]], size - TILE
        if size:
            yield row(np.concatenate(held))

    return ranged.select("fp").mapInArrow(run, "tile long, cells array<int>, fps binary")


def _boxes(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest quarter counts of each block."""
    q, at = _quarters(fp), np.arange(0, len(fp), BLOCK)
    return np.minimum.reduceat(q, at), np.maximum.reduceat(q, at)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest of the links (a, b) that join what all of them join: every node to the smallest of its component."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inverse[:len(a)], inverse[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = np.minimum(new, new[label])
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[moved]], nodes[moved]


def compare(x: np.ndarray, y: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links between two tiles: exclusive-or and bit count of all pairs of blocks whose counts allow one.

    The quarter counts of two fingerprints within ``radius`` bits differ by ``radius`` at most in sum, so a pair of blocks
    whose count ranges lie further apart holds no link and is skipped. Links are thinned to a forest whenever many are held.
    """
    (lx, hx), (ly, hy) = _boxes(x), _boxes(y)
    found_a: list[np.ndarray] = []
    found_b: list[np.ndarray] = []
    held = 0
    for i in range(len(lx)):
        gap = np.maximum(0, np.maximum(lx[i] - hy, ly - hx[i])).sum(1)
        left = x[i * BLOCK:(i + 1) * BLOCK, None]
        for j in np.flatnonzero(gap <= radius):
            if same and j < i:
                continue
            right = y[j * BLOCK:(j + 1) * BLOCK]
            p, q = np.nonzero(np.bitwise_count(left ^ right[None, :]) <= radius)
            if same and i == j:
                p, q = p[p < q], q[p < q]
            if len(p):
                found_a.append(left[p, 0])
                found_b.append(right[q])
                held += len(p)
            if held > 1 << 20:
                a, b = forest(np.concatenate(found_a), np.concatenate(found_b))
                found_a, found_b, held = [a], [b], len(a)
    if not found_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return forest(np.concatenate(found_a), np.concatenate(found_b))


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """(u, v) with u < v: links within ``radius`` bits that join what all such links join, for distinct ``fp``."""
    spark = distinct.sparkSession
    partitions, n = shuffle_partitions(spark), distinct.count()
    held = written(tiles(distinct, partitions), n)
    near = [64 * dh + dl for dh in range(-radius, radius + 1) for dl in range(-radius, radius + 1) if abs(dh) + abs(dl) <= radius]
    own = held.select(F.col("tile").alias("a"), F.explode("cells").alias("cell"))
    other = held.select(F.col("tile").alias("b"), F.explode("cells").alias("c")).select("b", F.explode(F.array(*[F.col("c") + d for d in near])).alias("cell")).distinct()
    pairs = own.join(other, "cell").where("a <= b").select("a", "b").distinct()
    blobs = held.select("tile", "fps")
    work = (pairs.join(blobs.withColumnsRenamed({"tile": "a", "fps": "left"}), "a")
            .join(blobs.withColumnsRenamed({"tile": "b", "fps": "right"}), "b")
            .repartition(partitions, "a", "b"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, left, right in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "left", "right")]):
                u, v = compare(np.frombuffer(left, "<u8"), np.frombuffer(right, "<u8"), radius, a == b)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    found = work.select("a", "b", "left", "right").mapInArrow(run, "u long, v long")
    return written(found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), n)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each component of the links (u < v); only nodes that have a link.

    Alternating rounds of large-star and small-star turn every component into a star around its smallest node. A round
    takes minima for each node, summed up before they are shuffled, and joins them back, where AQE can split hot nodes.
    """
    star = settle(edges.select("u", "v"))
    n, before = star.count(), None
    for _ in range(max_rounds):
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), n)
        # large star: larger neighbours of a node go to its smallest neighbour
        large = written(both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct(), n)
        # small star: smaller neighbours of a node, and itself, go to the smallest
        least = written(large.groupBy("v").agg(F.min("u").alias("m")), n)
        small = large.join(least, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u <> v").distinct()
        star = written(small, n)
        now = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return star.select(F.col("v").alias("node"), F.col("u").alias("root")).union(star.select("u", "u").distinct())
        before = now
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def _grouped(docs: DataFrame, doc_id: str, text: str, width: int, radius: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, fp) of every row, and (fp, low, root): the smallest doc_id of each fingerprint and its component."""
    marked = settle(fingerprints(docs, doc_id, text, width, seed))
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), marked.count())
    roots = components(links(distinct.select("fp"), radius))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    return marked, written(named, distinct.count())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over links of ``radius`` bits).

    Equal fingerprints meet as one node, so a group of copies costs one comparison however large it is; links are kept as
    forests, never as all pairs of a group. Null and empty texts have fingerprint zero and are linked like any other. A
    null doc_id gets the smallest id of its component, null where there is none. Every row has a result, repeated ones too.
    """
    marked, named = _grouped(docs, doc_id, text, width, radius, seed)
    lowest = written(named.groupBy("root").agg(F.min("low").alias("component_id")), named.count())   # written, so the join can split a hot root
    of = named.join(lowest, "root").select(F.col("fp").alias("__fp"), "component_id")
    return marked.join(of, marked["fp"] == of["__fp"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """One row of each group of near-duplicates, all columns as they were: the smallest doc_id (null last), then the smallest
    text digest; of several rows with that id and text the smallest by all columns in their order. An empty table stays
    empty; null and empty texts are one group."""
    marked, named = _grouped(docs, doc_id, text, width, radius, seed)
    of = named.select(F.col("fp").alias("__fp"), "root")
    first = marked.join(of, marked["fp"] == of["__fp"]).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    stay = written(first.select(F.col("first.doc_id").alias("id"), F.col("first.key").alias("stay")), named.count())
    keyed = nest(docs, own=F.xxhash64(doc_key(F.col(text))))
    kept = keyed.join(stay, keyed["row"][doc_id].eqNullSafe(stay["id"]) & (F.col("own") == F.col("stay")), "left_semi")
    return unnest(kept.groupBy(F.col("row")[doc_id].alias("id"), "own").agg(F.min("row").alias("row")), docs.columns)
