"""Best-fit packing of documents into token sequences of a fixed length."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import slices, texts_of
from .tokens import encoder

#: Mean number of pieces that one packing task holds; their number of groups grows with the input.
GROUP = 16_384


def token_pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece of at most ``capacity`` tokens of a document's ids followed by ``end_id``.

    Columns doc_id, piece, start, length, ids_crc32. Only a document of more than ``capacity`` ids has several pieces.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, step = encoder(path), np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                row, piece, length, crc = [], [], [], []
                for i, ids in enumerate(enc.encode(texts_of(part, 1))):
                    ids += end
                    for k in range(0, len(ids), step):
                        cut = ids[k:k + step]
                        row.append(i)
                        piece.append(k // step)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array([p * capacity for p in piece], pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    frame = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return frame.mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, for items that come in decreasing order of length.

    A segment tree over the remaining capacities 0..capacity counts the open bins at each; the leftmost leaf at or right
    of an item's length that has a bin is the tightest fit, found by one climb and one descent.
    """
    size = 1 << capacity.bit_length()
    tree = [0] * (2 * size)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    left: list[int] = []
    bins, offsets = [], []

    def add(c: int, by: int) -> None:
        i = c + size
        while i:
            tree[i] += by
            i >>= 1

    for n in lengths:
        i = n + size
        while i > 1 and not tree[i]:   # climb until a subtree to the right has a bin
            while i & 1:
                i >>= 1
            if i <= 1:
                break
            i += 1
        if i > 1:
            while i < size:
                i = 2 * i if tree[2 * i] else 2 * i + 1
            c = i - size
            b = open_bins[c].pop()
            add(c, -1)
        else:
            c, b = capacity, len(left)
            left.append(capacity)
        bins.append(b)
        offsets.append(capacity - c)
        left[b] = c - n
        if c > n:
            open_bins[c - n].append(b)
            add(c - n, 1)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` of 1 to ``capacity``.

    Pieces are dealt at random, so evenly whatever they hold, to groups of about GROUP, each a fair draw of all lengths,
    and every group is packed by best-fit decreasing; a group leaves about one sequence that is not full. Order inside a
    group is by length, then all other columns. Repeated rows are packed one by one; an empty table stays empty.
    """
    columns = pieces.columns
    pieces = settle(pieces)
    groups = max(1, math.ceil(pieces.count() / GROUP))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), *[(c, "ascending") for c in columns if c != "length"]])
        bins, offsets = best_fit(table["length"].to_pylist(), capacity)
        base = table["__group"][0].as_py() << 32
        return table.drop_columns(["__group"]).append_column("sequence_id", pa.array([base + b for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), *columns), F.lit(groups)))
    return dealt.groupBy("__group").applyInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece; null text counts as empty (one token)."""
    return pack(token_pieces(docs, path, capacity, end_id), capacity)
