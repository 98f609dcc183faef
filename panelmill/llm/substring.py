"""Substring deduplication by hashed sentences and lines: the earliest place of a passage stays in the corpus, the rest go."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import doc_key, maybe_in, nest, slices, unnest, with_text

#: Characters that end a fragment of a text: sentences and lines.
BOUNDARY = ".!?\n"
_SPANS = "array<struct<start: bigint, end: bigint>>"


def fragments(text: str, boundary: str = BOUNDARY) -> list[str]:
    """The whole text in order: each fragment runs to the end of the next run of boundary characters."""
    b = re.escape(boundary)
    return re.findall(f"[^{b}]*[{b}]+|[^{b}]+", text)


def units_of(text: str, boundary: str = BOUNDARY, min_words: int = 8) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(start, end, words before it, words up to its end, normalised text) of each unit, in code points of the text.

    A unit starts at every fragment that has a word and takes in the following ones until it has ``min_words`` words, so
    that units overlap and a passage has the same ones wherever it stands. Normalised: A-Z in lower case, runs of ASCII
    white space as one blank. Fragments that are too few up to the end of the text make no unit.
    """
    at, place, words = 0, [], []
    for f in fragments(text, boundary):
        w = f.encode().lower().split()
        if w:
            place.append((at, at + len(f)))
            words.append(w)
        at += len(f)
    j = before = upto = 0
    for i in range(len(words)):
        while upto - before < min_words and j < len(words):
            upto += len(words[j])
            j += 1
        if upto - before < min_words:
            return
        yield place[i][0], place[j - 1][1], before, upto, b" ".join([x for w in words[i:j] for x in w])
        before += len(words[i])


def unit_digests(docs: DataFrame, doc_id: str, text: str, boundary: str, min_words: int) -> DataFrame:
    """(doc_id, key, start, end, before, upto, h1, h2) of every unit: its span in code points and in words, its 128-bit
    digest h1, h2; ``key`` tells texts of one id apart."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 2 << 20):
                row, spans, digest = [], [], []
                for i, t in enumerate(part.column(2).to_pylist()):
                    for *span, unit in units_of(t or "", boundary, min_words):
                        row.append(i)
                        spans.append(span)
                        digest.append(xxhash.xxh3_128_digest(unit))
                halves = np.frombuffer(b"".join(digest), dtype=">i8").reshape(-1, 2).astype(np.int64)
                places = np.array(spans, dtype=np.int32).reshape(-1, 4)
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(1).take(at), *[pa.array(places[:, k].copy()) for k in range(4)], pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())],
                    names=["doc_id", "key", "start", "end", "before", "upto", "h1", "h2"])

    frame = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_key(F.col(text))).alias("key"), F.col(text).cast("string").alias("text"))
    kind = frame.schema["doc_id"].dataType.simpleString()
    return frame.mapInArrow(run, f"doc_id {kind}, key long, start int, end int, before int, upto int, h1 long, h2 long")


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", boundary: str = BOUNDARY, min_words: int = 8, min_run: int = 30) -> DataFrame:
    """(doc_id, key, runs): for each document with any, the spans (start, end) of its runs of ``min_run`` repeated words.

    Rank is by doc_id (null first), then the text's digest ``key``, then start; rows of equal id and text are one place.
    Units are grouped by digest over all documents: counts and first places are reduced in each task before the shuffle,
    so a line that every document has is one row a task. Only digests that repeat meet the units again, in a join of two
    written tables whose hot keys AQE can split.
    """
    units = settle(unit_digests(docs, doc_id, text, boundary, min_words))
    place = F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "key", "start")
    first = settle(units.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
                   .select("h1", "h2", F.col("first.doc_id").alias("f_doc"), F.col("first.key").alias("f_key"), F.col("first.start").alias("f_start")))
    again = units.join(first, ["h1", "h2"]).where(~(F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("key") == F.col("f_key")) & (F.col("start") == F.col("f_start"))))
    spans = again.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("start", "end", "before", "upto"))).alias("spans"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [runs_of([tuple(s.values()) for s in x.as_py()], min_run) for x in batch.column(2)]
            at = pa.array([i for i, r in enumerate(runs) if r], pa.int64())
            found = pa.array([[{"start": a, "end": b} for a, b in r] for r in runs if r], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), found], names=["doc_id", "key", "runs"])

    return spans.mapInArrow(run, f"doc_id {spans.schema['doc_id'].dataType.simpleString()}, key long, runs {_SPANS}")


def runs_of(spans: Iterable[tuple[int, int, int, int]], min_run: int) -> list[tuple[int, int]]:
    """Spans (start, end, before, upto; ascending) that overlap or touch, joined; those of ``min_run`` words."""
    joined: list[list[int]] = []
    for a, b, before, upto in spans:
        if joined and a <= joined[-1][1]:
            joined[-1][1], joined[-1][3] = max(b, joined[-1][1]), max(upto, joined[-1][3])
        else:
            joined.append([a, b, before, upto])
    return [(a, b) for a, b, before, upto in joined if upto - before >= min_run]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters of ``spans``."""
    out, done = [], 0
    for a, b in spans:
        out.append(text[done:a])
        done = b
    return "".join([*out, text[done:]])


def _cut(docs: DataFrame, doc_id: str, text: str, boundary: str, min_words: int, min_run: int) -> DataFrame:
    """(row, removed): all columns of each row in one struct, its text cut, and the spans that went.

    Texts without a run, which a bit table of fixed size tells, stay where they are; only the others are shuffled.
    """
    found = settle(repeated_runs(docs, doc_id, text, boundary, min_words, min_run).withColumnsRenamed({"doc_id": "id", "key": "of"}))
    keyed = nest(docs, own=F.xxhash64(doc_key(F.col(text)))).withColumn("mark", F.xxhash64(F.col("row")[doc_id], "own"))
    flagged = maybe_in(keyed, "mark", found.select(F.xxhash64("id", "of").alias("mark")))
    some = flagged.where("maybe")
    none = F.expr("array()").cast(_SPANS)
    met = some.join(found, some["row"][doc_id].eqNullSafe(found["id"]) & (F.col("own") == F.col("of")), "left").select("row", F.coalesce("runs", none).alias("removed"))
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 4 << 20, at):
                spans = [[(s["start"], s["end"]) for s in x] for x in part.column(1).to_pylist()]
                cut = [without(t, g) if g else t for t, g in zip(part.column(0).field(at).to_pylist(), spans)]
                yield pa.RecordBatch.from_arrays([with_text(part.column(0), at, cut), part.column(1)], schema=part.schema)

    return met.mapInArrow(run, met.schema).unionByName(flagged.where("not maybe").select("row", none.alias("removed")))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", boundary: str = BOUNDARY, min_words: int = 8, min_run: int = 30) -> DataFrame:
    """All columns of ``docs`` with the text cut, and the column ``removed``: spans (start, end) in the original code points.

    Units of ``min_words`` words or more, from each sentence or line on, are hashed; one that an earlier place in the
    corpus has is repeated. Repeated units that overlap or touch are one run, and a run goes if it has ``min_run`` words:
    shorter ones, which repeat by chance or are a line of boilerplate, stay. A passage inside other sentences loses all but
    the sentences at its ends that it shares with its surroundings. ``boundary`` "\\n" gives lines alone. A document whose
    every unit goes keeps its row with an empty text. Null text stays null; its and an empty text's ``removed`` is empty.
    Runs that repeat inside a document go as well. A column ``removed`` of ``docs`` is replaced, others do not matter.
    """
    done = _cut(docs, doc_id, text, boundary, min_words, min_run)
    return unnest(done, [c for c in docs.columns if c != "removed"], "removed")


def cut_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", boundary: str = BOUNDARY, min_words: int = 8, min_run: int = 30) -> DataFrame:
    """``deduplicate`` with the columns of ``docs`` only, all others than the text as they were."""
    return unnest(_cut(docs, doc_id, text, boundary, min_words, min_run), docs.columns)


ORACLE = r"""
    WITH f AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?\n]+|[^.!?\n]+')) AS frag,
                      generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?\n]+|[^.!?\n]+'), 1) AS idx FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(translate(frag, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS ws FROM f),
    c AS (SELECT doc_id, idx, frag, CAST(len(ws) AS BIGINT) AS n, CAST(sum(len(ws)) OVER before_and_this AS BIGINT) AS c,
                 CAST(sum(length(frag)) OVER before_and_this AS BIGINT) - length(frag) AS start
          FROM w WINDOW before_and_this AS (PARTITION BY doc_id ORDER BY idx)),
    d AS (SELECT doc_id, flatten(list(ws ORDER BY idx)) AS words FROM w GROUP BY doc_id),
    u AS (SELECT doc_id, idx, c, n, min(idx) OVER (PARTITION BY doc_id ORDER BY c RANGE BETWEEN greatest(8 - n, 0) FOLLOWING AND UNBOUNDED FOLLOWING) AS j FROM c),
    h AS (SELECT u.doc_id, u.idx AS i, u.j, array_to_string(d.words[u.c - u.n + 1 : e.c], ' ') AS unit
          FROM u JOIN c AS e ON e.doc_id = u.doc_id AND e.idx = u.j JOIN d ON d.doc_id = u.doc_id WHERE u.n > 0),
    again AS (SELECT doc_id, i, j FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY doc_id, i) AS r FROM h) WHERE r > 1),
    opened AS (SELECT *, i > coalesce(max(j) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) + 1 AS new FROM again),
    grouped AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM opened),
    run AS (SELECT doc_id, min(i) AS i, max(j) AS j FROM grouped GROUP BY doc_id, g),
    gone AS (SELECT run.doc_id, run.i, run.j, a.start AS a, b.start + length(b.frag) AS b
             FROM run JOIN c a ON a.doc_id = run.doc_id AND a.idx = run.i JOIN c b ON b.doc_id = run.doc_id AND b.idx = run.j WHERE b.c - a.c + a.n >= 30),
    spans AS (SELECT doc_id, count(*) AS n_removed, string_agg(CAST(a AS VARCHAR) || ':' || CAST(b AS VARCHAR), ',' ORDER BY a) AS removed FROM gone GROUP BY doc_id),
    kept AS (SELECT c.doc_id, string_agg(c.frag, '' ORDER BY c.idx) AS text FROM c LEFT JOIN gone ON gone.doc_id = c.doc_id AND c.idx BETWEEN gone.i AND gone.j WHERE gone.i IS NULL GROUP BY c.doc_id)
    SELECT doc_id, coalesce(kept.text, '') AS text, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed
    FROM documents LEFT JOIN kept USING (doc_id) LEFT JOIN spans USING (doc_id)"""
