"""BPE encoding and decoding with content-defined chunks that documents share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import slices, texts_of
from .tokens import WordEncoder, encoder

#: A chunk ends where the rolling hash of the last WINDOW bytes has CUT zero bits on top: every 2**CUT bytes on average.
WINDOW, CUT = 16, 9
_MULTIPLIER = 0x08088405
_MIX = ((np.arange(256, dtype=np.uint64) + 1) * 2654435761 % (1 << 32)).astype(np.uint32)
#: Chunks in the dictionary for all tasks, and bytes of chunks that a task remembers beyond it.
DICTIONARY, MEMORY = 16_384, 24 << 20


def cuts(text: bytes) -> np.ndarray:
    """Ends of content-defined chunks inside a text; the same bytes give the same ends wherever they stand."""
    if len(text) <= WINDOW:
        return np.zeros(0, dtype=np.int64)
    h, m, p = _MIX[np.frombuffer(text, dtype=np.uint8)], 1, _MULTIPLIER
    while m < WINDOW:   # h covers the last m bytes, the most recent one times 1
        wide = h.copy()
        wide[m:] += h[:-m] * np.uint32(p)
        h, m, p = wide, 2 * m, p * p % (1 << 32)
    at = np.flatnonzero(h[WINDOW - 1:-1] >> np.uint32(32 - CUT) == 0)
    return at + WINDOW


def split(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """Chunk bodies and the joins between them, in turn: body 0, join 0, body 1, ...

    A cut may fall inside a word. Bodies keep the whole words of a chunk; the word that a cut divides is the join. Both
    end at ASCII white space. A text without cuts is one body; a run without white space is never divided.
    """
    ends = cuts(text)
    if not len(ends):
        return [text], []
    raw = np.frombuffer(text, dtype=np.uint8)
    space = np.flatnonzero((raw == 32) | ((raw >= 9) & (raw <= 13)))
    at = np.searchsorted(space, ends)
    first = np.where(at > 0, space[np.maximum(at - 1, 0)] + 1, 0) if len(space) else np.zeros(len(ends), dtype=np.int64)
    last = np.where(at < len(space), space[np.minimum(at, len(space) - 1)], len(text)) if len(space) else np.full(len(ends), len(text))
    bodies, joins, done = [], [], 0
    for a, b in zip(first.tolist(), last.tolist()):
        if a < done:   # the same word as before
            continue
        bodies.append(text[done:a])
        joins.append(text[a:b])
        done = b
    bodies.append(text[done:])
    return bodies, joins


def _digest(body: bytes) -> int:
    n = xxhash.xxh3_64_intdigest(body)
    return n - (1 << 64) if n >> 63 else n


class ChunkEncoder:
    """Encodes texts chunk by chunk; a chunk of the dictionary or met before is not encoded again."""

    def __init__(self, base: WordEncoder, dictionary: dict[bytes, bytes]):
        self.base, self.dictionary = base, dictionary
        self.met: dict[bytes, bytes] = {}
        self.held = 0

    def _bodies(self, bodies: set[bytes]) -> None:
        new = [b for b in bodies if b not in self.dictionary and b not in self.met]
        if self.held > MEMORY:
            self.met.clear()
            self.held, new = 0, [b for b in bodies if b not in self.dictionary]
        for b, ids in zip(new, self.base.encode(new)):
            self.met[b] = ids
            self.held += len(b) + len(ids)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        parts = [split(t) for t in texts]
        self._bodies({b for bodies, _ in parts for b in bodies})
        joins = sorted({j for _, js in parts for j in js})
        repaired = dict(zip(joins, self.base.encode(joins)))
        out = []
        for bodies, js in parts:
            ids = [self.dictionary.get(b) or self.met.get(b, b"") for b in bodies]
            out.append(b"".join([x for k, b in enumerate(ids) for x in ((b, repaired[js[k]]) if k < len(js) else (b,))]))
        wrong = sorted(self._disagreeing(parts))
        for i, ids in zip(wrong, self._library([texts[i] for i in wrong])):   # no agreement: the whole text is one window
            out[i] = ids
        return out

    def _library(self, texts: list[bytes]) -> list[bytes]:
        found = self.base.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _disagreeing(self, parts: list[tuple[list[bytes], list[bytes]]]) -> set[int]:
        """Texts with a join whose neighbourhood, encoded by the library in one piece, differs from its parts."""
        around: dict[bytes, tuple[list[int], list[bytes]]] = {}
        for i, (bodies, joins) in enumerate(parts):
            for k, join in enumerate(joins):
                words = [w for w in (bodies[k][-40:].split()[-1:], [join], bodies[k + 1][:40].split()[:1]) for w in w]
                # a tail of 40 bytes may start inside a word or character; then the join is checked without that side
                words = [w for w in words if w is join or len(w) < 40 and not 0x80 <= w[0] < 0xC0 and _valid(w)]
                around.setdefault(b" ".join(words), ([], words))[0].append(i)
        whole = self._library(list(around))
        flat = [w for _, words in around.values() for w in words]
        ids = iter(self.base.encode(flat))
        return {i for (docs, words), found in zip(around.values(), whole) if b"".join([next(ids) for _ in words]) != found for i in docs}


def _valid(word: bytes) -> bool:
    try:
        word.decode()
    except UnicodeDecodeError:
        return False
    return True


def shared_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(digest, n, bytes, owner) of chunks that occur more than once: occurrences, length and the smallest doc_id.

    Each task adds up its own chunks; every later step is a sum or minimum of numbers before and after the shuffle.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                row, digest, size = [], [], []
                for i, t in enumerate(texts_of(part, 1)):
                    for b in split(t)[0]:
                        if len(b) >= 64:   # shorter ones cost more to look up than to encode
                            row.append(i)
                            digest.append(_digest(b))
                            size.append(len(b))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(digest, pa.int64()), pa.array(size, pa.int64())], names=["owner", "digest", "bytes"])

    frame = docs.select(F.col(doc_id).alias("owner"), F.col(text).cast("string").alias("text"))
    chunks = frame.mapInArrow(run, f"owner {frame.schema['owner'].dataType.simpleString()}, digest long, bytes long")
    return chunks.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes"), F.min("owner").alias("owner")).where("n > 1")


def build_dictionary(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", chunks: int = DICTIONARY) -> dict[bytes, bytes]:
    """Ids of the ``chunks`` chunks whose reuse saves most, encoded once for all tasks.

    At most ``chunks`` rows reach the driver and the tasks. Any other chunk is encoded where it stands.
    """
    spark = docs.sparkSession
    best = shared_chunks(docs, doc_id, text).orderBy(F.desc(F.expr("(n - 1) * bytes")), "digest").limit(chunks).collect()
    if not best:
        return {}
    wanted = spark.sparkContext.broadcast({r["digest"] for r in best})
    owners = spark.createDataFrame([(o,) for o in {r["owner"] for r in best}], f"__owner {docs.schema[doc_id].dataType.simpleString()}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for part in slices(batch, 0, 1 << 20):
                bodies = sorted({b for t in texts_of(part) for b in split(t)[0] if len(b) >= 64 and _digest(b) in wanted.value})
                yield pa.RecordBatch.from_arrays([pa.array(bodies, pa.binary()), pa.array(enc.encode(bodies), pa.binary())], names=["body", "ids"])

    frame = docs.join(F.broadcast(owners), docs[doc_id].eqNullSafe(owners["__owner"]), "left_semi").select(F.col(text).cast("string").alias("text"))
    found = frame.mapInArrow(run, "body binary, ids binary").dropDuplicates(["body"])
    return {bytes(r["body"]): bytes(r["ids"]) for r in found.collect()}


def _real(ids: bytes, base: WordEncoder) -> tuple:
    return np.frombuffer(ids, dtype="<u4").tolist(), base.decode(ids).decode()


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", emit: Callable[[bytes, WordEncoder], tuple] = _real, schema: str = "ids array<long>, decoded string") -> DataFrame:
    """doc_id with what ``emit`` makes of each text's ids (little-endian unsigned 32-bit integers): by default the ids
    and the decoded text, exactly those of the library.

    Null text counts as empty and has no ids. Repeated rows each have a result; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(build_dictionary(docs, path, doc_id, text))
    fields = spark.createDataFrame([], schema).schema
    arrow = to_arrow_schema(fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunked = ChunkEncoder(encoder(path), shared.value)
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                rows = [emit(ids, chunked.base) for ids in chunked.encode(texts_of(part, 1))]
                columns = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", *arrow.names])

    frame = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return frame.mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, {schema}")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text."""
    def emit(ids: bytes, base: WordEncoder) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(base.decode(ids)).hexdigest()

    return encode(docs, path, emit=emit, schema="n_tokens long, ids_sha256 string, decoded_sha256 string")
