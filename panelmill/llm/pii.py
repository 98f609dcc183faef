"""Personal data: base patterns, and neighbouring terms that disclose what they stand for."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import doc_key, maybe_in, nest, slices, unnest, with_text

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)++")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")
#: Words on either side of an entity that may disclose it, and the code points in which they are sought.
WINDOW, REACH = 4, 80
#: Slots of the bit table that tells the corpus count which terms matter.
SLOTS = 1 << 22

Span = tuple[int, int, int]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the email pattern. Each has the next ``@`` that local characters lead up to, so one step an ``@``."""
    done, at = 0, text.find("@")
    while at >= 0:
        run = text[done:at]
        start = at - (len(run) - len(run.rstrip(_LOCAL)))
        done = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", done)


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of four dotted numbers, those with a part over 255 dropped without another try."""
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - len(parts) % 4, 4):
            four = parts[k:k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _DIGITS.finditer(text):
        if 14 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield m.span()


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of all base matches by start, then kind."""
    found = [(a, b, k) for k, find in enumerate((emails, ips, cards, phones)) for a, b in find(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def spans_text(spans: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def entity_of(text: str, span: Span) -> int:
    """Digest of the person or thing that a base span names: kind and value, without case or separators."""
    a, b, k = span
    value = text[a:b].lower() if k < 2 else "".join(c for c in text[a:b] if c.isdigit())
    return _signed(xxhash.xxh64_intdigest(f"{KINDS[k]}:{value}"))


def neighbours(text: str, spans: list[Span]) -> list[dict]:
    """Terms near each base span: entity and context digests, the term, its slot, start and end."""
    out = {}
    for a, b, k in spans:
        entity = entity_of(text, (a, b, k))
        low, high = max(0, a - REACH), min(len(text), b + REACH)
        words = []
        for m in _WORD.finditer(text, low, high):
            cut = m.start() == low > 0 and text[low - 1].isalpha() or m.end() == high < len(text) and text[high].isalpha()
            if not cut and not any(m.start() < y and x < m.end() for x, y, _ in spans if x < high and low < y):
                words.append((m.start(), m.end(), m[0].lower()))
        words = [w for w in words if w[1] <= a][-WINDOW:] + [w for w in words if w[0] >= b][:WINDOW]
        context = _signed(xxhash.xxh64_intdigest(" ".join(w[2] for w in words)))
        for x, y, term in words:
            out[entity, x] = {"entity": entity, "context": context, "term": term, "slot": zlib.crc32(term.encode()) % SLOTS, "start": x, "end": y}
    return list(out.values())


def scan(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, key, n_email, n_ip, n_card, n_phone, base_sha256, base, entities, near) of every row; ``key`` is a digest of the text."""
    near = pa.list_(pa.struct([("entity", pa.int64()), ("context", pa.int64()), ("term", pa.string()), ("slot", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    base = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 4 << 20):
                texts = [t or "" for t in part.column(2).to_pylist()]
                found = [base_spans(t) for t in texts]
                counts = [pa.array([sum(s[2] == k for s in spans) for spans in found], pa.int64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), *counts, pa.array([sha256(spans_text(s).encode()).hexdigest() for s in found], pa.string()),
                    pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in found], base),
                    pa.array([sorted({entity_of(t, x) for x in s}) for t, s in zip(texts, found)], pa.list_(pa.int64())),
                    pa.array([neighbours(t, s) if s else [] for t, s in zip(texts, found)], near)],
                    names=["doc_id", "key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "entities", "near"])

    frame = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_key(F.col(text))).alias("key"), F.col(text).cast("string").alias("text"))
    return frame.mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
                            "base array<struct<start: bigint, end: bigint, kind: int>>, entities array<bigint>, near array<struct<entity: bigint, context: bigint, term: string, slot: int, start: bigint, end: bigint>>")


def document_frequency(docs: DataFrame, text: str, slots: np.ndarray) -> DataFrame:
    """(term, df): documents that have the term, for terms whose slot is set; counted in each task first."""
    table = np.zeros(SLOTS, dtype=bool)
    table[slots] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(table))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shared.value).tobytes()
        known: dict[str, bool] = {}
        for batch in batches:
            counts: dict[str, int] = {}
            for t in batch.column(0).to_pylist():
                for w in {w for w in set(_WORD.findall((t or "").lower())) if known.get(w, True)}:
                    if wanted[zlib.crc32(w.encode()) % SLOTS]:
                        counts[w] = counts.get(w, 0) + 1
                    elif len(known) < 200_000:   # words met before are not hashed again
                        known[w] = False
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))


def disclosing(docs: DataFrame, found: DataFrame, text: str, threshold: float, support: int) -> DataFrame:
    """(entity, term, disclosure) of terms that reveal an entity: PMI(term; entity) / IC(entity) of ``threshold`` or more.

    p(entity | term) is the share of the term's documents in which it stands next to the entity, p(entity) the share of
    all documents. That ratio is 1 + log p(entity | term) / -log p(entity): 1 if the term gives the entity away, 0 if it
    tells nothing. The pair must have been seen in ``support`` different contexts, so copies of one text are no evidence.
    Counts are over all documents.
    """
    rows = found.select("doc_id", "key", F.inline("near"))
    seen = rows.groupBy("entity", "term", "slot", "context").agg(F.count(F.lit(1)).alias("n"))
    pairs = settle(seen.groupBy("entity", "term", "slot").agg(F.sum("n").alias("together"), F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") >= support))
    own = rows.groupBy("entity", "doc_id", "key").agg(F.count(F.lit(1)).alias("x")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    slots = pairs.select("slot").distinct().toArrow()["slot"].to_numpy()   # at most SLOTS numbers
    df = document_frequency(docs, text, slots)
    n = F.lit(float(max(1, found.count())))
    p_entity = F.least(F.col("n_entity") / n, F.lit(1.0))
    score = F.when(p_entity >= 1.0, 0.0).otherwise(1.0 + F.log(F.least(F.col("together") / F.col("df"), F.lit(1.0))) / -F.log(p_entity))
    return (pairs.join(df, "term").join(own, "entity").select("entity", "term", score.alias("disclosure")).where(F.col("disclosure") >= threshold))


def term_spans(docs: DataFrame, found: DataFrame, doc_id: str, text: str, threshold: float, support: int) -> DataFrame:
    """(__id, __key, __terms): every occurrence of a disclosing term in the documents that name its entity, as (start, rank, end).

    Only those documents are read again, found by a bit table of fixed size; the others stay where they are.
    """
    flagged = settle(disclosing(docs, found, text, threshold, support).select("entity", "term"))
    named = found.where(F.size("entities") > 0).select(F.col("doc_id").alias("id"), "key", F.explode("entities").alias("entity"))
    wanted = settle(named.join(flagged, "entity").groupBy("id", "key").agg(F.collect_set("term").alias("terms")))
    keyed = docs.select(F.col(doc_id).alias("__id"), F.xxhash64(doc_key(F.col(text))).alias("__key"), F.col(text).cast("string").alias("__text"))
    some = maybe_in(keyed.withColumn("__mark", F.xxhash64("__id", "__key")), "__mark", wanted.select(F.xxhash64("id", "key").alias("__mark"))).where("maybe")
    met = some.join(wanted, some["__id"].eqNullSafe(wanted["id"]) & (some["__key"] == wanted["key"])).select("__id", "__key", "__text", "terms")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 4 << 20):
                marks = [occurrences(t or "", set(terms)) for t, terms in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(marks, kind)], names=["__id", "__key", "__terms"])

    fields = f"__id {keyed.schema['__id'].dataType.simpleString()}, __key long, __terms array<struct<start: bigint, rank: int, end: bigint>>"
    return met.mapInArrow(run, fields).dropDuplicates(["__id", "__key"])   # rows of equal id and text have equal spans


def occurrences(text: str, terms: set[str]) -> list[dict]:
    """Spans of the words of ``text`` that are ``terms`` in any case, outside base matches."""
    base = base_spans(text)
    return [{"start": m.start(), "rank": 4, "end": m.end()} for m in _WORD.finditer(text)
            if m[0].lower() in terms and not any(m.start() < y and x < m.end() for x, y, _ in base)]


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, support: int = 3) -> DataFrame:
    """(doc_id, key, n_email, n_ip, n_card, n_phone, base_sha256, all_spans) of every row of ``docs``.

    ``all_spans`` holds (start, rank, end) by start, then kind (the place in KINDS): base matches, and the disclosing
    terms wherever they stand in a document that names the entity they disclose (WINDOW words around it are the evidence). Terms stand outside base matches, which all stay. Null
    text counts as empty; rows of equal id and text get equal results; an empty table gives an empty one.
    """
    found = settle(scan(docs, doc_id, text))
    terms = term_spans(docs, found, doc_id, text, threshold, support)
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("rank"), s["end"].alias("end")))
    both = found.join(terms, found["doc_id"].eqNullSafe(terms["__id"]) & (found["key"] == terms["__key"]), "left")
    every = F.array_sort(F.concat(base, F.coalesce("__terms", F.expr("array()").cast("array<struct<start: bigint, rank: int, end: bigint>>"))))
    return both.select("doc_id", "key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", every.alias("all_spans"))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each (start, rank, end) replaced by its kind in brackets; overlapping spans become that of the first."""
    out, done = [], 0
    for start, rank, end in spans:
        if start >= done:
            out += [text[done:start], f"[{KINDS[rank].upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, support: int = 3) -> DataFrame:
    """All columns of ``docs`` with personal data generalised to their kind: ``[EMAIL]``, ``[IP]``, ``[CARD]``, ``[PHONE]``, ``[TERM]``.

    Other columns are handed back as they were; null text stays null, an empty table empty. Base matches are found again where the row lies; only spans of disclosing terms are joined, from a written table whose
    size Spark checks before it decides whether whole texts must be shuffled.
    """
    terms = settle(term_spans(docs, settle(scan(docs, doc_id, text)), doc_id, text, threshold, support))
    keyed = nest(docs, own=F.xxhash64(doc_key(F.col(text))))
    met = keyed.join(terms, keyed["row"][doc_id].eqNullSafe(terms["__id"]) & (F.col("own") == F.col("__key")), "left").select("row", "__terms")
    at = docs.columns.index(text)

    def clean(t: str, terms: list[dict] | None) -> str:
        return redact(t, sorted([(a, k, b) for a, b, k in base_spans(t)] + [(s["start"], s["rank"], s["end"]) for s in terms or ()]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 4 << 20, at):
                row = part.column(0)
                cut = [clean(t, terms) if t else t for t, terms in zip(row.field(at).to_pylist(), part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([with_text(row, at, cut)], names=["row"])

    return unnest(met.mapInArrow(run, met.select("row").schema), docs.columns)
