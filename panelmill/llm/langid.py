"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, slices

#: Letters are taken in pieces of this many code points, cut between words.
PIECE = 1 << 20
#: Odd multipliers of the 32-bit multiplicative hash, one for each place of an n-gram.
PLACES = np.array([2654435761, 2246822519, 3266489917, 668265263], dtype=np.uint32)
_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Code point -> lower-case letter, or a space for what is no letter."""
    if not _FOLD:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                table[i] = ord(c.lower()[0])
        _FOLD.append(table)
    return _FOLD[0]


def _pieces(texts: Iterable[str]) -> Iterator[tuple[list[str], list[int]]]:
    """Texts in groups of about PIECE code points; a longer text is split between words.

    An n-gram never spans words, so the split changes nothing; only a single run of over PIECE letters is cut inside.
    """
    group, owner, held = [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            end = min(len(t), at + PIECE)
            if end < len(t):
                cut = end
                while cut > at and t[cut - 1].isalpha():
                    cut -= 1
                end = cut if cut > at else end
            if held and held + end - at > PIECE:
                yield group, owner
                group, owner, held = [], [], 0
            group.append(t[at:end])
            owner.append(i)
            held += end - at
            at = end
    if group:
        yield group, owner


def _ngrams(group: list[str], orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Start of each text in the folded letters, and for each order the bucket at every place (2**bits: no n-gram)."""
    joined = np.frombuffer((" " + " ".join(group) + " ").encode("utf-32-le"), dtype=np.uint32)
    codes = _fold()[joined]
    space = codes == 32
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    ends = np.cumsum([0, *(len(t) + 1 for t in group)])
    starts = np.cumsum(keep)[ends] - 1
    codes, space = codes[keep], space[keep]
    none, found = 1 << bits, []
    for n in orders:
        size = max(0, len(codes) - n + 1)
        h = codes[:size] * PLACES[0]
        for k in range(1, n):
            h = h + (codes[k:k + size] ^ np.uint32(k * 0x9E3779)) * PLACES[k]
        h ^= h >> np.uint32(15)
        h = (h * np.uint32(2654435761)) >> np.uint32(32 - bits)
        bad = space[:size] if n == 1 else space[:size] & space[1:1 + size] if n == 2 else np.zeros(size, dtype=bool)
        for k in range(1, n - 1):
            bad = bad | space[k:k + size]
        h[bad] = none
        found.append(h)
    return starts, found


def count_ngrams(docs: DataFrame, text: str, label: str, orders: tuple[int, ...] = (1, 2, 3), bits: int = 16) -> DataFrame:
    """(label, bucket, n) over all rows with a label; bucket -1 counts the documents.

    Every task adds up its own rows first, so one row for each label and bucket that it has met reaches the shuffle.
    """
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, 0, 4 << 20):
                by: dict[str, list[str]] = {}
                for t, lab in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    by.setdefault(lab, []).append(t)
                for lab, rows in by.items():
                    total = totals.setdefault(lab, np.zeros((1 << bits) + 2, dtype=np.int64))
                    total[-1] += len(rows)
                    for group, _ in _pieces(rows):
                        for h in _ngrams(group, orders, bits)[1]:
                            total[:-1] += np.bincount(h, minlength=(1 << bits) + 1)
        for lab, total in totals.items():
            total[-2] = 0
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lab] * len(at), pa.string()), pa.array(np.where(at == (1 << bits) + 1, -1, at), pa.int32()), pa.array(total[at], pa.int64())],
                names=["label", "bucket", "n"])

    rows = docs.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text).cast("string"), F.col(label).cast("string"))
    return rows.mapInArrow(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", label: str = "lang", orders: tuple[int, ...] = (1, 2, 3), bits: int = 16, alpha: float = 0.5, max_labels: int = 512) -> dict:
    """Naive Bayes model of all rows whose text and label are not null.

    The model is a matrix of labels by 2**bits buckets, the only thing that reaches the driver; more than ``max_labels``
    distinct labels raise an error, so its size is bounded (labels are names of languages). No labelled row: no label.
    """
    counts = count_ngrams(docs, text, label, orders, bits).persist()
    try:
        documents = counts.where("bucket = -1").orderBy("label").limit(max_labels + 1).collect()
        if len(documents) > max_labels:
            raise ValueError(f"more than {max_labels} labels")
        labels = [r["label"] for r in documents]
        table = counts.where("bucket >= 0").toArrow() if labels else None
    finally:
        counts.unpersist()
    n = np.zeros(((1 << bits) + 1, len(labels)))
    if labels:
        place = {lab: i for i, lab in enumerate(labels)}
        code = table["label"].combine_chunks().dictionary_encode()
        column = np.array([place[x] for x in code.dictionary.to_pylist()], dtype=np.int64)[code.indices.to_numpy()] if len(code) else np.zeros(0, dtype=np.int64)
        n[table["bucket"].to_numpy(), column] = table["n"].to_numpy()
    logp = np.log(n[:-1] + alpha) - np.log(n[:-1].sum(0) + alpha * (1 << bits))
    prior = np.array([r["n"] for r in documents], dtype=float)
    return {"labels": labels, "logp": np.ascontiguousarray(np.vstack([logp, np.zeros(len(labels))]).T), "prior": np.log(prior / prior.sum()) if labels else prior, "orders": orders, "bits": bits}


def scores(model: dict, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log joint of each text and label, and the number of letters and n-grams that it rests on."""
    out = np.tile(model["prior"], (len(texts), 1))
    seen = np.zeros(len(texts), dtype=np.int64)
    for group, owner in _pieces(texts):
        starts, found = _ngrams(group, model["orders"], model["bits"])
        owner = np.array(owner)
        full = np.flatnonzero(np.diff(starts) > 0)
        if not len(full):
            continue
        for h in found:
            inside = full[starts[full] < len(h)]
            if len(inside):
                at, h = starts[inside], h.astype(np.intp)
                for k, column in enumerate(model["logp"]):
                    np.add.at(out[:, k], owner[inside], np.add.reduceat(column.take(h), at))
        np.add.at(seen, owner[full], np.diff(starts)[full])
    return out, seen


def predict(docs: DataFrame, model: dict, text: str = "text", keep: Sequence[str] = ("doc_id",), out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns with the label (string) and the score (its posterior, 0 to 1), called as ``out`` says.

    Null text, or text without a letter: ``und`` and 0.0, as where nothing was learned. Ties go to the label that sorts
    first. Repeated rows each get their own result; an empty table gives an empty one. The matrix is broadcast; texts are
    scored batch by batch as a sparse product: for each label, its entries at a text's buckets are added up.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, columns = [*keep, *out], list(dict.fromkeys([*keep, text]))
    frame = docs.select(*[F.col(f"`{c}`") for c in columns])
    at = columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, at, 4 << 20):
                joint, seen = scores(m, [t or "" for t in part.column(at).to_pylist()])
                if m["labels"]:
                    best = joint.argmax(1)
                    post = 1 / np.exp(joint - joint.max(1, keepdims=True)).sum(1)
                    found = [m["labels"][b] if k else "und" for b, k in zip(best, seen > 0)]
                    post = np.where(seen > 0, post, 0.0)
                else:
                    found, post = ["und"] * part.num_rows, np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], pa.array(found, pa.string()), pa.array(post, pa.float64())], names=names)

    kinds = "".join(f"`{c}` {frame.schema[c].dataType.simpleString()}, " for c in keep)
    return frame.mapInArrow(run, f"{kinds}`{out[0]}` string, `{out[1]}` double")


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves 0 when divided by 5; a null id is."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def in_a_language(docs: DataFrame, languages: Sequence[str] | None = None, min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they were, whose predicted language is one of ``languages`` (None: any that the
    labelled rows teach) with a score of ``min_score`` or more.

    A text that is null or has no letter has no language (``und``) and goes, as does one that is as likely to be in
    another language. Rows of equal text share their fate; an empty table stays empty.
    """
    model = fit(docs.where(~held_out()))
    label, score = fresh(docs.columns, "lang_pred"), fresh(docs.columns, "score")
    wanted = F.col(label) != "und" if languages is None else F.col(label).isin(*languages)
    return predict(docs, model, keep=docs.columns, out=(label, score)).where(wanted & (F.col(score) >= min_score)).select(*[F.col(f"`{c}`") for c in docs.columns])


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learns from rows that are not held out only."""
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model, keep=("doc_id", "held_out"))
