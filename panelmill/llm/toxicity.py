"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import slices, texts_of
from .langid import held_out

#: Buckets of the feature hash: so many that a long text seldom meets one of the few that carry weight by chance.
BITS = 28
#: Labelled rows that training takes, about, and rows of one shard, which one task trains on.
MAX_ROWS, SHARD = 32_768, 8_192
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MIX = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.cumprod(np.full(1024, 0xBF58476D1CE4E5B9, dtype=np.uint64), dtype=np.uint64)
_LEFT, _RIGHT, _SKIP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x94D049BB133111EB)


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _LEFT
    return h ^ (h >> np.uint64(29))


def features(texts: Sequence[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word, pair of neighbours and pair with one word between, repeats included.

    A word is a run of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased. No feature spans texts.
    """
    raw = np.frombuffer(b" ".join(texts).translate(_WORD), dtype=np.uint8)
    letter = raw != 32
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.uint32)
    at = np.flatnonzero(letter)
    begin = np.searchsorted(at, starts)
    place = np.arange(len(at)) - np.repeat(begin, np.diff([*begin.tolist(), len(at)]))
    word = _stir(np.add.reduceat(_MIX[raw[at]] * _POWERS[place & 1023], begin))
    ends = np.cumsum([len(t) + 1 for t in texts])
    row = np.searchsorted(ends, starts, side="right").astype(np.int32)
    near, far = row[1:] == row[:-1], row[2:] == row[:-2]
    pairs = _stir(word[:-1] * _LEFT + word[1:] * _RIGHT)[near]
    skips = _stir(word[:-2] * _SKIP + word[2:] * _RIGHT)[far]
    every = np.concatenate([word, pairs, skips]) >> np.uint64(64 - bits)
    return np.concatenate([row, row[:-1][near], row[:-2][far]]), every.astype(np.uint32)


def distinct(row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (row, bucket) once, by row."""
    both = np.unique(row.astype(np.uint64) << np.uint64(32) | bucket)
    return (both >> np.uint64(32)).astype(np.int32), (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def ftrl(row: np.ndarray, coordinate: np.ndarray, label: np.ndarray, width: int, epochs: int, alpha: float, beta: float, l1: float, l2: float, batch: int, balance: float = 1.0, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and intercept after ``epochs`` passes of FTRL-proximal over rows of 0/1 features (``row`` ascending).

    Every coordinate has its own rate alpha / (beta + sqrt(sum of squared gradients)); a coordinate whose accumulated
    gradient stays within ``l1`` has weight zero. ``batch`` rows share one step; a row of label 1 counts ``balance`` times. The intercept is not regularised.
    """
    z, n = np.zeros(width + 1), np.zeros(width + 1)
    strength = np.full(width + 1, l1)
    strength[width] = 0.0   # the intercept is the last coordinate

    def weights(i: np.ndarray) -> np.ndarray:
        w = (np.sign(z[i]) * strength[i] - z[i]) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(z[i]) <= strength[i], 0.0, w)

    rows = len(label)
    bounds = np.searchsorted(row, np.arange(rows + 1))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        deal = order.permutation(rows)
        for at in range(0, rows, batch):
            some = deal[at:at + batch]
            size = bounds[some + 1] - bounds[some]
            place = np.repeat(bounds[some] - np.cumsum(size) + size, size) + np.arange(size.sum())
            i, inverse = np.unique(np.append(coordinate[place], width), return_inverse=True)
            w, own = weights(i), np.repeat(np.arange(len(some)), size)
            logit = np.bincount(own, w[inverse[:-1]], len(some)) + w[-1]
            error = (sigmoid(logit) - label[some]) * np.where(label[some] > 0, balance, 1.0)
            g = np.bincount(inverse, np.append(error[own], error.sum()), len(i))
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - step * w
            n[i] += g * g
    w = weights(np.arange(width + 1))
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, min_docs: int = 3,
        epochs: int = 20, alpha: float = 2.0, beta: float = 1.0, l1: float = 16.0, l2: float = 0.001, batch: int = 16) -> dict:
    """Model (buckets, weights, intercept) of the rows that ``labels`` marks 0 or 1; one that knows nothing scores 0.5.

    About ``max_rows`` rows are taken, by a hash of their id, so cost and size are bounded; all are where there are fewer.
    They are dealt to shards at random. Each shard is trained by FTRL in one task over the buckets that ``min_docs`` of
    its documents hold, and the model is the mean over shards: L1 leaves a few thousand buckets, all that reaches the
    driver. Inside a shard the rarer toxic rows count as much as the others. Several label rows of one id count as one, toxic if any says so; null ids, labels and texts teach nothing.
    """
    spark = docs.sparkSession
    marks = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).join(marks, "id")
    total = marks.count()
    if total > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("id", F.lit(13)), F.lit(1 << 30)) < int((1 << 30) * max_rows / total))
    shards = max(1, math.ceil(min(total, max_rows) / SHARD))
    rows = rows.select(F.pmod(F.xxhash64("id", F.xxhash64("text")), F.lit(shards)).cast("int").alias("shard"), "text", "y")

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by([("text", "ascending"), ("y", "ascending")])
        row, bucket, done = [], [], 0
        for batch_ in table.to_batches(max_chunksize=256):
            for part in slices(batch_, 1, 4 << 20):
                r, b = distinct(*features(texts_of(part, 1)))
                row.append(r + done)
                bucket.append(b)
                done += part.num_rows
        row, bucket = np.concatenate(row), np.concatenate(bucket)
        known, place, count = np.unique(bucket, return_inverse=True, return_counts=True)
        often = count >= min_docs
        held = often[place]
        y = table["y"].to_numpy().astype(float)
        balance = min(32.0, max(1.0, (len(y) - y.sum()) / max(1.0, y.sum())))
        w, bias = ftrl(row[held], (np.cumsum(often) - 1)[place[held]], y, int(often.sum()), epochs, alpha, beta, l1, l2, batch, balance)
        at = np.flatnonzero(w)
        return pa.table({"bucket": pa.array([-1, *known[often][at].tolist()], pa.int64()), "weight": pa.array([bias, *w[at].tolist()], pa.float64())})

    learned = rows.groupBy("shard").applyInArrow(train, "bucket long, weight double")
    got = settle(learned).groupBy("bucket").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n")).orderBy("bucket").toArrow()
    if not got.num_rows:
        return {"buckets": np.zeros(0, dtype=np.uint32), "weights": np.zeros(0), "intercept": 0.0}
    trained = got["n"][0].as_py()   # shards that had rows
    mean = got["weight"].to_numpy() / trained
    return {"buckets": got["bucket"].to_numpy()[1:].astype(np.uint32), "weights": mean[1:], "intercept": float(mean[0])}


def logits(model: dict, texts: Sequence[bytes]) -> np.ndarray:
    """Linear score of each text; a bucket counts once however often the text has it."""
    out = np.full(len(texts), model["intercept"])
    buckets = model["buckets"]
    if len(buckets):
        row, bucket = features(texts)
        hit = model["filter"][bucket & np.uint32((1 << 22) - 1)]
        row, bucket = distinct(row[hit], bucket[hit])
        at = np.minimum(np.searchsorted(buckets, bucket), len(buckets) - 1)
        known = buckets[at] == bucket
        np.add.at(out, row[known], model["weights"][at[known]])
    return out


def predict(docs: DataFrame, model: dict, text: str = "text", keep: Sequence[str] = ("doc_id",), out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``keep`` columns with the score (0 to 1, higher: toxic likelier) and 1 where it is at least 0.5, else 0.

    Null counts as empty; a text without words has the intercept's score. Repeated rows each get their own result, an
    empty table gives an empty one. The weights are broadcast; texts are scored whole, batch by batch.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = list(dict.fromkeys([*keep, text]))
    frame = docs.select(*[F.col(f"`{c}`") for c in columns])
    at = columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = dict(shared.value)
        m["filter"] = np.zeros(1 << 22, dtype=bool)   # most features end here
        m["filter"][m["buckets"] & np.uint32((1 << 22) - 1)] = True
        for batch in batches:
            for part in slices(batch, at, 2 << 20):
                score = sigmoid(logits(m, texts_of(part, at)))
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())], names=[*keep, *out])

    kinds = "".join(f"`{c}` {frame.schema[c].dataType.simpleString()}, " for c in keep)
    return frame.mapInArrow(run, f"{kinds}`{out[0]}` double, `{out[1]}` int")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learns from rows that are not held out only.

    Id and labels choose the rows that teach; a score depends on the text alone.
    """
    model = fit(docs.where(~held_out()), labels)
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model, keep=("doc_id", "held_out"))
