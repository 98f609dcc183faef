"""Regression forests and boosting over binned blocks: all train windows, candidates and trees grow level by level together.

Features are binned once and rows are written as blocks of columns (one byte a value), ordered by period, so a train window
is a slice of every block. A pass makes, for every tree that is growing, the histograms of gradient sums of the nodes of one
level; they are added up over tasks by key and turned into splits where they are added. Only splits reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import delete, discard, settle
from .gram import complete

BINS = 32            # bins of a feature
SAMPLE = 100_000     # rows whose values place the bin edges, about; they are chosen by a hash of their values
BLOCK_ROWS = 16_384  # rows of a block
CELLS = 2_000_000    # histogram cells (node x feature x bin) that one pass keeps in a task
MODEL_BYTES = 256 << 20
HALVED = 1_000_000   # rows from which on boosting counts one child of two; below, a pass's fixed cost outweighs that
PAIRED = 8           # nodes of a level up to which forests count the bins of two features at once
WORD = 5             # levels of a tree whose nodes are the bits of a word
BITS = 5             # bits of a bin
PACKED = 12          # features whose bins share an integer of 64 bits
CODE = 10            # bits of a code: the bins of two features, or of more that have few
JOINT = 32           # nodes of a level up to which boosting counts by codes
NEAR = 16            # nodes of a level up to which forests count node by node, where a node has more than FEW features
FEW = 5
PIECE = 1 << 16      # rows of a block of forests, about
HELD = 1 << 19       # rows of a task whose draws of one tree are held together
FOREST = {"trees": 100, "depth": 10, "min_leaf": 2, "min_split": 5, "share": 1 / 3, "bootstrap": True}
BOOSTING = {"rounds": 100, "rate": 0.1, "depth": 5, "min_leaf": 1, "min_split": 2}
_POISSON = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)]), (np.arange(65_536) + 0.5) / 65_536).astype(np.uint8)
_TAKEN = np.uint64(int(np.argmax(_POISSON > 0)) << 48)   # hashes from here on take a row at least once


@dataclass
class TreeModel:
    """Trees in heap order (children of i: 2i + 1 and 2i + 2); a leaf has feature -1. Rows with value <= threshold go left."""

    features: list[str]
    cuts: list[np.ndarray]
    base: float
    scale: float
    feature: np.ndarray   # trees x nodes
    cut: np.ndarray       # place of the threshold among the feature's cuts
    value: np.ndarray
    cover: np.ndarray     # (weighted) train rows
    gain: np.ndarray
    kind: str = "random_forest"

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bin of every value: rows x features."""
        return np.stack([np.searchsorted(c, x[:, k]) for k, c in enumerate(self.cuts)], axis=1).astype(np.uint8)

    def leaves(self, b: np.ndarray, tree: int) -> np.ndarray:
        """Leaf of every row of ``bins`` in a tree."""
        columns = np.ascontiguousarray(b.T)
        return settled(self.feature[tree])[reach(Route(self.feature[tree], self.cut[tree], self.depth), columns.ravel(), columns.shape[1], 0, len(b))]

    @property
    def depth(self) -> int:
        return int(self.feature.shape[1] + 1).bit_length() - 2 if self.feature.size else 0

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.score(np.ascontiguousarray(self.bins(x).T))

    def score(self, columns: np.ndarray) -> np.ndarray:
        """Prediction from bins as features x rows."""
        n = columns.shape[1]
        out, flat = np.full(n, self.base), columns.ravel()
        for route, leaf in self.routes():
            out += leaf.take(reach(route, flat, n, 0, n))
        return out

    def routes(self) -> list[tuple[Route, np.ndarray]]:
        """Route and scaled leaf values by node of every tree, made once."""
        if self.__dict__.get("_routes") is None:
            self.__dict__["_routes"] = [(Route(f, c, self.depth), self.scale * v[settled(f)]) for f, c, v in zip(self.feature, self.cut, self.value)]
        return self.__dict__["_routes"]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_routes"}

    def importances(self) -> np.ndarray:
        """Share of each feature in the gain of a tree, averaged over the trees that split."""
        out = np.zeros(len(self.features))
        for f, g in zip(self.feature, self.gain):
            one = np.bincount(f[f >= 0], g[f >= 0], len(self.features))
            out += one / one.sum() if one.sum() > 0 else 0
        return out / out.sum() if out.sum() > 0 else out

    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.feature, self.cut, self.value, self.cover, self.gain))

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """``df`` with the prediction; null where a feature is null. The model's size is checked before it is broadcast."""
        return predict_by(df, {0: self}, F.lit(0), out)


def predict_by(df: DataFrame, models: Mapping[int, TreeModel], which, out: str = "prediction", keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` (of it the columns ``keep``) with the prediction of the model that the column ``which`` names, rows where they are."""
    if sum(m.nbytes() for m in models.values()) > MODEL_BYTES:
        raise ValueError("the models are too large to broadcast")
    columns = df.columns if keep is None else list(keep)
    if not models:
        return df.select(*[F.col(f"`{c}`") for c in columns], F.lit(None).cast("double").alias(out))
    shared = df.sparkSession.sparkContext.broadcast(dict(models))
    names = next(iter(models.values())).features

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(len(columns)).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(names)) if names else np.zeros((batch.num_rows, 0))
            model = batch.column(len(columns) + 1).to_numpy(zero_copy_only=False)
            found = np.full(batch.num_rows, np.nan)
            whole = ~np.isnan(values).any(1)
            for m in np.unique(model[whole]):
                at = np.flatnonzero(whole & (model == m))
                if m in shared.value:
                    found[at] = shared.value[m].predict(values[at])
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(columns)], pa.array(found, mask=np.isnan(found))], names=[*columns, out])

    wide = df.select(*[F.col(f"`{c}`") for c in columns], F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in names]).alias("__x"), F.coalesce(which.cast("bigint"), F.lit(-1)).alias("__m"))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    return wide.mapInArrow(run, f"{kinds}, `{out}` double" if columns else f"`{out}` double")


def steps(feature: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature and cut to step by at every node; rows of a leaf go on to the left, to nodes that do not exist."""
    return np.maximum(feature, 0).astype(np.int64), np.where(feature < 0, 255, cut).astype(np.uint8)


class Route:
    """The way from the root to the nodes of a level.

    The nodes of the first WORD levels are bits of a word: a table for each feature holds, by bin, the nodes that the splits
    on it leave open, and what all tables leave open is the node reached. Deeper levels are single steps.
    """

    def __init__(self, feature: np.ndarray, cut: np.ndarray, levels: int):
        self.top, self.levels = min(levels, WORD), levels
        width = 1 << self.top
        kind = np.uint8 if width <= 8 else np.uint16 if width == 16 else np.uint32
        whole = kind((1 << width) - 1)
        tables: dict[int, np.ndarray] = {}
        shut = 0   # right of a leaf
        for d in range(self.top):
            half = width >> (d + 1)
            for j in range(1 << d):
                i = (1 << d) - 1 + j
                f, left = int(feature[i]), ((1 << half) - 1) << (2 * half * j)
                if f < 0:
                    shut |= left << half
                    continue
                if f not in tables:
                    tables[f] = np.full(BINS, whole, kind)
                tables[f][:int(cut[i]) + 1] &= ~kind(left << half)
                tables[f][int(cut[i]) + 1:] &= ~kind(left)
        self.tables = sorted(tables.items())
        if self.tables:
            self.tables[0][1][:] &= ~kind(shut)
        self.feature, self.cut = steps(feature, cut) if levels > WORD else (None, None)
        self.used = sorted({int(f) for f in feature if f >= 0}) if levels > WORD else [f for f, _ in self.tables]


def bit(word: np.ndarray) -> np.ndarray:
    """Place of the only bit that is set."""
    return ((word.astype(np.float32).view(np.int32) >> 23) - 127).astype(np.int64)


def reach(route: Route, flat: np.ndarray, n: int, a: int, b: int) -> np.ndarray:
    """Node of the rows from a to b at the route's level; ``flat`` holds the bins of n rows, feature by feature."""
    if route.tables:
        met = None
        for f, table in route.tables:
            one = table.take(flat[f * n + a:f * n + b])
            met = one if met is None else np.bitwise_and(met, one, out=met)
        node = bit(met)
    else:
        node = np.zeros(b - a, dtype=np.int64)
    node += (1 << route.top) - 1
    if route.levels > route.top:
        first, rows = route.feature * n, np.arange(a, b)
        for _ in range(route.levels - route.top):
            right = flat.take(first.take(node) + rows) > route.cut.take(node)
            node += node
            node += 1
            node += right
    return node


def settled(feature: np.ndarray) -> np.ndarray:
    """The leaf above every node, itself included."""
    at = np.arange(len(feature))
    for i in range(1, len(feature)):
        up = at[(i - 1) // 2]
        if feature[up] < 0:
            at[i] = up
    return at


def bin_edges(df: DataFrame, features: Sequence[str], bins: int = BINS, sample: int = SAMPLE) -> list[np.ndarray]:
    """At most bins - 1 thresholds for each feature: midpoints of its values where they are few, else quantiles.

    They come from all rows, or from about ``sample`` rows that a hash of their values picks, so they are the same however
    the rows lie.
    """
    rows = complete(df.select(*[F.col(f).cast("double").alias(f) for f in features]), features)
    n = rows.count()
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64(*features, F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    table = rows.toArrow()
    out = []
    for f in features:
        v = np.sort(table[f].to_numpy())
        u = np.unique(v)
        if len(u) > bins:
            u = np.unique(v[(np.arange(1, bins) * len(v)) // bins])
            out.append(u[:-1] if len(u) == bins and u[-1] == v[-1] else u[u < v[-1]])
        else:
            out.append((u[1:] + u[:-1]) / 2)
    return out


def blocks_of(df: DataFrame, target: str, features: Sequence[str], cuts: Sequence[np.ndarray], order: str = "ord", hashes: bool = True) -> DataFrame:
    """(n, x, y, ord, h) written: blocks of rows ordered by ``order``, bins as one byte, and with ``hashes`` a hash of each row's values."""
    edges, p = [np.asarray(c, dtype=float) for c in cuts], len(features)
    rows = complete(df, [target, *features])
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    flat = rows.select(F.col(order).cast("bigint").alias("ord"), F.col(target).cast("double").alias("y"), hashed.alias("h"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        o = t["ord"].to_numpy()
        at = np.lexsort((t["h"].to_numpy(), o))
        x = np.empty((len(o), p), dtype=np.uint8)
        for i in range(p):
            x[:, i] = np.searchsorted(edges[i], t[f"x{i}"].to_numpy())[at]
        cells = [len(o), x.tobytes(), t["y"].to_numpy()[at].tobytes(), o[at].tobytes(), *([t["h"].to_numpy()[at].tobytes()] if hashes else [])]
        return pa.RecordBatch.from_arrays([pa.array([cells[0]], pa.int64()), *[pa.array([c], pa.binary()) for c in cells[1:]]], names=["n", "x", "y", "ord", "h"][:len(cells)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK_ROWS:
                yield block(held)
                held = []
        if sum(b.num_rows for b in held):
            yield block(held)

    return settle(flat.mapInArrow(run, "n long, x binary, y binary, ord binary" + (", h binary" if hashes else "")))


@dataclass
class Unit:
    """A model to fit: the rows with start <= ord <= end, and parameters."""

    start: int
    end: int
    params: dict
    trees: list = field(default_factory=list)
    base: float = 0.0
    tally: np.ndarray | None = None   # boosting: rows by feature and bin, the same in every round


def code_fields(cuts: Sequence[np.ndarray]) -> list[tuple[int, int, int]]:
    """(code, shift, bits) of every feature: features share codes of CODE bits, those of many bins first."""
    out, left = {}, []
    need = [max(1, len(c).bit_length()) for c in cuts]
    for f in sorted(range(len(cuts)), key=lambda f: -need[f]):
        g = next((g for g, free in enumerate(left) if free >= need[f]), len(left))
        if g == len(left):
            left.append(CODE)
        out[f] = (g, CODE - left[g], need[f])
        left[g] -= need[f]
    return [out[f] for f in range(len(cuts))]


def _load(row, fields: Sequence[tuple[int, int, int]], spans: Sequence[tuple[int, int]]) -> dict:
    """A block of boosting as arrays: codes (codes x rows), the slice of every unit and what its trees leave of the targets."""
    n, order = row["n"], np.frombuffer(row["ord"], "<i8")
    cut = _slices(order, spans)
    x = np.frombuffer(row["x"], np.uint8).reshape(n, len(fields))
    codes = np.zeros((1 + max(g for g, _, _ in fields), n), dtype=np.uint16)
    for f, (g, shift, _) in enumerate(fields):
        codes[g] |= x[:, f].astype(np.uint16) << np.uint16(shift)
    y = np.frombuffer(row["y"], "<f8")
    return {"codes": codes, "spans": cut, "left": [y[a:b] for a, b in cut]}


def _slices(order: np.ndarray, spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    return [(int(np.searchsorted(order, a)), int(np.searchsorted(order, b, side="right"))) for a, b in spans]


def _pack(rows: Iterable, p: int, spans: Sequence[tuple[int, int]]) -> Iterator[dict]:
    """Blocks of forests, of PIECE rows or more: bins as bits of integers (integers x rows), targets and hashes, with the slice of every unit."""
    for held in _batched(rows, PIECE, lambda r: r["n"]):
        order = np.concatenate([np.frombuffer(r["ord"], "<i8") for r in held])
        at = np.argsort(order, kind="stable")
        x = np.concatenate([np.frombuffer(r["x"], np.uint8).reshape(-1, p) for r in held]).take(at, axis=0)
        words = np.zeros((-(-p // PACKED), len(at)), dtype=np.int64)
        for f in range(p):
            words[f // PACKED] |= x[:, f].astype(np.int64) << BITS * (f % PACKED)
        y, h = (np.concatenate([np.frombuffer(r[c], kind) for r in held]).take(at) for c, kind in (("y", "<f8"), ("h", "<u8")))
        yield {"words": words, "spans": _slices(order.take(at), spans), "y": y, "h": h}


def _batched(items: Iterable, rows: int, size: Callable) -> Iterator[list]:
    """Neighbouring items that have at least so many rows together."""
    held, n = [], 0
    for one in items:
        held.append(one)
        n += size(one)
        if n >= rows:
            yield held
            held, n = [], 0
    if held:
        yield held


def _weights(h: np.ndarray, tree: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Bootstrap: the rows that a tree takes and how often, Poisson(1) by a hash of the row, the tree and the seed."""
    mixed = h ^ np.uint64((tree * 0x9E3779B97F4A7C15 + seed * 0xD6E8FEB86659FD93) & (1 << 64) - 1)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x94D049BB133111EB)
    at = np.flatnonzero(mixed >= _TAKEN)
    return at, _POISSON.take((mixed.take(at) >> np.uint64(48)).view(np.int64))


def _subset(seed: int, unit: int, tree: int, node: int, p: int, k: int) -> np.ndarray:
    return np.arange(p) if k >= p else np.sort(np.random.default_rng([seed, unit, tree, node]).permutation(p)[:k])


def _draw(block: dict, tree: int, seed: int) -> dict:
    """The rows of a block that a tree takes (tree -1: all, once): places, bins and (count, weighted target) as complex numbers."""
    if tree < 0:
        at, words, w = np.arange(len(block["y"])), block["words"], 1.0
    else:
        at, w = _weights(block["h"], tree, seed)
        words = block["words"].take(at, axis=1)
    z = np.empty(len(at), dtype=np.complex128)
    z.real, z.imag = w, w * block["y"].take(at)
    return {"at": at, "words": words, "z": z, "pairs": {}}


class _Path:
    """A route over packed bins: the tables of two neighbouring features as one, single steps as a mask and a threshold."""

    def __init__(self, route: Route):
        self.top, self.levels, self.tables = route.top, route.levels, {}
        for f, table in route.tables:
            both = (table[None, :] if f % 2 == 0 else table[:, None])
            held = self.tables.get(f // 2)
            self.tables[f // 2] = np.broadcast_to(both, (BINS, BINS)) if held is None else held & both
        self.tables = {j: t.ravel() for j, t in self.tables.items()}
        if self.levels > self.top:
            shift = BITS * (route.feature % PACKED)
            self.word, self.mask, self.above = route.feature // PACKED, (BINS - 1) << shift, route.cut.astype(np.int64) << shift

    def reach(self, drawn: dict, a: int, b: int) -> np.ndarray:
        """Node of the drawn rows from a to b at the route's level."""
        met, words = None, drawn["words"]
        for j, table in self.tables.items():
            if j not in drawn["pairs"]:
                drawn["pairs"][j] = words[2 * j // PACKED] >> BITS * (2 * j % PACKED) & BINS * BINS - 1
            one = table.take(drawn["pairs"][j][a:b])
            met = one if met is None else np.bitwise_and(met, one, out=met)
        node = np.zeros(b - a, dtype=np.int64) if met is None else bit(met)
        node += (1 << self.top) - 1
        for _ in range(self.levels - self.top):
            found = _own(words, self.word, node, a, b)
            right = np.bitwise_and(found, self.mask.take(node)) > self.above.take(node)
            node += node
            node += 1
            node += right
        return node


def _own(words: np.ndarray, word: np.ndarray, node: np.ndarray, a: int, b: int) -> np.ndarray:
    """For each row from a to b the integer that holds the feature of its node; ``word`` names it by node."""
    if len(words) == 1:
        return words[0, a:b]
    return words.ravel().take((word * words.shape[1]).take(node) + np.arange(a, b))


def _counted(blocks: Iterable[dict], growing: Sequence[tuple], level: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place in ``growing``, counts and sums by node, feature slot and bin) of forests over a task's blocks.

    ``growing``: (unit, tree, whether it is bootstrapped, route to the level, places of its nodes or -1, slots' features); trees
    with the same rows stand together. A tree goes through HELD rows before the next, so that its histograms stay near.
    """
    out: dict[int, np.ndarray] = {}
    first = (1 << level) - 1
    for held in _batched(blocks, HELD, lambda b: len(b["y"])):
        mark, drawn = None, []
        for g, (unit, tree, bootstrapped, route, active, slots) in enumerate(growing):
            if not any(a < b for a, b in (block["spans"][unit] for block in held)):
                continue
            own = tree if bootstrapped else -1
            if mark != own:
                mark, drawn = own, [_draw(block, own, seed) for block in held]
            path, (nodes, k), joint = _Path(route), slots.shape, None
            word, shift = slots // PACKED, BITS * (slots % PACKED)
            if nodes == 1 or nodes <= NEAR and k > FEW:
                joint = np.zeros((nodes, (k + 1) // 2, BINS * BINS) if nodes <= PAIRED else (nodes, k, BINS), dtype=np.complex128)
            total = out.setdefault(g, np.zeros(nodes * k * BINS, dtype=np.complex128))
            for block, rows in zip(held, drawn):
                a, b = (int(v) for v in np.searchsorted(rows["at"], block["spans"][unit]))
                if a == b:
                    continue
                place, z, words = path.reach(rows, a, b) - first, rows["z"][a:b], rows["words"][:, a:b]
                if joint is not None:
                    _counted_nodes(joint, place if active is None else active.take(place), z, words, word.tolist(), shift.tolist())
                    continue
                if active is not None:
                    place = active.take(place)
                    keep = np.flatnonzero(place >= 0)
                    if len(keep) < len(place):
                        place, z, words = place.take(keep), z.take(keep), words.take(keep, axis=1)
                cell = place * (k * BINS)
                for i in range(k):
                    found = np.right_shift(_own(words, word[:, i], place, 0, len(place)), shift[:, i].take(place) if nodes > 1 else shift[0, i])
                    found &= BINS - 1
                    found += cell
                    np.add.at(total, found, z)   # counts and sums at once
                    cell += BINS
            if joint is not None and nodes > PAIRED:
                total += joint.ravel()
            elif joint is not None:
                cells, both = total.reshape(nodes, k, BINS), joint.reshape(nodes, -1, BINS, BINS)
                cells[:, ::2] += both.sum(axis=2)
                cells[:, 1::2] += both[:, :k // 2].sum(axis=3)
    for g, total in out.items():
        nodes, k = growing[g][-1].shape
        yield g, np.stack([total.real, total.imag]).reshape(2, nodes, k, BINS)


def _counted_nodes(joint: np.ndarray, place: np.ndarray, z: np.ndarray, words: np.ndarray, word: list[list[int]], shift: list[list[int]]) -> None:
    """Count rows node by node in ``joint``: nodes x slots x bins or, up to PAIRED nodes, nodes x pairs of slots x both bins.

    Place -1 is no node; a last lone slot has a pair of its own. Rows of a node lie together, so that shifts are numbers.
    """
    nodes, some = joint.shape[:2]
    k, paired = len(word[0]), nodes <= PAIRED
    ends = np.cumsum(np.bincount(place + 1, minlength=nodes + 1)).tolist()
    if ends[0] or nodes > 1:
        order = np.argsort(place.astype(np.int8), kind="stable")[ends[0]:]
        z, words = z.take(order), words.take(order, axis=1)
    for j in range(nodes):
        a, b = ends[j] - ends[0], ends[j + 1] - ends[0]
        if a == b:
            continue
        for q in range(some):
            i = 2 * q if paired else q
            code = words[word[j][i], a:b] >> shift[j][i]
            code &= BINS - 1
            if paired and i + 1 < k:
                up = shift[j][i + 1] - BITS
                other = words[word[j][i + 1], a:b]
                other = other >> up if up >= 0 else other << -up
                other &= (BINS - 1) << BITS
                code |= other
            np.add.at(joint[j, q], code, z[a:b])   # counts and sums at once


class _Way:
    """A route over codes: one table for the features of a code, single steps as a mask and a threshold."""

    def __init__(self, route: Route, fields: Sequence[tuple[int, int, int]]):
        self.top, self.levels, self.tables = route.top, route.levels, {}
        every = np.arange(1 << CODE)
        for f, table in route.tables:
            g, shift, bits = fields[f]
            own = table.take(every >> shift & (1 << bits) - 1, mode="clip")
            self.tables[g] = own if g not in self.tables else self.tables[g] & own
        if self.levels > self.top:
            code, shift, bits = np.array(fields, dtype=np.int64).T[:, route.feature]
            self.code, self.mask, self.above = code, (1 << bits) - 1 << shift, np.minimum(route.cut.astype(np.int64), (1 << bits) - 1) << shift

    def word(self, codes: np.ndarray, a: int, b: int) -> np.ndarray | None:
        """The bit of the node that each row from a to b reaches at the first levels; None at the root."""
        met = None
        for g, table in self.tables.items():
            one = table.take(codes[g, a:b])
            met = one if met is None else np.bitwise_and(met, one, out=met)
        return met

    def reach(self, codes: np.ndarray, a: int, b: int) -> np.ndarray:
        """Node of the rows from a to b at the route's level."""
        met = self.word(codes, a, b)
        node = np.zeros(b - a, dtype=np.int64) if met is None else bit(met)
        node += (1 << self.top) - 1
        if self.levels > self.top:
            flat, first, rows = codes.ravel(), self.code * codes.shape[1], np.arange(a, b)
            for _ in range(self.levels - self.top):
                right = np.bitwise_and(flat.take(first.take(node) + rows), self.mask.take(node)) > self.above.take(node)
                node += node
                node += 1
                node += right
        return node


def _places(level: int, active: np.ndarray | None) -> np.ndarray:
    """Place of the node among those that are counted by its bit in the word of a level below WORD, -1 if it is not."""
    out = np.full(1 << (1 << level), -1, dtype=np.int64)
    out[1 << np.arange(1 << level)] = np.arange(1 << level) if active is None else active
    return out


def _histograms(blocks: Iterable[dict], growing: Sequence[tuple], level: int, fields: Sequence[tuple[int, int, int]]) -> Iterator[tuple[int, np.ndarray]]:
    """The same of boosting: all rows and features. The first counts are the same in every round and are made by ``tally``.

    Rows are counted once for each code, by all its bins together, and the counts of the single features are sums of those;
    beyond JOINT nodes once for each feature.
    """
    out: dict[int, np.ndarray] = {}
    first, p, kind = (1 << level) - 1, len(fields), np.complex128 if level else np.float64   # counts and sums at once
    ways: list[tuple] = [(_Way(route, fields), _places(level, active) if 0 < level < WORD else None) for _, _, _, route, active, _ in growing]
    for held in _batched(blocks, HELD, lambda b: b["codes"].shape[1]):
        for g, (unit, _, _, _, active, slots) in enumerate(growing):
            nodes, (way, places), joint = len(slots), ways[g], None
            for block in held:
                a, b = block["spans"][unit]
                if a == b:
                    continue
                codes, s = block["codes"][:, a:b], block["left"][unit]
                if level == 0:
                    place = None
                elif places is not None:
                    met = way.word(block["codes"], a, b)
                    place = np.zeros(b - a, dtype=np.int64) if met is None else places.take(met)
                else:
                    place = way.reach(block["codes"], a, b) - first
                    place = place if active is None else active.take(place)
                if level and active is not None:
                    keep = np.flatnonzero(place >= 0)
                    if len(keep) < len(place):
                        place, s, codes = place.take(keep), s.take(keep), codes.take(keep, axis=1)
                if level:
                    z = np.empty(len(s), dtype=np.complex128)
                    z.real, z.imag = 1.0, s
                    s = z
                if nodes <= JOINT:
                    if joint is None:
                        joint = np.zeros((len(codes), nodes << CODE), dtype=kind)
                    start = place << CODE if level else None
                    for total, code in zip(joint, codes):
                        if level:
                            np.add.at(total, code + start, s)
                        else:   # add.at is slow on arrays as they were unpickled
                            total += np.bincount(code, s, 1 << CODE)
                else:
                    if joint is None:
                        joint = np.zeros((p, nodes * BINS), dtype=kind)
                    start = place * BINS
                    for total, (c, shift, bits) in zip(joint, fields):
                        np.add.at(total, (codes[c] >> shift & (1 << bits) - 1) + start, s)
            if joint is not None:
                one = _single(joint, nodes, fields) if nodes <= JOINT else joint.reshape(p, nodes, BINS).transpose(1, 0, 2)
                out[g] = out[g] + one if g in out else one
    for g, total in out.items():
        yield g, np.stack([total.real if level else np.zeros(total.shape), total.imag if level else total])


def _single(joint: np.ndarray, nodes: int, fields: Sequence[tuple[int, int, int]]) -> np.ndarray:
    """Cells by node, feature and bin from cells by code, node and value of the code."""
    out = np.zeros((nodes, len(fields), BINS), dtype=joint.dtype)
    for f, (g, shift, bits) in enumerate(fields):
        out[:, f, :1 << bits] = joint[g].reshape(nodes, -1, 1 << bits, 1 << shift).sum(axis=(1, 3))[:, :BINS]
    return out


def _tally(block: dict, fields: Sequence[tuple[int, int, int]]) -> list[tuple[int, np.ndarray]]:
    """(unit, rows by feature and bin) of a block."""
    return [(u, _single(np.stack([np.bincount(c[a:b], minlength=1 << CODE) for c in block["codes"]]), 1, fields)[0]) for u, (a, b) in enumerate(block["spans"]) if a < b]


def best_splits(hist: np.ndarray, slots: np.ndarray, min_leaf: int, min_split: int) -> np.ndarray:
    """(feature or -1, cut, gain, left rows, left sum, right rows, right sum) of every node; ties to the first feature, then cut."""
    n, s = hist[0].sum(-1)[:, :1], hist[1].sum(-1)[:, :1]   # nodes x 1
    ln, ls = np.cumsum(hist[0], -1)[..., :-1], np.cumsum(hist[1], -1)[..., :-1]
    rn, rs = n[..., None] - ln, s[..., None] - ls
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = ls**2 / ln + rs**2 / rn - (s**2 / n)[..., None]
    gain = np.where((ln >= max(min_leaf, 1)) & (rn >= max(min_leaf, 1)) & (n[..., None] >= min_split), gain, -np.inf).reshape(len(n), -1)
    best = np.argmax(gain >= gain.max(1, keepdims=True) * (1 - 1e-12), axis=1) if gain.shape[1] else np.zeros(len(n), int)
    rows = np.arange(len(n))
    slot, cut = best // (BINS - 1), best % (BINS - 1)
    found = gain[rows, best]
    pick = lambda t: t.reshape(len(n), -1)[rows, best]
    scale = 1e-12 * (1 + (s**2 / np.maximum(n, 1))[:, 0])
    return np.stack([np.where(found > scale, slots[rows, slot], -1), cut, found, pick(ln), pick(ls), pick(rn), pick(rs)], axis=1)


class _Tree:
    def __init__(self, unit: int, tree: int, depth: int, halved: bool = False):
        size = (2 << depth) - 1
        self.unit, self.tree, self.depth, self.halved = unit, tree, depth, halved
        self.feature, self.cut = np.full(size, -1, dtype=np.int8), np.zeros(size, dtype=np.uint8)
        self.value, self.cover, self.gain = np.zeros(size), np.zeros(size), np.zeros(size)
        self.open = np.array([0])
        self.sums: np.ndarray | None = None   # boosting: histograms of the nodes that split last, in their order


def _grow(blocks, trees: Sequence[_Tree], units: Sequence[Unit], p: int, seed: int, partitions: int, tasks: int, fields: Sequence[tuple[int, int, int]]) -> None:
    """Grow all trees level by level; a level takes as many passes as its histograms need to stay within CELLS a task.

    Histograms of a boosting pass that are within CELLS over all tasks are added up where they are split, which spares each of
    its many passes a shuffle.

    Boosting uses all features at every node, so over many rows the smaller one of two children is counted and the other is
    what its parent leaves; the histograms of a round's nodes are kept for that.
    """
    with ThreadPoolExecutor(1) as ahead:
        for level in range(max((t.depth for t in trees), default=0)):
            todo = sorted((t for t in trees if len(t.open) and level < t.depth), key=lambda t: (-t.tree, -t.unit))

            def prepared() -> list[tuple]:
                """The trees of the next pass with the nodes to count and their features."""
                some, cells = [], 0
                while todo and (not some or cells < CELLS):
                    t = todo.pop()
                    k = max(1, round(p * units[t.unit].params.get("share", 1.0)))
                    at = _smaller(t) if t.halved and level else t.open
                    cells += len(at) * k * BINS
                    some.append((t, at, np.stack([_subset(seed, t.unit, t.tree, int(i), p, k) for i in at])))
                return some

            some = prepared()
            while some:
                growing, limits = [], []
                for t, at, slots in some:
                    active, first = None, (1 << level) - 1
                    if len(at) < 1 << level:
                        active = np.full(1 << level, -1, dtype=np.int64)
                        active[at - first] = np.arange(len(at))
                    growing.append((t.unit, t.tree, units[t.unit].params.get("bootstrap", False), Route(t.feature, t.cut, level), active, slots))
                    limits.append((slots, units[t.unit].params["min_leaf"], units[t.unit].params["min_split"]))
                shared = blocks.context.broadcast((growing, limits))
                boosting = some[0][0].tree < 0
                sums = blocks.mapPartitions(lambda it, c=shared, v=level, b=boosting: _histograms(it, c.value[0], v, fields) if b else _counted(it, c.value[0], v, seed))
                few = boosting and tasks * BINS * sum(slots.size for _, _, slots in some) <= CELLS
                if not few:
                    sums = sums.reduceByKey(np.add, min(len(some), partitions))
                following = ahead.submit(prepared)   # while this pass runs
                if boosting:
                    found: dict[int, np.ndarray] = {}
                    for g, h in sums.collect():
                        found[g] = found[g] + h if g in found else h
                    splits = {g: _whole(t, found[g], units[t.unit], *limits[g][1:]) for g, (t, _, _) in enumerate(some) if g in found}
                else:
                    splits = dict(sums.mapPartitions(lambda it, c=shared: [(g, h[:, :, 0].sum(-1)[:, 0], best_splits(h, *c.value[1][g])) for g, h in it]).map(lambda r: (r[0], r[1:])).collect())
                shared.destroy()
                for g, (t, _, _) in enumerate(some):
                    t.open = _apply(t, splits[g], level) if g in splits else np.zeros(0, dtype=np.int64)
                some = following.result()


def _smaller(t: _Tree) -> np.ndarray:
    """The child with fewer rows of every node that split; children stand in pairs."""
    left, right = t.open[::2], t.open[1::2]
    return np.where(t.cover[left] <= t.cover[right], left, right)


def _whole(t: _Tree, found: np.ndarray, unit: Unit, min_leaf: int, min_split: int) -> tuple[np.ndarray, np.ndarray]:
    """Root sums and splits of a level of boosting; the nodes' histograms stay with the tree where they split."""
    whole = found
    if len(t.open) == 1 and t.open[0] == 0:
        found[0, 0] = unit.tally
    elif t.halved:
        whole = np.empty((2, len(t.open), *found.shape[2:]))
        mine = (_smaller(t) != t.open[::2]).astype(np.int64) + 2 * np.arange(found.shape[1])
        whole[:, mine] = found
        whole[:, mine ^ 1] = t.sums - found
        whole[1][whole[0] == 0] = 0.0   # no rows, no sum
    p = whole.shape[2]
    splits = best_splits(whole, np.tile(np.arange(p), (whole.shape[1], 1)), min_leaf, min_split)
    t.sums = whole[:, splits[:, 0] >= 0] if t.halved else None
    return whole[:, :, 0].sum(-1)[:, 0], splits


def _apply(t: _Tree, found: tuple, level: int) -> np.ndarray:
    """Write a level's splits into a tree; its children that may split again."""
    root, s = found
    if level == 0:
        t.cover[0], t.value[0] = root[0], root[1] / root[0] if root[0] else 0.0
    split = s[:, 0] >= 0
    at, s = t.open[split], s[split]
    t.feature[at], t.cut[at], t.gain[at] = s[:, 0], s[:, 1], s[:, 2]
    for side, (n, total) in enumerate(((3, 4), (5, 6))):
        t.cover[2 * at + 1 + side], t.value[2 * at + 1 + side] = s[:, n], s[:, total] / s[:, n]
    return np.sort(np.concatenate([2 * at + 1, 2 * at + 2]))


def _add_tree(block: dict, trees: Sequence[tuple[int, Route, np.ndarray]], fields: Sequence[tuple[int, int, int]]) -> dict:
    """``trees``: (unit, route to the leaves, what each node adds)."""
    left = list(block["left"])
    for unit, route, value in trees:
        a, b = block["spans"][unit]
        if a < b:
            left[unit] = left[unit] - value.take(_Way(route, fields).reach(block["codes"], a, b))
    return {**block, "left": left}


def _forget(state: RDD) -> None:
    """Delete the checkpoint of a state that nothing is computed from any more."""
    path = state.getCheckpointFile()
    if path:
        delete(state.context, path)


def fit_units(df: DataFrame, target: str, features: Sequence[str], units: Sequence[tuple[int, int, Mapping]], kind: str = "random_forest", seed: int = 42,
              cuts: Sequence[np.ndarray] | None = None) -> list[TreeModel | None]:
    """One model for each (first ord, last ord, parameters); None where it has no rows.

    random_forest: ``trees`` bootstrapped trees (each row taken Poisson(1) times, by a hash of its values) of ``depth``, every
    node choosing among a ``share`` of the features, averaged (``bootstrap`` False: all rows once). gbt: ``rounds`` trees on the residuals, shrunk by ``rate``.
    ``min_leaf`` and ``min_split`` are rows. Rows with a null are left out. All units advance in the same passes; boosting
    takes one pass for each round and level, a forest one for each level and CELLS histogram cells.
    """
    if kind not in ("random_forest", "gbt"):
        raise ValueError(f"unknown tree model {kind!r}")
    features, boosting = list(features), kind == "gbt"
    p = len(features)
    own = [Unit(a, b, {**(BOOSTING if boosting else FOREST), **params}) for a, b, params in units]
    for u in own:
        unknown = set(u.params) - set(BOOSTING if boosting else FOREST)
        if unknown or u.params["depth"] < 1:
            raise ValueError(f"unknown parameters {sorted(unknown)} or depth below 1")
    if not own or not p:
        return [None] * len(own)
    edges = [np.asarray(c, dtype=float) for c in (cuts if cuts is not None else bin_edges(df, features))]
    table = blocks_of(df, target, features, edges, hashes=not boosting)
    sc, fields = df.sparkSession.sparkContext, code_fields(edges)
    spans = [(u.start, u.end) for u in own]
    blocks = table.count()
    parts, cores = table.rdd.getNumPartitions(), sc.defaultParallelism
    wanted = max(parts, min(blocks, cores)) if parts <= cores else min(blocks, cores * -(-parts // cores))   # all cores end at about the same time
    rows = table.rdd if wanted == parts else table.repartition(wanted).rdd
    state = (rows.map(lambda r: _load(r, fields, spans)) if boosting else rows.mapPartitions(lambda it: _pack(it, p, spans))).persist(StorageLevel.MEMORY_AND_DISK_DESER)
    partitions = max(1, min(cores, wanted, 2 if boosting else wanted))   # histograms of a boosting pass are few
    kept: list[RDD] = []
    try:
        if boosting:
            sums = state.flatMap(lambda b: [(i, np.array([e - a, b["left"][i].sum()])) for i, (a, e) in enumerate(b["spans"]) if e > a]).reduceByKey(np.add).collectAsMap()
            alive = [i for i in range(len(own)) if i in sums]
            for i in alive:
                own[i].base = float(sums[i][1] / sums[i][0])
            for i, tally in state.flatMap(lambda b: _tally(b, fields)).reduceByKey(np.add, partitions).collect():
                own[i].tally = tally
            start = {i: own[i].base for i in alive}
            first = state.map(lambda b: {**b, "left": [s - start.get(i, 0.0) for i, s in enumerate(b["left"])]}).persist(StorageLevel.MEMORY_AND_DISK_DESER)
            state, old = first, state
            for r in range(max((own[i].params["rounds"] for i in alive), default=0)):
                trees = [_Tree(i, -1, own[i].params["depth"], sums[i][0] >= HALVED) for i in alive if r < own[i].params["rounds"]]
                _grow(state, trees, own, p, seed, partitions, wanted, fields)
                while len(kept) > 1:   # the last one is written now
                    _forget(kept.pop(0))
                old.unpersist()
                old = state
                shared = sc.broadcast([(t.unit, Route(t.feature, t.cut, t.depth), own[t.unit].params["rate"] * t.value[settled(t.feature)]) for t in trees])
                state = state.map(lambda b, c=shared: _add_tree(b, c.value, fields)).persist(StorageLevel.MEMORY_AND_DISK_DESER)
                if r % 10 == 9:   # the lineage of a block stays short
                    if sc.getCheckpointDir() is None:
                        from ..session import shared_folder

                        sc.setCheckpointDir(shared_folder(df.sparkSession))
                    state.checkpoint()
                    kept.append(state)
                for t in trees:
                    t.sums = None
                    own[t.unit].trees.append(t)
            old.unpersist()
        else:
            trees = [_Tree(i, t, u.params["depth"]) for i, u in enumerate(own) for t in range(u.params["trees"])]
            _grow(state, trees, own, p, seed, partitions, wanted, fields)
            for t in trees:
                if t.cover[0]:
                    own[t.unit].trees.append(t)
    finally:
        state.unpersist()
        for one in kept:
            _forget(one)
        discard(table)
    out: list[TreeModel | None] = []
    for u in own:
        stack = [np.stack([getattr(t, a) for t in u.trees]) if u.trees else None for a in ("feature", "cut", "value", "cover", "gain")]
        if stack[0] is None:
            out.append(None)
        else:
            out.append(TreeModel(features, edges, u.base, u.params["rate"] if boosting else 1 / len(u.trees), *stack, kind))
    return out


def fit_trees(df: DataFrame, target: str, features: Sequence[str], kind: str = "random_forest", seed: int = 42, cuts: Sequence[np.ndarray] | None = None, **params) -> TreeModel | None:
    """One model on all rows of ``df``, whose order does not matter."""
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns if c != "ord"], F.lit(0).alias("ord"))
    return fit_units(rows, target, features, [(0, 0, params)], kind, seed, cuts)[0]
