"""Document fingerprints: a Merkle tree over sections, paragraphs and runs of words."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from hashlib import blake2b, sha256

import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import shuffle_partitions, slices

#: A leaf: at most 8 words up to the end of a sentence, white space around them included.
_LEAF = re.compile(rb"\s*(?:\S*[^\s.!?;:]\s+){0,7}\S+\s*")
_LINE = re.compile(rb"[^\n]*\n|[^\n]+")
#: (root, sections); a section is (digest, paragraphs), a paragraph (digest, leaf digests): hexadecimal, 64 bits, root 128.
Paragraph = tuple[str, tuple[str, ...]]
Section = tuple[str, tuple[Paragraph, ...]]
Tree = tuple[str, tuple[Section, ...]]


def _inner(children: list[str], level: int) -> str:
    """Digest of an inner node: of its children's digests in their order."""
    return xxhash.xxh3_64_hexdigest("".join(children), seed=level)


def tree(text: str) -> Tree:
    """The Merkle tree of a text. Every character belongs to one leaf: paragraphs are lines with their end, sections end
    with blank lines, and a paragraph without a word is one leaf. An empty text has no section."""
    sections: list[Section] = []
    own: list[Paragraph] = []
    blank = False
    for line in _LINE.findall(text.encode()):
        pieces = _LEAF.findall(line)
        if pieces and blank and own:   # blank lines close a section
            sections.append((_inner([p[0] for p in own], 2), tuple(own)))
            own = []
        blank = not pieces
        leaves = [xxhash.xxh3_64_hexdigest(x) for x in pieces or [line]]
        own.append((_inner(leaves, 1), tuple(leaves)))
    if own:
        sections.append((_inner([p[0] for p in own], 2), tuple(own)))
    return blake2b("".join([d for d, _ in sections]).encode(), digest_size=16).hexdigest(), tuple(sections)


def encode(t: Tree) -> str:
    """The fingerprint, all nodes: root/section:paragraph.leaves,paragraph.leaves;section:..."""
    return t[0] + "/" + ";".join([d + ":" + ",".join([f"{e}.{''.join(leaves)}" for e, leaves in ps]) for d, ps in t[1]])


def decode(fingerprint: str) -> Tree:
    root, _, rest = fingerprint.partition("/")
    sections = []
    for s in rest.split(";") if rest else ():
        digest, _, ps = s.partition(":")
        paragraphs = [(p[:16], tuple(p[i:i + 16] for i in range(17, len(p), 16))) for p in ps.split(",")]
        sections.append((digest, tuple(paragraphs)))
    return root, tuple(sections)


def _left_over(a: list, b: list) -> tuple[int, list, list]:
    """Leaves below the nodes that both lists have, matched by digest as often as they repeat, and the nodes left on either side."""
    spare = Counter(n[0] for n in b)
    spare.subtract(n[0] for n in a)
    extra = {d: -n for d, n in spare.items() if n < 0}   # only in a
    more = {d: n for d, n in spare.items() if n > 0}     # only in b
    shared, rest = 0, ([], [])
    for nodes, alone, out, count in ((a, extra, rest[0], True), (b, more, rest[1], False)):
        for node in nodes:
            if alone.get(node[0], 0):
                alone[node[0]] -= 1
                out.append(node)
            elif count:
                shared += _size(node)
    return shared, *rest


def _size(node) -> int:
    """Leaves below a section or paragraph."""
    return sum(len(p[1]) for p in node[1]) if node[1] and isinstance(node[1][0], tuple) else len(node[1])


def likeness(a: Tree, b: Tree) -> float:
    """Twice the share of leaves that two trees have in common (0 to 1), found by going down differing branches only.

    Equal roots are 1. A section, then a paragraph, whose digest both trees have counts with all its leaves, wherever it
    stands; what is left over on either side is opened and its leaves are matched as often as they repeat.
    """
    if a[0] == b[0]:
        return 1.0
    leaves = sum(_size(s) for s in a[1]) + sum(_size(s) for s in b[1])
    if not leaves:
        return 0.0
    shared, sa, sb = _left_over(list(a[1]), list(b[1]))
    same, pa_, pb = _left_over([p for s in sa for p in s[1]], [p for s in sb for p in s[1]])
    left = Counter(x for p in pa_ for x in p[1])
    shared += same + sum(min(n, left[x]) for x, n in Counter(x for p in pb for x in p[1]).items() if x in left)
    return min(1.0, 2.0 * shared / leaves)


def edits(fingerprint_a: str, fingerprint_b: str) -> list[tuple[str, tuple[int, ...] | None, tuple[int, ...] | None]]:
    """(kind, place in the first, place in the second) of what differs, by going down from the roots.

    A place is (section, paragraph, leaf), as deep as the branch that differs as a whole. Kinds: ``removed`` (no second
    place), ``added`` (no first) and ``moved``: a branch of one digest that both have at places out of order. Equal roots
    have no edits; branches of equal digests are never opened.
    """
    a, b = decode(fingerprint_a), decode(fingerprint_b)
    if a[0] == b[0]:
        return []
    gone, new = [], []

    def down(left: tuple, right: tuple, at: tuple, to: tuple) -> None:
        digest = [[n if isinstance(n, str) else n[0] for n in side] for side in (left, right)]
        for op, i, j, k, m in SequenceMatcher(None, *digest, autojunk=False).get_opcodes():
            if op == "equal":
                continue
            pairs = min(j - i, m - k) if not (left and isinstance(left[0], str)) else 0
            for n in range(pairs):   # branches in the same place: what differs is below
                if digest[0][i + n] in digest[1] or digest[1][k + n] in digest[0]:
                    gone.append((digest[0][i + n], (*at, i + n)))
                    new.append((digest[1][k + n], (*to, k + n)))
                else:
                    down(left[i + n][1], right[k + n][1], (*at, i + n), (*to, k + n))
            gone.extend((digest[0][n], (*at, n)) for n in range(i + pairs, j))
            new.extend((digest[1][n], (*to, n)) for n in range(k + pairs, m))

    down(a[1], b[1], (), ())
    places: dict[str, list] = {}
    for digest, place in new:
        places.setdefault(digest, []).append(place)
    out = []
    for digest, place in gone:
        to = places[digest].pop(0) if places.get(digest) else None
        out.append(("moved" if to is not None else "removed", place, to))
    return out + [("added", None, place) for rest in places.values() for place in rest]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint of every text; null counts as empty, repeated rows each have one, an empty table none."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([encode(tree(t or "")) for t in part.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    frame = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return frame.mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def with_next(docs: DataFrame, make: Callable, schema: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and what ``make(text, next text)`` gives, where the next document is that of the next higher doc_id.

    After the last comes the first; rows of one id follow each other by text, a null id comes last; a null text counts as
    empty; a single row is its own next. Ids are numbers, nearly unique. Documents are dealt once, to ranges of ids between
    approximate quantiles, one for each shuffle partition; the first document of each range goes, as a mark, to the range
    before as well. Only the bounds and first ids of the ranges reach the driver.
    """
    ranges = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    share = [i / ranges for i in range(1, ranges)] or [0.5]
    bounds = sorted(set(rows.agg(F.percentile_approx(F.col("doc_id").cast("double"), share, 10_000)).first()[0] or []))
    splits = Bucketizer(splits=[-math.inf, *(bounds or [0.0]), math.inf], inputCol="__at", outputCol="__range", handleInvalid="keep")
    last = len(bounds or [0.0])
    placed = splits.transform(rows.withColumn("__at", F.col("doc_id").cast("double"))).withColumn("__range", F.least(F.col("__range").cast("int"), F.lit(last)))
    heads = sorted((r[0], r[1]) for r in placed.select("__range", "doc_id").groupBy("__range").agg(F.min("doc_id")).collect() if r[1] is not None)
    before = [0] * (last + 1)
    for k, (place, _) in enumerate(heads):
        before[place] = heads[k - 1][0]
    own, mark = F.struct(F.col("__range").alias("place"), F.lit(0).alias("mark")), F.struct(F.element_at(F.lit(before), F.col("__range") + 1).alias("place"), F.lit(1).alias("mark"))
    sent = F.when(F.col("doc_id").isin([h for _, h in heads]), F.array(own, mark)).otherwise(F.array(own))
    dealt = placed.select("doc_id", "text", F.explode(sent).alias("__to")).select("doc_id", "text", F.col("__to.place").alias("place"), F.col("__to.mark").alias("mark"))
    ordered = dealt.repartitionById(last + 1, F.col("place")).sortWithinPartitions("mark", F.asc_nulls_last("doc_id"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], f"doc_id {kind}, {schema}").schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous, marked = None, False
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                out = []
                for i, t, is_mark in zip(*[part.column(c).to_pylist() for c in (0, 1, 2)]):
                    if marked:
                        break
                    if previous is not None:
                        out.append((previous[0], *make(previous[1], t)))
                    previous, marked = (i, t), bool(is_mark)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return ordered.select("doc_id", "text", "mark").mapInArrow(run, f"doc_id {kind}, {schema}")


def edited(text: str, following: str) -> str:
    """The text whose last half, rounded down, is replaced by the first as many code points of the next one."""
    n = len(text)
    return text[:n - n // 2] + following[:n // 2]


def compare_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    Null text counts as empty; see ``with_next`` for rows of one id, null ids and tables of one row or none.
    """
    def make(own: str, following: str) -> tuple:
        changed = edited(own, following)
        a, b, c = (encode_tree(t) for t in (own, changed, following))
        return len(own), sha256(changed.encode()).hexdigest(), a[0], b[0], likeness(a[1], b[1]), likeness(a[1], c[1])

    return with_next(docs, make, "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", doc_id, text)


@lru_cache(maxsize=4)
def encode_tree(text: str) -> tuple[str, Tree]:
    """Fingerprint and tree of a text; the next document's are wanted again at once."""
    t = tree(text)
    return encode(t), t
