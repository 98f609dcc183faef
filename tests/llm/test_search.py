"""Hard negatives, ranked search and toxicity against brute force, and the work that their bounds save."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.llm import dualtree, negatives, registry, toxicity
from panelmill.session import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def slow_negatives(rows, positives=5, wanted=3):
    """rows: {id: (label, vector)} of whole numbers."""
    out = set()
    score = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b))
    for a, (label, v) in rows.items():
        if a % 50:
            continue
        others = sorted((-score(v, w), i, lab) for i, (lab, w) in rows.items() if i != a)
        for p, positive, _ in [x for x in others if x[2] == label][:positives]:
            hard = [(s, i) for s, i, lab in others if lab != label and 50 * -p <= 100 * -s <= 95 * -p][:wanted]
            out |= {(a, positive, r + 1, i, -p, -s) for r, (s, i) in enumerate(hard)}
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) / 256 for x in v], lab) for i, (lab, v) in rows.items()], "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize("top, kind", [(90, np.float32), (60_000, np.float64), (1 << 30, np.int64)])
def test_hard_negatives_equal_brute_force(spark, top, kind):
    rng = np.random.default_rng(top)
    rows = {int(i): (int(rng.integers(3)), rng.integers(-3, 4, 4) * (top // 3)) for i in range(0, 700, 5)}   # many ties
    rows[350] = (1, np.zeros(4, dtype=int))   # an anchor that scores zero with all
    rows[400] = (77, np.ones(4, dtype=int))   # alone with its label
    assert negatives.exact_kind(top, 4) is kind
    found = {tuple(r) for r in negatives.mine(vectors(spark, rows)).collect()}
    assert found == slow_negatives(rows) and found


def test_hard_negatives_over_many_stripes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = {i: (int(rng.integers(2)), rng.integers(-40, 41, 6)) for i in range(400)}
    rows |= {i: (0, np.full(6, 20)) for i in range(400, 600)}   # a third are copies
    want = slow_negatives(rows)
    for name, value in (("CANDIDATES", 64), ("ANCHORS", 3), ("RUN", 16)):
        monkeypatch.setattr(negatives, name, value)
    assert {tuple(r) for r in negatives.mine(vectors(spark, rows)).collect()} == want


def test_repeated_and_unfit_vectors(spark):
    rows = [(0, [0.5, 0.5], 1), (0, [0.5, 0.5], 1), (1, [0.5], 1), (2, [0.4, 0.2], 2), (3, [0.5, 0.5], None), (None, [0.5, 0.5], 2), (4, [float("nan"), 1.0], 2), (5, None, 2), (6, [None, 1.0], 2), (50, [], 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("score", F.lit("clash")).withColumn("anchor_id", F.lit(7))
    of_50 = {(50, 2, 1, 0, 0, 0), (50, 2, 2, 1, 0, 0)}   # its vector is empty, so all scores are 0
    assert {tuple(r) for r in negatives.mine(table).collect()} == of_50   # 1 scores 16384 with 0, 2 scores 19584: above the window
    more = spark.createDataFrame([(7, [0.25, 0.1], 3)], "vec_id long, embedding array<double>, label int").withColumn("score", F.lit("clash")).withColumn("anchor_id", F.lit(7))
    assert {tuple(r) for r in negatives.mine(table.unionByName(more)).collect()} == of_50 | {(0, 1, 1, 7, 16384, 128 * 64 + 128 * 25), (50, 2, 3, 7, 0, 0)}


def test_threshold_stops_early():
    """Dimensions of falling weight: few rows are looked at, and the result is that of all rows."""
    rng = np.random.default_rng(5)
    n = 8_192
    v = np.floor(rng.standard_exponential((n, 3)) * np.array([90, 4, 2])).astype(np.int64)
    ids, labels = np.arange(n) * 3, rng.integers(0, 2, n)
    run = negatives.Run(ids, labels, v, negatives.exact_kind(int(abs(v).max()), 3))
    a = v[:64]
    low, high = np.full((64, 1), negatives._NONE + 1), np.full((64, 1), np.iinfo(np.int64).max)
    tops = negatives.Tops(low, high, 5)
    negatives.COUNTS["totals"] = 0
    negatives.threshold_search(run, ids[:64], labels[:64], a, tops, True)
    assert negatives.COUNTS["totals"] < 64 * n / 4
    total = a @ v.T
    for i in range(64):
        order = sorted((-total[i, j], ids[j]) for j in range(n) if j != i and labels[j] == labels[i])[:5]
        assert [(-s, d) for s, d in zip(tops.score[i, 0], tops.id[i, 0])] == order
    # a second run whose lists are all below what is known is left alone
    weak = negatives.Run(ids + 1, labels, v // 100, run.v.dtype.type)
    negatives.COUNTS["totals"] = 0
    negatives.threshold_search(weak, ids[:64], labels[:64], a, tops, True)
    assert negatives.COUNTS["totals"] < 64 * n / 4


TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def slow_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_ranking(docs, items, k=10):
    """[(item_id, rank, doc_id, score)] for documents and items given as (id, text)."""
    import math

    tfs = [(d, Counter(slow_terms(t))) for d, t in docs]
    tfs = [(d, c, c.total()) for d, c in tfs if c]
    count, length = len(tfs), sum(n for *_, n in tfs)
    df = Counter(t for _, c, _ in tfs for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        terms = slow_terms(text)
        found = []
        for d, c, n in tfs:
            m = 25 + (75 * n * count) // length
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def test_search_equals_brute_force(spark, folder, texts, monkeypatch):
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    want = Counter(slow_ranking(texts, items))
    assert Counter(tuple(r) for r in registry.op12_ranked_search(spark, folder).collect()) == want
    monkeypatch.setattr(dualtree, "ROUND", 150)   # several rounds of items
    assert Counter(tuple(r) for r in registry.op12_ranked_search(spark, folder).collect()) == want


def test_search_prunes_batches():
    """Sixteen vocabularies that do not meet: most leaf pairs are never scored."""
    rng = np.random.default_rng(2)
    docs = np.zeros((512, 96))
    for i in range(512):
        docs[i, rng.choice(6, 4, replace=False) + 6 * (i % 16)] = rng.integers(1, 1000, 4)
    items = np.zeros((32, 96))
    for i in range(32):
        items[i, rng.choice(6, 3, replace=False) + 6 * (i % 16)] = rng.integers(1, 50, 3)
    ids, best = np.arange(512) * 7 % 512, dualtree.Best(32, 3)
    tree = dualtree.Tree(items)
    dualtree.COUNTS.update(formed=0, pairs=0)
    for part in (slice(0, 200), slice(200, 512)):
        dualtree.search(tree, dualtree.Tree(docs[part]), ids[part], best)
    assert dualtree.COUNTS["formed"] < dualtree.COUNTS["pairs"] / 2
    score = (items @ docs.T).astype(int)
    for r, i in enumerate(tree.order):
        want = sorted((-score[i, j], ids[j]) for j in range(512) if score[i, j] > 0)[:3]
        assert [(-s, d) for s, d in zip(best.score[r], best.id[r]) if s] == want


def slow_features(text):
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", text)
    words = [w.lower() for w in words]
    return Counter(words) + Counter(zip(words, words[1:])) + Counter(("skip", *x) for x in zip(words, words[2:]))


def test_features_are_words_pairs_and_skips():
    texts = [b"", b"One two\tTWO three", "\u00e4 \u00c4-x".encode(), b" . ", b"one two two three", b"three", b"w" * 3000 + b" one"]
    row, bucket = toxicity.features(texts)
    for i, t in enumerate(texts):
        assert sorted(Counter(bucket[row == i].tolist()).values()) == sorted(slow_features(t).values())
    assert sorted(bucket[row == 1]) == sorted(bucket[row == 4])
    alone = [np.sort(toxicity.features([t])[1]) for t in texts]
    assert all((np.sort(bucket[row == i]) == a).all() for i, a in enumerate(alone))


def slow_ftrl(rows, label, width, epochs, alpha, beta, l1, l2, batch, balance, seed=1):
    z, n = [0.0] * (width + 1), [0.0] * (width + 1)

    def weight(i):
        t = 0.0 if i == width else l1
        return 0.0 if abs(z[i]) <= t else -(z[i] - (t if z[i] > 0 else -t)) / ((beta + n[i] ** 0.5) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        deal = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            g, w = Counter(), {}
            for r in deal[at:at + batch]:
                x = [*rows[r], width]
                w |= {i: weight(i) for i in x}
                p = 1 / (1 + np.exp(-sum(w[i] for i in x)))
                for i in x:
                    g[i] += (p - label[r]) * (balance if label[r] else 1)
            for i in w:
                step = ((n[i] + g[i] ** 2) ** 0.5 - n[i] ** 0.5) / alpha
                z[i] += g[i] - step * w[i]
                n[i] += g[i] ** 2
    return [weight(i) for i in range(width + 1)]


def test_ftrl_equals_the_rule():
    rng = np.random.default_rng(4)
    rows = [sorted(rng.choice(12, rng.integers(0, 5), replace=False).tolist()) for _ in range(60)]
    label = np.array([float(3 in r or 5 in r) for r in rows])
    row = np.repeat(np.arange(60), [len(r) for r in rows])
    column = np.array([i for r in rows for i in r])
    w, bias = toxicity.ftrl(row, column, label, 12, 7, 0.5, 1.0, 9.0, 0.01, 4, 3.0)
    assert np.allclose([*w, bias], slow_ftrl(rows, label, 12, 7, 0.5, 1.0, 9.0, 0.01, 4, 3.0))
    assert (w == 0).any() and w[3] > 0 and w[5] > 0


def test_toxicity_of_edge_rows(spark, folder, texts):
    rows = registry.op13_toxicity(spark, folder).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in texts)
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 0)
    empty = {r["score"] for r in rows if r["doc_id"] in (9001, 9002, 9003)}
    assert len(empty) == 1


def test_toxicity_held_out(spark):
    """Half of the planted words are taught in each language; held-out accuracy of toxic and clean documents."""
    rng = np.random.default_rng(6)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(900)]
    bad = [f"{x}vile" for x in vocabulary[:12]]
    rows = []
    for i in range(3_000):
        words = rng.choice(vocabulary, rng.integers(5, 80)).tolist()
        toxic = i % 8 == 0
        for w in rng.choice(bad, 2) if toxic else ():
            words.insert(int(rng.integers(len(words))), str(w))
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert np.mean([p for p, y in held if y]) >= 0.9 and np.mean([not p for p, y in held if not y]) >= 0.95
    # what is held out teaches nothing
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, turned).collect()}
    assert again == {i: r["score"] for i, r in got.items()}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, None)], [(None, 1)]):
        rows = toxicity.score_documents(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert [r["score"] for r in rows] == [0.5, 0.5]
