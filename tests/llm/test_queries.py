"""Registered queries over the table with edge rows, against brute force or SQL; then over empty tables."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from panelmill.llm import merkle, registry
from panelmill.llm.tokens import word_bpe_path
from tests.llm.conftest import TABLES
from tests.oracle import compare

BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(word_bpe_path())
    t.no_truncation()
    t.no_padding()
    return t


def bag(rows):
    return Counter(map(tuple, rows))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, folder, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    if name == "op3_substring_dedup":   # the SQL groups by id: rows of one id, or without one, are tested below
        con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT DISTINCT doc_id, text FROM read_parquet('{folder}/documents.parquet/*.parquet') WHERE doc_id IS NOT NULL AND doc_id <> 9011")
        spark.read.parquet(f"{folder}/documents.parquet").where("doc_id is not null and doc_id <> 9011").dropDuplicates(["doc_id"]).write.mode("overwrite").parquet(f"{folder}/op3/documents.parquet")
        df = registry.QUERIES[name](spark, f"{folder}/op3")
    else:
        df = registry.QUERIES[name](spark, folder)
    n, diff = compare(df, con, registry.ORACLE[name])
    assert n and not diff, diff


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, empty_folder, name):
    assert registry.QUERIES[name](spark, empty_folder).collect() == []


def test_language(spark, folder, texts):
    rows = registry.op1_language_id(spark, folder).collect()
    assert bag((r["doc_id"],) for r in rows) == bag((d,) for d, _ in texts)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    for d, r in by.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    assert all(by[d]["lang_pred"] == "und" and by[d]["score"] == 0 for d in (9001, 9002, 9003, 9004))
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/documents.parquet").where("source like 'src%'").select("doc_id", "lang").collect()}
    held = [by[d]["lang_pred"] == lang for d, lang in truth.items() if by[d]["held_out"]]
    assert len(held) > 20 and np.mean(held) >= 0.95


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for k in range(64):
            ones[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * ones[k] > len(shingles))


def test_simhash(spark, folder, texts):
    fps = [slow_fingerprint(t) for _, t in texts]
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(texts):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    want = bag((d, f"{fps[i]:016x}", low.get(find(i))) for i, (d, _) in enumerate(texts))
    assert bag(registry.op2_simhash_dedup(spark, folder).select("doc_id", "fingerprint", "component_id").collect()) == want


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def slow_base(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15):
                out.append((m.start(), rank, m.end()))
    return sorted(out)


def test_personal_data(spark, folder, texts):
    got = registry.op4_personal_data(spark, folder).collect()
    want = []
    for d, t in texts:
        spans = slow_base(t or "")
        want.append((d, *[sum(s[1] == k for s in spans) for k in range(4)], hashlib.sha256(",".join(f"{BASE[r][0]}:{a}:{b}" for a, r, b in spans).encode()).hexdigest()))
    assert bag(tuple(r)[:6] for r in got) == bag(want)
    for r in got:
        base = [s for s in r["spans"].split(",") if s and not s.startswith("term:")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r["base_sha256"]


def test_main_text(spark, folder):
    rows = registry.op6_html_extraction(spark, folder).collect()
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "html").collect()
    assert bag((r["page_id"],) for r in rows) == bag((p["page_id"],) for p in pages)
    by = {r["page_id"]: r for r in rows}
    assert all(len(r["text"]) == r["n_chars"] for r in rows)
    assert (by[9001]["text"], by[9002]["text"], by[9003]["text"], by[9004]["text"]) == ("", "", "Fish & chips", "Only this")
    assert by[9008]["text"] == "\n".join(["word"] * 3000) and by[9009]["text"] == "one\ntwo"
    assert sum(r["page_id"] == 9003 for r in rows) == 2
    import html
    for p in pages:
        if p["page_id"] is not None and p["page_id"] < 9000:
            inner = re.search(r"<article>(.*?)(</article>|$)", p["html"], re.S)[1]
            blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"<p>|</p>|<h1>|</h1>", inner)]
            assert by[p["page_id"]]["text"] == "\n".join(b for b in blocks if b)


def test_merkle(spark, folder, texts):
    order = sorted(texts, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    want = []
    for k, (d, t) in enumerate(order):
        own, following = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(own)
        changed = own[:n - n // 2] + following[:n // 2]
        fps = [merkle.encode(merkle.tree(x)) for x in (own, changed, following)]
        near = [merkle.likeness(merkle.decode(fps[0]), merkle.decode(x)) for x in fps[1:]]
        want.append((d, n, hashlib.sha256(changed.encode()).hexdigest(), fps[0], fps[1], *near))
    got = registry.op7_merkle_fingerprint(spark, folder).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()
    assert bag(got) == bag(want)
    assert all(0 <= x <= 1 for r in got for x in r[5:])


def test_codec(spark, folder, texts, library):
    want = []
    for d, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert bag(registry.op8_bpe_codec(spark, folder).collect()) == bag(want)


def check_packing(rows, texts, library):
    """Every document's pieces hold its ids, and every sequence is gapless from 0 and within 4096 tokens."""
    ids = {t: [*library.encode(t or "", add_special_tokens=False).ids, 1] for _, t in texts}
    want = bag((d, k, 4096 * k, len(ids[t][4096 * k:4096 * (k + 1)]), zlib.crc32(np.array(ids[t][4096 * k:4096 * (k + 1)], "<u4").tobytes()))
               for d, t in texts for k in range(-(-len(ids[t]) // 4096)))
    assert bag((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= -(-total // 4096) + 1
    assert {type(r["doc_id"]) for r in rows if r["doc_id"] is not None} <= {int}


def test_packing(spark, folder, texts, library):
    check_packing(registry.op10_best_fit_packing(spark, folder).collect(), texts, library)


def test_substring_repeats(spark, folder, texts):
    """Rows of one id, and rows without one: rank is id (null first), then the text's digest; equal rows are one place."""
    rows = [(r["doc_id"], r["text"], r["n_removed"]) for r in registry.op3_substring_dedup(spark, folder).collect()]
    assert bag((d,) for d, _, _ in rows) == bag((d,) for d, _ in texts)
    assert_no_run_repeats({(d, t) for d, t, _ in rows})
    assert [r for r in rows if r[0] == 9007][0] == [r for r in rows if r[0] == 9007][1] and any(n for *_, n in rows)


def assert_no_run_repeats(rows, width=60):
    """No ``width`` words in a row that begin and end with a line stand twice."""
    seen = Counter()
    for _, t in rows:
        lines = [x.encode().lower().split() for x in (t or "").split("\n")]
        for i in range(len(lines)):
            run = []
            for line in lines[i:]:
                run += line
                if len(run) >= width:
                    seen[b" ".join(run)] += bool(lines[i])
                    break
    assert max(seen.values()) == 1


def test_pipeline(spark, folder, library):
    """Each stage on its own input: what it keeps, and what it changes, by brute force."""
    import corpus_pipeline as cp
    from panelmill.session import settle

    docs, before = spark.read.parquet(f"{folder}/documents.parquet"), None
    for name, stage in cp.STAGES:
        out = settle(stage(spark, docs, folder))
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        if name != "pack":
            assert out.columns == docs.columns and all(r[0] == "clash" for c in out.columns[5:] for r in out.select(f"`{c}`").distinct().collect())
            after = [(r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()]
        if name == "language":
            assert bag(after) == bag(r for r in rows if r[1] and any(c.isalpha() for c in r[1]))
        elif name == "near_duplicates":
            fps = [slow_fingerprint(t) for _, t in after]
            assert all((a ^ b).bit_count() > 3 for i, a in enumerate(fps) for b in fps[:i])
            kept = set(fps)
            assert set(after) <= set(rows) and all(d is None or any(e == d for e, _ in after) or any((slow_fingerprint(t) ^ slow_fingerprint(u)).bit_count() <= 3 for e, u in rows if e != d) for d, t in rows) and kept
        elif name == "repeated_lines":
            assert len(after) == len(rows) and set(d for d, _ in after) == set(d for d, _ in rows)
            assert_no_run_repeats(after)
        elif name == "personal_data":
            assert len(after) == len(rows) and not any(slow_base(t) for _, t in after) and any(slow_base(t) for _, t in rows)
        else:
            check_packing(out.collect(), rows, library)
            before = bag(out.drop("sequence_id", "offset").collect())
        docs = out
    assert bag(cp.run(spark, folder).drop("sequence_id", "offset").collect()) == before
