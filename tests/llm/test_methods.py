"""The operators' methods on planted cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.llm import bpe, langid, merkle, packing, pii, simhash, substring, topk, wrapper
from panelmill.llm.common import maybe_in
from panelmill.llm.tokens import encoder, word_bpe_path
from panelmill.session import ship
from tests.oracle import DATA


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def test_language_pieces_and_batches_agree(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcdefghijäöüß") for _ in range(rng.randint(1, 9))) for _ in range(n)) for n in (0, 1, 5, 60, 400)]
    logp = np.log(np.random.default_rng(1).random((2, 1 << 10)) + 0.1)
    model = {"labels": ["a", "b"], "logp": np.hstack([logp, np.zeros((2, 1))]), "prior": np.log([0.5, 0.5]), "orders": (1, 2, 3), "bits": 10}
    whole, _ = langid.scores(model, texts)
    single = np.vstack([langid.scores(model, [t])[0] for t in texts])
    monkeypatch.setattr(langid, "PIECE", 50)
    pieces, _ = langid.scores(model, texts)
    assert np.allclose(whole, single) and np.allclose(whole, pieces)


def test_too_many_languages(spark):
    docs = spark.createDataFrame([(f"t{i} word", f"l{i}") for i in range(6)], "text string, lang string")
    with pytest.raises(ValueError):
        langid.fit(docs, max_labels=5)


def test_languages_chosen(spark):
    """The prediction decides: languages that are not asked for go, as do texts that no language claims."""
    words = {"en": "the and with this that", "de": "der und mit das nicht", "fr": "le et avec ce pas"}
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(words[lang].split(), k=12)), lang) for i in range(90) for lang in [("en", "de", "fr")[i % 3]]]
    rows += [(100, "the der", None), (101, "123", "en"), (102, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    assert {r["doc_id"] for r in langid.in_a_language(docs).collect()} >= set(range(90)) and langid.in_a_language(docs).where("doc_id > 100").count() == 0
    kept = langid.in_a_language(docs, ["de", "fr"]).collect()
    assert {r["doc_id"] for r in kept} - {100} == {i for i in range(90) if i % 3} and {r["score"] for r in kept} == {"clash"}
    sure = {r["doc_id"] for r in langid.in_a_language(docs, min_score=1.0).collect()}
    assert 100 not in sure


def test_tie_of_representatives(spark):
    rows = [(1, "one text of some words here", "b"), (1, "one text of some words here", "a"), (2, "one text of some words here", "0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key string")
    assert [tuple(r) for r in simhash.representatives(docs).collect()] == [(1, "one text of some words here", "a")]


def test_tiles_find_every_link(monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base.copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, near]))
    monkeypatch.setattr(simhash, "BLOCK", 16)
    order = np.lexsort((*simhash._quarters(fp).T[::-1],))
    u, v = simhash.compare(fp[order], fp[order], 3, True)
    a, b = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3, 1))
    want = simhash.forest(fp[a], fp[b])
    assert set(zip(*want)) == set(zip(u, v))


def test_long_chain_is_one_component(spark):
    """Fingerprints of one bit, two bits and so on: each 1 bit from the next, ends 60 bits apart."""
    chain = [(1 << k) - 1 for k in range(61)] + [0x5555_5555_0000_0000]
    links = simhash.links(spark.createDataFrame([(x,) for x in chain], "fp long"), 1)
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert {roots[x] for x in chain[:-1]} == {0} and chain[-1] not in roots


def test_simhash_writes_small_tables_as_few_files(spark, monkeypatch):
    """Every file costs its executor processes, so the tables of few rows are not one file for each shuffle partition."""
    files = []

    def settle(table):
        out = real(table)
        files.append(len(out.inputFiles()))
        return out

    real = simhash.settle
    monkeypatch.setattr(simhash, "settle", settle)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{w}" for w in rng.integers(0, 5000, 30)) for _ in range(300)]
    texts += [f"{t} w0" for t in texts[:40]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert simhash.near_duplicates(docs).count() == 340
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len(files) > 5 and max(files[1:]) <= 2   # the first holds the documents' fingerprints


def test_group_of_copies_is_one_node(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text of a few words").otherwise(F.concat(F.lit("text no "), F.md5(F.col("id").cast("string")))).alias("text"))
    rows = simhash.near_duplicates(docs).where("doc_id % 3 = 0").select("component_id").distinct().collect()
    assert [r[0] for r in rows] == [0]
    assert simhash.representatives(docs).where("doc_id % 3 = 0").count() == 1


def test_passage_inside_other_sentences(spark):
    """The same passage in the middle of three texts: the first place stays, the others lose all but the sentences they share."""
    words = [f"w{i}" for i in range(70)]
    passage = " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words)) + "."
    line = "A line of boilerplate that every page has at its end"
    rows = [(i, f"Some {x} words before {passage} and {x} words after. The end.\n{line}\n{line} {x}") for i, x in ((1, "red"), (2, "blue"), (3, "green"))]
    rows += [(4, None), (5, ""), (6, passage.upper() + " " + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed", F.lit("clash")).withColumn("spans", F.lit(1))
    got = {r["doc_id"]: r for r in substring.deduplicate(docs).collect()}
    assert got[1]["text"] == rows[0][1] and got[1]["removed"] == []
    for i in (2, 3):
        (span,) = got[i]["removed"]
        text = rows[i - 1][1]
        assert got[i]["text"] == text[:span["start"]] + text[span["end"]:]
        gone = text[span["start"]:span["end"]].split()
        assert gone[0] == "w9" and gone[-1] == "w62." and line in got[i]["text"]
    assert got[4]["text"] is None and got[4]["removed"] == [] and got[5]["text"] == ""
    ends = [" ".join(words[:9]) + ".", " ".join(words[63:]) + "."]   # of other units than in 1 to 3
    assert got[6]["text"].split() == " ".join([*ends, ends[1]]).replace("w", "W", 16).split()
    stage = {r["doc_id"]: r for r in substring.cut_texts(docs).collect()}
    assert all(stage[i]["text"] == got[i]["text"] and stage[i]["removed"] == "clash" and stage[i]["spans"] == 1 for i in got)


def test_bit_table_misses_no_member(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("mark"), "id")
    members = rows.where("id % 50 = 0").select("mark")
    got = maybe_in(rows, "mark", members)
    assert got.where("id % 50 = 0 and not maybe").count() == 0 and got.where("id % 50 > 0 and maybe").count() < 20
    assert maybe_in(rows, "mark", members, bits=15).where("id % 50 = 0 and not maybe").count() == 0
    assert maybe_in(rows, "mark", members.where("false")).where("maybe").count() == 0


def test_lines_alone(spark):
    docs = spark.createDataFrame([(1, "one two. three four five\nsix"), (2, "begin\nOne  two. three FOUR five\nend")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in substring.deduplicate(docs, boundary="\n", min_words=5, min_run=5).collect()}[2] == "begin\nend"


@pytest.mark.parametrize("seed", range(4))
def test_units_and_runs(seed):
    """Units against windows counted one by one; every repeated run that goes is found earlier."""
    rng = random.Random(seed)
    text = "".join(rng.choice(["ab ", "C. ", "d, ", "..", "\n", " ", "é! ", "\u00a0x "]) for _ in range(300))
    parts = substring.fragments(text)
    assert "".join(parts) == text
    want, at = [], 0
    for i, p in enumerate(parts):
        own = [q.encode().lower().split() for q in parts[i:]]
        for j in range(len(own)):
            if own[0] and sum(map(len, own[:j + 1])) >= 8:
                before = sum(len(q.encode().split()) for q in parts[:i])
                want.append((at, at + sum(map(len, parts[i:i + j + 1])), before, before + sum(map(len, own[:j + 1])), b" ".join(w for ws in own[:j + 1] for w in ws)))
                break
        at += len(p)
    assert list(substring.units_of(text)) == want and want


def test_special_tokens_in_either_case():
    """A special token is one only in its own case; words around it, and texts beside it, are as the library has them."""
    enc = encoder(word_bpe_path())
    texts = ["a <|endoftext|> b", "a <|ENDOFTEXT|> b", "<|EndOfText|>", "<|startoftext|>X<|STARTOFTEXT|>", "Stop. Word, word.. x…, e.\nÉté, ça. ", "", "It's, 1.5. <| END."]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert enc.encode([t.encode() for t in texts]) == want
    assert [enc.encode([t.encode()])[0] for t in texts] == want
    assert 49407 in np.frombuffer(want[0], "<u4") and 49407 not in np.frombuffer(want[1], "<u4")


def test_disclosing_terms_are_found(spark):
    """A nickname that stands only beside one address discloses it; a common word does not; a single context is no evidence."""
    rows = [(i, f"Filler{i} thing with zorbulax wrote from zor@mail.example.com about matter{'abcdefgh'[i]} again") for i in range(7)]
    rows += [(7, "A last thing with zorbulax wrote from zor@mail.example.com about matterh. " + "Other words follow here in between. " * 9 + "So said ZORBULAX once more, not zorbulaxes")]
    rows += [(100 + i, "people wrote about the weather again and again with many words") for i in range(60)]
    rows += [(300 + i, "copied quuxword once@mail.example.com here") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("term", F.lit("clash"))
    found = {r["doc_id"]: r for r in pii.detect(docs).collect()}
    assert len(found) == len(rows)
    for i in range(8):
        text = rows[i][1]
        terms = {text[s["start"]:s["end"]] for s in found[i]["all_spans"] if s["rank"] == 4}
        assert "zorbulax" in terms and "wrote" not in terms and "again" not in terms
    assert not any(s["rank"] == 4 for i in range(5) for s in found[300 + i]["all_spans"])
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "zorbulax" not in clean[0] and "[EMAIL]" in clean[0] and "[TERM]" in clean[0] and clean[100] == rows[8][1]
    assert "A last thing with [TERM]" in clean[7] and clean[7].endswith("So said [TERM] once more, not zorbulaxes")   # wherever it stands


def test_wrapper_learns_a_menu_from_other_pages(spark):
    """Links that repeat are a menu on every page of the host, also where a page has one link only; optional parts align."""
    def page(links, note, body):
        menu = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in links)
        return f'<body><ul class="zz">{menu}</ul>{"<div class=notice>" + note + "</div>" if note else ""}<div class="q">{"".join(f"<p>{b}</p>" for b in body)}</div></body>'

    rows = [(1, "http://h/1", page("abc", "", ["First text", "second"])), (2, "http://h/2", page("a", "Sale", ["Other text"])), (3, "http://h/3", page("ab", "", ["x &lt; y", "z", "u"]))]
    got = {r["page_id"]: r["text"] for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "First text\nsecond", 2: "Other text", 3: "x < y\nz\nu"}


def test_wrapper_matches_optional_and_repeated():
    a, b = wrapper.skeleton(wrapper.parse("<div><b>x</b><p>1</p><p>2</p></div>")), wrapper.skeleton(wrapper.parse("<div><p>1</p><i>y</i></div>"))
    (div,) = wrapper.merge(a, b)
    kinds = {n[0]: tuple(n[1:3]) for n in div[3]}
    assert kinds["p"] == (1, wrapper.MANY) and kinds["b"] == (0, 1) and kinds["i"] == (0, 1)


def anonymous(page):
    """The page with no telling tag and no class, id or role."""
    return re.sub(r'\s(class|id|role)="[^"]*"', "", re.sub(r"<(/?)(article|nav|footer|header|aside|main)\b", r"<\1div", page))


def test_wrapper_finds_main_text_without_telling_names(spark):
    """All pages of hosts with three pages or more come out the same; a lone page whose article is no longer than its advert may not."""
    pages = spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").select("page_id", "url", "html")
    rows = pages.withColumn("host", wrapper.host_of(F.col("url"))).collect()
    bare = spark.createDataFrame([(r["page_id"], r["url"], anonymous(r["html"])) for r in rows], pages.schema)
    want = {r["page_id"]: r["text"] for r in wrapper.main_text(pages).collect()}
    got = {r["page_id"]: r["text"] for r in wrapper.main_text(bare).collect()}
    hosts = Counter(r["host"] for r in rows)
    assert sum(hosts[r["host"]] >= 3 for r in rows) > 100
    assert all(got[r["page_id"]] == want[r["page_id"]] for r in rows if hosts[r["host"]] >= 3)
    assert sum(got[k] == want[k] for k in want) >= 0.95 * len(want)
    assert all(wrapper.extract(r["html"], None) != want[r["page_id"]] for r in rows)   # without wrappers nothing is left out


def test_wrapper_drops_what_a_host_repeats(spark):
    """A bare notice with the same text on all pages is no main text, a heading with the same text is; a copy of a page changes nothing."""
    def page(k):
        body = "".join(f"<p>Paragraph {k} {j} with words of its own</p>" for j in range(1 + k % 4))
        return f"<body><div>Welcome to this place</div><div><h1>Title {k}</h1><h2>Part</h2><div>Please tell your friends</div>{body}</div><div>Made by us, all of us, {k}</div></body>"

    rows = [(k, "http://h/", page(k % 9)) for k in range(10)]
    got = {r["page_id"]: r["text"] for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(10):
        j = k % 9
        assert got[k] == "\n".join([f"Title {j}", "Part", *[f"Paragraph {j} {i} with words of its own" for i in range(1 + j % 4)]])


def test_chrome_is_told_at_any_depth():
    for depth in (1, 140, 149, 150, 151, 400, 3000):
        page = "<div>" * depth + "<nav><div>menu</div></nav><p>one <b>bold</b><br>text</p><p>two</p><form>ask <b>me</b></form>" + "</div>" * depth + "<p>last</p>"
        tree = wrapper.unpack(wrapper.roles(wrapper.skeleton(wrapper.parse(page)), []))
        assert wrapper.extract(page, tree) == "one bold text\ntwo\nlast", depth


def test_longest_common_is_longest_at_any_length():
    rng = random.Random(4)
    for _ in range(300):
        x, y = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                best[i + 1][j + 1] = best[i][j] + 1 if x[i] == y[j] else max(best[i][j + 1], best[i + 1][j])
        pairs = wrapper.longest_common(x, y)
        assert len(pairs) == best[-1][-1] and all(x[i] == y[j] for i, j in pairs)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:]))
    many = [str(i) for i in range(3000)]
    assert len(wrapper.longest_common(many, many[::2])) == 1500


def slow_tree(text):
    """Sections of paragraphs of leaves as texts, cut character by character."""
    paragraphs = [p for p in (x + "\n" for x in text.split("\n")[:-1])] + ([text.split("\n")[-1]] if text.split("\n")[-1] else [])
    sections = []
    for k, p in enumerate(paragraphs):
        leaves, word, count = [""], "", 0
        for i, c in enumerate(p):
            space, begins = c in " \t\n\r\x0b\x0c", i and p[i - 1] in " \t\n\r\x0b\x0c"
            if not space and begins and word and (count == 8 or word[-1] in ".!?;:"):
                leaves.append("")
                count = 0
            if not space and (begins or not i):
                count += 1
                word = ""
            if not space:
                word += c
            leaves[-1] += c
        if not k or p.strip(" \t\n\r\x0b\x0c") and not paragraphs[k - 1].strip(" \t\n\r\x0b\x0c"):
            sections.append([])
        sections[-1].append(leaves)
    return sections


@pytest.mark.parametrize("seed", range(30))
def test_merkle_nodes_hash_their_children(seed):
    """Digests of leaves, paragraphs, sections and root by definition; the fingerprint reads back."""
    import hashlib

    import xxhash

    rng = random.Random(seed)
    text = "".join(rng.choice(["ab", "C.", "é!", " ", "  ", "\n", "\n\n", "x y ", ";", "a.b ", "\t"]) for _ in range(rng.randint(0, 120)))
    cut = slow_tree(text)
    assert "".join(x for s in cut for p in s for x in p) == text
    root, sections = merkle.tree(text)
    digest = lambda parts, level: xxhash.xxh3_64_hexdigest("".join(parts), seed=level)
    for (sd, ps), s in zip(sections, cut, strict=True):
        for (pd, leaves), p in zip(ps, s, strict=True):
            assert list(leaves) == [xxhash.xxh3_64_hexdigest(x.encode()) for x in p] and pd == digest(leaves, 1)
        assert sd == digest([p[0] for p in ps], 2)
    assert root == hashlib.blake2b("".join(s[0] for s in sections).encode(), digest_size=16).hexdigest()
    assert merkle.decode(merkle.encode((root, sections))) == (root, sections)
    assert merkle.likeness((root, sections), merkle.tree(text)) == 1.0


def test_merkle_tree_locates_edits():
    lines = ["One line here.", "Another line of more than eight words that is two leaves long", "", "Second section.", "Its last line."]
    text = "\n".join(lines)
    mark = lambda other: merkle.edits(merkle.encode(merkle.tree(text)), merkle.encode(merkle.tree(other)))
    near = lambda other: merkle.likeness(merkle.tree(text), merkle.tree(other))
    assert mark(text) == [] and near(text) == 1.0
    word = text.replace("two leaves", "both leaves")
    assert mark(word) == [("removed", (0, 1, 1), None), ("added", None, (0, 1, 1))] and near(word) == pytest.approx(10 / 12)
    blanks = text.replace("section.", "section.  ")
    assert mark(blanks) == [("removed", (1, 0, 0), None), ("added", None, (1, 0, 0))] and near(blanks) < 1
    swapped = "\n".join([lines[1], lines[0], *lines[2:]])
    assert near(swapped) == 1.0 and merkle.tree(swapped)[0] != merkle.tree(text)[0]
    assert {k for k, *_ in mark(swapped)} == {"moved"} and len(mark(swapped)) == 1
    longer = text + "\n\nA third section."
    assert ("added", None, (2,)) in mark(longer) and near(longer) < 1
    assert mark("") == [("removed", (0,), None), ("removed", (1,), None)] and near("") == 0.0


def test_chunks_are_content_defined():
    rng = random.Random(3)
    shared = " ".join(rng.choice(("alpha", "beta", "gamma", "delta", "eps")) + str(rng.randint(0, 999)) for _ in range(2000)).encode()
    a, b = bpe.split(shared), bpe.split(b"another beginning, " + shared)
    assert len(set(a[0]) & set(b[0])) >= len(a[0]) - 2 > 5
    for text in (shared, b"", b"x" * 5000, b" " * 3000):
        bodies, joins = bpe.split(text)
        assert b"".join([x for k, y in enumerate(bodies) for x in ((y, joins[k]) if k < len(joins) else (y,))]) == text


def test_chunk_dictionary_and_repair(spark):
    """Shared chunks are encoded once; ids agree with the library whatever the dictionary holds."""
    rng = random.Random(5)
    shared = " ".join("".join(rng.choice("abcdefg'é1-") for _ in range(rng.randint(1, 9))) for _ in range(1500))
    docs = spark.createDataFrame([(i, f"intro {i} {shared} outro {i}") for i in range(6)] + [(7, None)], "doc_id long, text string")
    path = word_bpe_path()
    assert bpe.build_dictionary(docs, path)
    library = encoder(path).tokenizer
    for r, t in zip(bpe.encode(docs, path).orderBy("doc_id").collect(), [r["text"] for r in docs.orderBy("doc_id").collect()]):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == library.decode(want, skip_special_tokens=False)


def test_best_fit_is_the_tightest():
    rng = random.Random(2)
    lengths = sorted((rng.randint(1, 64) for _ in range(500)), reverse=True)
    bins, offsets = packing.best_fit(lengths, 64)
    left: list[int] = []
    for n, b, o in zip(lengths, bins, offsets):
        fits = [c for c in left if c >= n]
        if b == len(left):
            assert not fits
            left.append(64)
        assert left[b] == (min(fits) if fits else 64) and o == 64 - left[b]
        left[b] -= n
    assert packing.best_fit([], 64) == ([], [])


def test_pack_repeated_rows(spark):
    pieces = spark.createDataFrame([(1, 3)] * 10 + [(2, 10)], "doc_id long, length long").withColumn("start", F.lit("clash"))
    rows = packing.pack(pieces, 10).collect()
    assert len(rows) == 11 and len({r["sequence_id"] for r in rows}) == 5


@pytest.mark.parametrize("block", [7, 4096])
def test_top_k_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "CANDIDATES", block)
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk, "RUN_C", 5)
    monkeypatch.setattr(topk, "RUN_Q", 2)
    rng = np.random.default_rng(4)
    v = rng.integers(-3, 4, (60, 5))
    docs = spark.createDataFrame([(i, [float(x) / 64 for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(docs, k=6, every=4).orderBy("query_id", "rank").collect()]
    want = []
    for q in range(0, 60, 4):
        best = sorted((-int(v[q] @ v[c]), c) for c in range(60) if c != q)[:6]
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    assert got == want


def test_cutoffs_leave_most_totals_unformed():
    """Clusters: after the first lists few entries can reach the cutoff, and far runs are left out as a whole."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 32)) * 60
    v = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 32)) * 6).astype("<i2")
    ids, q = np.arange(4000), v[::100]
    score = q.astype(int) @ v.astype(int).T
    score[np.arange(40), np.arange(0, 4000, 100)] = -10**9
    cut = -np.sort(-score, axis=1)[:, 4].astype(float)
    topk.COUNTS.update(totals=0, pairs=0)
    row, col, found = topk.above(ids[::100], q, cut, ids, v, 5, 4)
    assert topk.COUNTS["totals"] < topk.COUNTS["pairs"] / 10
    want = {(100 * i, c) for i in range(40) for c in np.lexsort((ids, -score[i]))[:5]}
    assert set(zip(row.tolist(), col.tolist())) == want and all(score[r // 100, c] == s for r, c, s in zip(row, col, found))
    topk.COUNTS.update(totals=0)
    assert not len(topk.above(ids[:3], q[:3], np.full(3, 1e9), ids, v // 50, 5, 4)[0]) and topk.COUNTS["totals"] == 0
