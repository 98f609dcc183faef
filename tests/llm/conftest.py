"""Small tables with edge rows: the smallest given data, then nulls, empties, repeats, copies and a very long text."""

import pytest
from pyspark.sql import functions as F

from panelmill.session import ship
from tests.oracle import DATA

LONG = " ".join(f"w{i % 977}{i % 13} und the" for i in range(60_000)) + "\n" + "x" * 70_000
SHARED = "This very line of eight words stands in several documents"
EDGES = [
    # doc_id, text, lang, source
    (9001, None, "en", "edge"),
    (9002, "", "en", "edge"),
    (9003, " \t\n\r ", None, None),
    (9004, "1234 !!! 56", "de", "edge"),
    (9005, LONG, "en", "edge"),
    (9006, f"Alpha beta gamma\n{SHARED}\n\nomega mail me at jo.doe+x@mail.example.org, or +49 (30) 1234-5678.", "en", "edge"),
    (9007, f"Something else\n  {SHARED.upper()}  \nserver 10.0.0.255 and 300.1.1.1, card 4111-1111 1111 1111, bad card 4111 1111 1111 1112", "en", "edge"),
    (9007, f"Something else\n  {SHARED.upper()}  \nserver 10.0.0.255 and 300.1.1.1, card 4111-1111 1111 1111, bad card 4111 1111 1111 1112", "en", "edge"),
    (9008, f"{SHARED}\n{SHARED}", "en", "edge"),
    (9009, "two words", "en", "edge"),
    (9010, "Two Words", "fr", "edge"),
    (9011, "\U0001f600 Ünïcode ß İstanbul 日本語 \u00a0 nbsp a@b.c.d 1.2.3.4.5.6.7.8 +1234567890", None, "edge"),
    (None, "a row without an id that has a few words of its own", "en", "edge"),
    (None, None, None, None),
]


def edge_documents(spark):
    """documents with edge rows, and columns called like names that operators use inside."""
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    more = spark.createDataFrame(EDGES, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    rows = docs.unionByName(more)
    for name in ("key", "fp", "root", "start", "end", "spans", "label", "n", "term", "score", "piece", "length", "__range", "Lang_Pred", "__lang_pred", "__score", "__stay", "__own", "__spans", "__key", "__terms", "__id", "removed", "row", "own", "id", "of", "mark", "maybe"):
        rows = rows.withColumn(name, F.lit("clash"))
    return rows


def edge_pages(spark):
    pages = spark.read.parquet(f"{DATA}/sf0.001/pages.parquet")
    more = [(9001, None, None), (9002, "", ""), (9003, "no scheme/en/", "<p>Fish &amp; chips</p>"), (9003, "no scheme/en/", "<p>Fish &amp; chips</p>"),
            (9004, "HTTP://Sub.Example.COM/en/x?q#f", "<html><body><nav>Menu</nav><main><p>Only\n  this</p></main></body></html>"),
            (9005, "http://WWW.example.com/en/", "plain text"), (9006, "https://a.net/es/porn", None), (9007, "x://h/a-porn-b", "<div"), (9008, "x://h/casino/free", "<article>" + "<p>word " * 3000),
            (9009, "x://h/casinos/free", "<article><p>one</p><aside>no</aside><p>two</p></article>"), (None, "x://h?sex", "<!-- -->")]
    return pages.unionByName(spark.createDataFrame(more, pages.schema)).withColumn("host", F.lit("clash")).withColumn("wrapper", F.lit("clash"))


def edge_embeddings(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet")
    more = spark.createDataFrame([(20_000, None, 1), (20_001, [1.0, None], 1), (20_020, [float("nan"), 1.0], 1), (20_040, [float("inf")], 1), (None, [1.0, 2.0], 1)], rows.schema)
    ties = rows.limit(40).withColumn("vec_id", F.col("vec_id") + 30_000)
    return rows.unionByName(more).unionByName(ties).withColumn("v", F.lit("clash")).withColumn("cb", F.lit(1))


def edge_benchmark(spark):
    """Items with edge rows: null, empty, without a term, repeated, one id with two texts, and a term many times."""
    items = spark.read.parquet(f"{DATA}/sf0.001/benchmark.parquet")
    more = [(9001, None), (9002, ""), (9003, "?! .."), (9004, SHARED), (9004, SHARED), (9005, "the the The THE\u00c4 the"), (None, "alpha beta gamma"), (9006, "w1und zzzz-nowhere")]
    return items.unionByName(spark.createDataFrame(more, items.schema)).withColumn("terms", F.lit("clash")).withColumn("item", F.lit(1))


def edge_labels(spark):
    labels = spark.read.parquet(f"{DATA}/sf0.001/labels.parquet")
    more = [(9002, 1, 1), (9005, 0, 0), (9007, 1, None), (9007, 0, 1), (9007, 0, 1), (None, 1, 1), (99_999, 1, 1)]
    return labels.unionByName(spark.createDataFrame(more, labels.schema)).withColumn("text", F.lit("clash")).withColumn("y", F.lit(1)).withColumn("shard", F.lit(1))


TABLES = ("documents", "pages", "embeddings", "benchmark", "labels")


@pytest.fixture(scope="package")
def folder(spark, tmp_path_factory):
    """A folder of tables as the registered queries read them."""
    ship(spark)
    out = str(tmp_path_factory.mktemp("corpus"))
    for name, make in zip(TABLES, (edge_documents, edge_pages, edge_embeddings, edge_benchmark, edge_labels)):
        make(spark).coalesce(2).write.parquet(f"{out}/{name}.parquet")
    return out


@pytest.fixture(scope="package")
def empty_folder(spark, folder, tmp_path_factory):
    """The same tables without a row."""
    out = str(tmp_path_factory.mktemp("empty"))
    for name in TABLES:
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{out}/{name}.parquet")
    return out


@pytest.fixture(scope="package")
def texts(spark, folder):
    """(doc_id, text) of every row."""
    return [(r[0], r[1]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
