"""The training-data pipeline: STAGES over the table of documents, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm import langid, packing, pii, simhash, substring
from panelmill.llm.common import read
from panelmill.llm.tokens import word_bpe_path
from panelmill.session import settle, ship

#: Near-duplicate groups and repeated lines depend on fingerprints and digests that SQL cannot compute.
ORACLE_SQL = None


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, n_chars anew where it is one of them (null with a null text)."""
    return docs.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels teach; text that is null or has no letter goes."""
    ship(spark)
    return langid.in_a_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints of 3-word shingles that differ in 3 bits at most."""
    ship(spark)
    return simhash.representatives(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier place in the corpus has; an empty text stays, null stays null."""
    ship(spark)
    return _counted(substring.cut_texts(docs), docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose it generalised."""
    ship(spark)
    return _counted(pii.sanitise(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: one row for each piece of a document."""
    ship(spark)
    return packing.pack_documents(docs, word_bpe_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_lines", repeated_lines), ("personal_data", personal_data), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
