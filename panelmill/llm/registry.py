"""Registered queries of the corpus operators and the SQL that DuckDB can run for them."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from . import bpe, dualtree, langid, merkle, negatives, packing, pii, simhash, substring, topk, toxicity, urlfilter, wrapper
from .common import read
from .tokens import word_bpe_path


def op1_language_id(spark, sf_dir):
    return langid.identify(read(spark, sf_dir, "documents"))


def op2_simhash_dedup(spark, sf_dir):
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op3_substring_dedup(spark, sf_dir):
    """doc_id, the text that stays, and the removed spans as start:end in original code points."""
    done = substring.deduplicate(read(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return done.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.size("removed").cast("long").alias("n_removed"), spans.alias("removed"))


def op4_personal_data(spark, sf_dir):
    """Counts, digest of the base matches, and all spans with those of disclosing terms."""
    found = pii.detect(read(spark, sf_dir, "documents"))
    kinds = F.lit(list(pii.KINDS))
    spans = F.array_join(F.transform("all_spans", lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ",")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"))


def op5_url_filter(spark, sf_dir):
    return urlfilter.judge(read(spark, sf_dir, "pages"))


def op6_html_extraction(spark, sf_dir):
    return wrapper.main_text(read(spark, sf_dir, "pages"))


def op7_merkle_fingerprint(spark, sf_dir):
    return merkle.compare_edits(read(spark, sf_dir, "documents"))


def op9_exact_top_k(spark, sf_dir):
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op8_bpe_codec(spark, sf_dir):
    return bpe.digests(read(spark, sf_dir, "documents"), word_bpe_path())


def op10_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(read(spark, sf_dir, "documents"), word_bpe_path())


def op11_hard_negatives(spark, sf_dir):
    return negatives.mine(negatives.relabelled(read(spark, sf_dir, "embeddings")))


def op12_ranked_search(spark, sf_dir):
    return dualtree.rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_toxicity(spark, sf_dir):
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_simhash_dedup, op3_substring_dedup, op4_personal_data, op5_url_filter, op6_html_extraction, op7_merkle_fingerprint, op8_bpe_codec, op9_exact_top_k, op10_best_fit_packing, op11_hard_negatives, op12_ranked_search, op13_toxicity, pipeline)}
ORACLE: dict[str, str] = {
    "op11_hard_negatives": negatives.ORACLE,
    "op12_ranked_search": dualtree.ORACLE,
    "op5_url_filter": urlfilter.oracle(),
    "op9_exact_top_k": """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
    "op3_substring_dedup": substring.ORACLE,
}
