"""URL filters: host and path rules, and a weighted vocabulary counted by Aho-Corasick."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that reject a url alone, and words of which several different ones do.
STRICT = ("porn", "xxx", "hentai", "camgirl", "viagra", "cialis", "warez", "escort", "nsfw", "spam-farm", "cheap-pills")
SOFT = ("adult", "sex", "sexy", "nude", "casino", "poker", "betting", "bet", "pills", "cheap", "loan", "payday", "crack", "torrent", "free", "download", "spam", "farm")
#: (verdict, host, path): a rule fits its host and all hosts below it where the url's path starts with the rule's.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary_hits(text: str, automaton, strict: int) -> tuple[int, int]:
    """Number of different strict and soft terms in ``text`` that no ASCII letter or digit touches on either side."""
    hit = set()
    for end, (term, size) in automaton.iter(text):
        before, after = text[end - size:end - size + 1] if end >= size else "", text[end + 1:end + 2]
        if not (before.isascii() and before.isalnum()) and not (after.isascii() and after.isalnum()):
            hit.add(term)
    strong = sum(t < strict for t in hit)
    return strong, len(hit) - strong


def judge(pages: DataFrame, url: str = "url", keep: Sequence[str] = ("page_id",), rules: Sequence[tuple[str, str, str]] = RULES,
          strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_limit: int = 2) -> DataFrame:
    """``keep`` columns with host, path, rule, verdict (allow or block), n_strict and n_soft.

    The longest rule that fits decides. Else the url, A-Z in lower case, is searched for the vocabulary: one strict term or
    ``soft_limit`` different soft ones block. A null url has no host, path or rule and is allowed. Repeated rows each have
    a result. Rules are a parameter of a few rows; they are tried longest first in one expression.
    """
    strict, soft = tuple(dict.fromkeys(strict)), tuple(dict.fromkeys(soft))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, term in enumerate([*strict, *(t for t in soft if t not in strict)]):
            automaton.add_word(term, (i, len(term)))
        automaton.make_automaton()
        for batch in batches:
            found = [vocabulary_hits(u or "", automaton, len(strict)) for u in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=[*batch.schema.names[1:], "n_strict", "n_soft"])

    link = F.col("__url")
    rest = F.when(link.contains("://"), F.regexp_extract(link, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    base = (pages.select(F.col(url).cast("string").alias("__url"), *keep)
            .withColumn("__rest", rest)
            .withColumn("__host", F.regexp_extract("__rest", r"^[^/?#]*", 0))
            .select(F.translate(link, _UPPER, _LOWER).alias("__url"), *keep, F.translate("__host", _UPPER, _LOWER).alias("host"),
                    F.regexp_extract(F.expr("substring(__rest, length(__host) + 1)"), r"^[^?#]*", 0).alias("path")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != "__url")
    counted = base.mapInArrow(run, f"{kinds}, n_strict long, n_soft long")
    fit, verdict = F.lit(None).cast("string"), F.when((F.col("n_strict") >= 1) | (F.col("n_soft") >= soft_limit), "block").otherwise("allow")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):   # the longest is outermost
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        fit, verdict = F.when(fits, h + p).otherwise(fit), F.when(fits, kind).otherwise(verdict)
    return counted.select(*keep, "host", "path", fit.alias("rule"), verdict.alias("verdict"), "n_strict", "n_soft")


def oracle(rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_limit: int = 2) -> str:
    """The same as DuckDB SQL over ``pages``."""
    def count(terms: Sequence[str]) -> str:
        return " + ".join(f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS BIGINT)" for t in terms)

    fits = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    when = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in fits]
    rule = " ".join(f"WHEN {w} THEN '{h}{p}'" for w, (_, h, p) in zip(when, fits))
    verdict = " ".join(f"WHEN {w} THEN '{kind}'" for w, (kind, _, _) in zip(when, fits))
    return f"""
    WITH cut AS (SELECT page_id, coalesce(translate(url, '{_UPPER}', '{_LOWER}'), '') AS u,
                        CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
                     regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
    counted AS (SELECT *, {count(strict)} AS n_strict, {count(soft)} AS n_soft FROM parts)
    SELECT page_id, host, path, CASE {rule} END AS rule,
           CASE {verdict} WHEN n_strict >= 1 OR n_soft >= {soft_limit} THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft
    FROM counted"""
