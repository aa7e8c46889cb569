"""Queries of this subpackage, one opN_<name> per operator, over whole tables, and their SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfare.llm.substrings import dedup_substrings

    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfare.llm.secrets import secret_spans

    return secret_spans(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfare.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from wayfare.llm.encoding import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfare.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfare.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfare.llm.html import extract

    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfare.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "text_hash")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayfare.llm.fingerprints import document_fingerprints

    return document_fingerprints(table(spark, sf_dir, "documents"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    from wayfare.llm.common import shared_dir
    from wayfare.llm.store import document_crcs, verify_manifest, write_store

    folder = f"{shared_dir(spark)}/stores/{uuid.uuid4().hex}"
    write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    verify_manifest(spark, folder)
    return document_crcs(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_secret_scan, op3_jaccard_join, op4_bpe_round_trip, op5_quality, op6_toxicity, op7_html_text, op8_decontaminate, op9_fingerprints, op10_token_store)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOW = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def oracle_sql() -> dict[str, str]:
    """SQL over the same tables for the operators that SQL can say; doc_id is unique there."""
    substrings = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM d, unnest(range(1, len(w) - 18)) t(i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM r, unnest(range(20)) t(j)),
words AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) t(p)),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS text FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id"""
    jaccard = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_SPACED}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 2, least(len(w), 1) + 1))) t(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 85 * (x.n + y.n - i)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN r ON d.doc_id = r.a GROUP BY 1, 2"""
    contamination = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM win),
dg AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM d, sizes, unnest(range(1, len(w) - k + 2)) t(i)),
hits AS (SELECT doc_id, i, dg.k, item FROM dg JOIN win ON dg.k = win.k AND dg.g = win.g),
p AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hits, unnest(range(k)) t(j) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN m ON d.doc_id = m.doc_id"""
    return {"op1_substring_dedup": substrings, "op3_jaccard_join": jaccard, "op8_decontaminate": contamination}
