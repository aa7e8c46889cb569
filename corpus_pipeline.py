"""A corpus pipeline of five stages over the documents table, each one of the llm operators.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next stage's
docs. All but the last return the columns of documents; the last adds token ids in the text's place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfare.llm.common import staged, table

SHINGLE_WORDS = 5
SHINGLE_PERCENT = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts go whose probability of the best grade is below a half. Null and empty texts are judged by the model's
    intercept; without labels all stay; columns of any name stay."""
    from wayfare.llm import quality

    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.kept_rows(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose 5-word shingles have a Jaccard similarity of 0.8 or more one row stays, that of
    the least doc_id (rows without one come last, rows of one id by a hash of their text); of rows equal in doc_id and
    text one stays. Null texts are empty, and texts without words are in no component."""
    from wayfare.llm.jaccard import deduplicated

    return deduplicated(docs, gram=SHINGLE_WORDS, percent=SHINGLE_PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go; rows are judged by their own text, so rows that
    share an id may part. Null texts hold nothing and stay; an empty benchmark leaves all; columns of any name stay."""
    from wayfare.llm.decontaminate import decontaminated

    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; n_chars is that of the masked text, and both stay as they are where there is no
    secret, null texts included. No row goes, equal rows are masked alike, and columns of any name stay."""
    from wayfare.llm.secrets import redacted

    return redacted(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become ids: the columns of documents but text, with n_tokens and ids in place of columns of these names. Null
    and empty texts have no ids; no row goes."""
    import public_tokenizers

    from wayfare.llm.encoding import encode

    return encode(docs, public_tokenizers.path("byte_bpe_50k.json"), with_text=False)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("BPE encoding and decoding", encoding_stage),
]

#: SQL has neither a trained classifier nor byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage-{k}")
    return docs
