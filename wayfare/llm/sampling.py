"""Bounded samples of labelled rows, the only thing that fitted models may be trained on in part."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import text_column

FOLDS = 5


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; fold 0 is held out from learning labels."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def fold_of(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) % FOLDS


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int, folds: tuple[int, ...] | None = None) -> list:
    """At most about ``bound`` rows (doc_id, text, label), the same for the same tables: of the labelled ids those with
    the least hashes. Rows without id or label are left out; an id labelled twice is taken once, with its greatest label."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).na.drop()
    if folds is not None:
        ids = ids.filter(fold(F.col("doc_id")).isin(*folds))
    ids = ids.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).withColumnRenamed("doc_id", "labelled_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id")).select("doc_id", "text", "label")  # `bound` rows of two numbers
    return sorted(rows.dropDuplicates(["doc_id"]).collect(), key=lambda r: r.doc_id)
