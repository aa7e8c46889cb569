"""Benchmark decontamination by winnowing, in DataFrame functions only.

A text's words are its maximal runs of letters, digits and characters beyond ASCII, A-Z lower-cased. Both sides keep
the least hash of K consecutive word-K-gram hashes out of every G - K + 1: any G consecutive words shared by a
document and an item share a kept hash, whatever stands around them. Documents that share one are extended exactly:
each of their G-word windows is compared, word by word, with the items' windows. Items of fewer than G words are one
window of their own length, found by all their grams, so nothing rests on the sampling there.

The join is on fingerprints; the benchmark's side is broadcast only while its measured number of windows is below
``broadcast_windows``, and otherwise both sides are shuffled. A fingerprint held by many documents meets one row of
the benchmark's side.

Defined results: null or wordless texts have no words and no hits; an item without words matches nothing; equal rows
give equal results, one per row; two items with the same id count once; an empty benchmark leaves all clean.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import text_column

GRAM = 10
K = 5
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_WINDOWS = 500_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BETWEEN, -1), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _next(column: str, by: int) -> Column:
    return F.slice(F.col(column), F.lit(1 + by), F.greatest(F.size(column) - by, F.lit(0)))


def _zipped(df: DataFrame, into: str, a: str, b: str, by: int, f) -> DataFrame:
    """Column of f(a[i], b[i + by]) for all i where both exist."""
    return df.withColumn(into, F.zip_with(F.slice(F.col(a), F.lit(1), F.greatest(F.size(b) - by, F.lit(0))), _next(b, by), f))


def gram_hashes(df: DataFrame, hashed: str, n: int, into: str) -> DataFrame:
    """Hashes of every n consecutive entries of an array of hashes, by doubling."""
    parts, made, size = [], hashed, 1
    while size <= n:
        if n & size:
            parts.append((made, size))
        if size * 2 <= n:
            df = _zipped(df, f"__g{n}_{size * 2}", made, made, size, lambda x, y: F.xxhash64(x, y))
            made = f"__g{n}_{size * 2}"
        size *= 2
    parts.reverse()
    joined, length = parts[0]
    for k, (other, size) in enumerate(parts[1:]):
        df = _zipped(df, f"__j{n}_{k}", joined, other, length, lambda x, y: F.xxhash64(x, y))
        joined, length = f"__j{n}_{k}", length + size
    return df.withColumn(into, F.col(joined))


def winnowed(df: DataFrame, hashed: str, into: str, k: int = K, gram: int = GRAM) -> DataFrame:
    """The distinct least k-gram hashes over every gram consecutive words."""
    df = gram_hashes(df, hashed, k, "__kgrams")
    span, made = 1, "__kgrams"
    width = gram - k + 1
    while span < width:
        step = min(span, width - span)
        df = _zipped(df, f"__m{span + step}", made, made, step, lambda x, y: F.least(x, y))
        span, made = span + step, f"__m{span + step}"
    return df.withColumn(into, F.array_distinct(F.col(made)))


def _fingerprints(df: DataFrame, short: list[int], gram: int, k: int) -> DataFrame:
    """Adds n_words and fps: winnowed hashes, and all grams of the lengths in short. Case beyond ASCII is folded too,
    which can only add candidates."""
    df = df.withColumn("__words", words(F.lower("text"))).withColumn("n_words", F.size("__words").cast("long"))
    df = df.withColumn("__hashed", F.transform("__words", lambda w: F.xxhash64(w))).drop("__words")
    df = winnowed(df, "__hashed", "__fps", k, gram)
    grams = ["__fps"]
    for n in short:
        df = gram_hashes(df, "__hashed", n, f"__short{n}")
        grams.append(f"__short{n}")
    return df.withColumn("fps", F.array_distinct(F.concat(*grams)) if short else F.col("__fps"))


def benchmark_windows(benchmark: DataFrame, gram: int = GRAM) -> DataFrame:
    """window (words joined by spaces), n_window, items: a row for each distinct window."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(lower_ascii(text_column(benchmark))).alias("w")).filter(F.size("w") > 0)
    items = items.withColumn("n_window", F.least(F.size("w"), F.lit(gram)))
    windows = items.select("item", "n_window", F.explode_outer(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n_window") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n_window")), " "))).alias("window"))
    return windows.groupBy("window", "n_window").agg(F.collect_set("item").alias("items"))


def _windows_of(n: int) -> Column:
    """Every n consecutive words of the column w, with their place from 1."""
    places = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(n).alias("n_window"), F.array_join(F.slice("w", i, n), " ").alias("window")))


def contamination(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, k: int = K, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, text_hash (see the module)."""
    windows = benchmark_windows(benchmark, gram)
    lengths = {r.n_window: r["count"] for r in windows.groupBy("n_window").count().collect()}  # at most `gram` rows
    small = sum(lengths.values()) <= broadcast_windows
    side = F.broadcast if small else (lambda df: df)
    short = sorted(n for n in lengths if n < gram)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    rows = rows.withColumn("__key", F.xxhash64("text"))
    prints = _fingerprints(benchmark.select(text_column(benchmark).alias("text")), short, gram, k)
    prints = prints.select(F.explode_outer("fps").alias("fp")).filter("fp IS NOT NULL").distinct()
    # explode_outer: for explode the optimizer infers a filter on the array's size and repeats its making below
    found = _fingerprints(rows, short, gram, k)
    suspects = found.select("doc_id", "__key", F.explode_outer("fps").alias("fp")).join(side(prints), "fp", "left_semi").select(F.col("doc_id").alias("s_doc"), F.col("__key").alias("s_key")).distinct()

    same = F.col("doc_id").eqNullSafe(F.col("s_doc")) & (F.col("__key") == F.col("s_key"))
    held = rows.join(suspects, same, "left_semi").withColumn("w", words(lower_ascii(F.col("text")))).drop("text")
    grams = held.select("doc_id", "__key", F.explode_outer(F.concat(*[_windows_of(n) for n in sorted(lengths) or [gram]])).alias("g")).select("doc_id", "__key", "g.*").filter("at IS NOT NULL")
    hits = grams.join(side(windows), ["window", "n_window"])
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("at", "n_window")), lambda s: F.sequence(s["at"], s["at"] + s["n_window"] - 1))))
    per_doc = hits.groupBy(F.col("doc_id").alias("h_doc"), F.col("__key").alias("h_key")).agg(
        F.size(covered).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    counted = rows.select("doc_id", "__key", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = counted.join(per_doc, F.col("doc_id").eqNullSafe(F.col("h_doc")) & (F.col("__key") == F.col("h_key")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        items.alias("items"),
        F.col("__key").alias("text_hash"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark window."""
    bad = contamination(docs, benchmark, **options).filter("contaminated").select(F.col("doc_id").alias("__bad_doc"), F.col("text_hash").alias("__bad_text")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__bad_doc")) & (F.xxhash64(text_column(docs)) == F.col("__bad_text"))
    return docs.join(bad, same, "left_anti")
