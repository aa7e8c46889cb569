"""A content-addressed store of token ids: chunks cut by a rolling hash, document recipes, Merkle manifests.

``write_store`` encodes texts, appends an end id and cuts each document's ids where a hash of the last ``SPAN`` ids has
``LOG_CHUNK`` low zero bits (chunks average 2 ** LOG_CHUNK ids, and none exceeds ``MOST_IDS``), so equal passages give
equal chunks wherever they stand. Layout below the given folder, Parquet throughout, ids as little-endian integers of
16 bits, or 32 where the vocabulary needs them:

- ``parts/kind=chunk``: digest (16-byte BLAKE2b of the body), body; every distinct chunk once;
- ``recipes``: part, doc_id, before, n_tokens, chunks (digests in order), leaf (digest over them); parts are ranges in
  ascending order of doc_id, ``before`` being the ids of the part's documents before;
- ``manifest``: part, start (ids of all parts before), n_tokens, n_documents, root (Merkle root of the part's leaves);
- ``format``: bytes, of an id.

``read_documents`` puts every document together from its chunks and verifies it: bodies against digests, digests
against the leaf, ids against the recipe's number; ``verify_manifest`` compares leaves with roots. A mismatch raises.
A chunk that many documents use is read by broadcast: those that are more than a thousandth of all uses are fewer than
a thousand, of ``MOST_IDS`` ids at most. Parts, and the ranges of the id stream that a task rebuilds, are of bounded
size, so their number follows the input.

Defined results: null and empty texts are the end id alone; rows that share a doc_id are separate documents, ordered
by their leaf; rows without doc_id come first; an empty table gives an empty store. Tasks that run twice write the
same chunks, and Spark's committer keeps one.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import textnum
from wayfare.llm.common import staged, text_column
from wayfare.llm.components import lookup
from wayfare.llm.encoding import library_encoder

END_ID = 1
SPAN = 8
LOG_CHUNK = 10
MOST_IDS = 1 << 14
DOCS_PER_PART = 50_000
#: Bytes of text whose chunks a task compares, documents a batch encodes, and ids of the stream that a group rebuilds.
TASK_BYTES = 1 << 26
TEXTS_AT_ONCE = 2048
SLOT_IDS = 1 << 19


#: Mixed values of all ids of 16 bits.
_MIXED = textnum.mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


def digest(body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=16).digest()


def cuts(ids: np.ndarray, first: np.ndarray, log_chunk: int = LOG_CHUNK, most: int = MOST_IDS) -> np.ndarray:
    """Ends of the chunks of documents, none of them empty, whose ids stand one after another; first: their n + 1 places."""
    mixed = _MIXED[ids] if ids.dtype.itemsize <= 2 else textnum.mix(ids.astype(np.uint64) + np.uint64(1))
    h, at = textnum.runs(mixed, first, SPAN)
    ends = np.union1d(at[(h & np.uint64((1 << log_chunk) - 1)) == 0] + SPAN, first[1:])
    gaps = np.diff(ends, prepend=0)
    wide = np.flatnonzero(gaps > most)
    if len(wide):
        ends = np.union1d(ends, np.concatenate([np.arange(ends[k] - gaps[k] + most, ends[k], most) for k in wide.tolist()]))
    return ends


def merkle_root(leaves: list[bytes]) -> bytes:
    while len(leaves) > 1:
        leaves = [digest(b"".join(leaves[i : i + 2])) for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else digest(b"")


PARTS = "kind string, digest binary, body binary, doc_id long, n_tokens long, chunks array<binary>"
RECIPES = "part int, doc_id long, before long, n_tokens long, chunks array<binary>, leaf binary"
MANIFEST = "part int, start long, n_tokens long, n_documents long, root binary"


def write_store(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, log_chunk: int = LOG_CHUNK) -> None:
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    n_bytes = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = library_encoder(tokenizer).dtype().itemsize
    if end_id >= 1 << (8 * width):
        raise ValueError(f"the end id {end_id} needs more than {width} bytes")
    spark.createDataFrame([(width,)], "bytes int").coalesce(1).write.parquet(f"{folder}/format")

    def chunked(batches):
        encoder = library_encoder(tokenizer)
        met: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                ids, first = encoder.encode(part.column("text"))
                m = part.num_rows
                ids = np.insert(ids, first[1:], ids.dtype.type(end_id))
                first = first + np.arange(m + 1)
                ends = cuts(ids, first, log_chunk)
                raw = ids.astype(f"<u{width}").tobytes()
                bodies = [raw[a * width : b * width] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                digests = [digest(b) for b in bodies]
                of = np.searchsorted(ends, first[1:], "right")
                recipes = [digests[a:b] for a, b in zip([0, *of[:-1].tolist()], of.tolist(), strict=True)]
                keys, kept = [], []
                for key, body in zip(digests, bodies, strict=True):
                    if key not in met:
                        met.add(key)
                        keys.append(key)
                        kept.append(body)
                if len(met) > 1_000_000:
                    met.clear()
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(["chunk"] * n + ["recipe"] * m, pa.string()),
                        pa.array(keys + [digest(b"".join(r)) for r in recipes], pa.binary()),
                        pa.array(kept + [None] * m, pa.binary()),
                        pa.concat_arrays([pa.nulls(n, pa.int64()), part.column("doc_id")]),
                        pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(np.diff(first), pa.int64())]),
                        pa.array([None] * n + recipes, pa.list_(pa.binary())),
                    ],
                    names=["kind", "digest", "body", "doc_id", "n_tokens", "chunks"],
                )

    def once(batches):
        met: set[bytes] = set()
        for batch in batches:
            keep = []
            for i, (kind, key) in enumerate(zip(batch.column("kind").to_pylist(), batch.column("digest").to_pylist(), strict=True)):
                if kind == "chunk":
                    if key in met:
                        continue
                    met.add(key)
                keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    # chunks meet by digest; recipes, many of them equal where documents are, by doc_id as well
    key = F.when(F.col("kind") == "chunk", F.xxhash64("digest")).otherwise(F.xxhash64("digest", "doc_id", F.monotonically_increasing_id()))
    parts = base.mapInArrow(chunked, PARTS).withColumn("__key", key).repartition(max(8, n_bytes // TASK_BYTES + 1), "__key").drop("__key").mapInArrow(once, PARTS)
    parts.write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/parts")

    recipes = spark.read.schema(PARTS).parquet(f"{folder}/parts").filter("kind = 'recipe'").select("doc_id", "n_tokens", "chunks", F.col("digest").alias("leaf"))
    n = recipes.count()

    def placed(batches):
        """Rows of a part, which come in order, with the part's number and the ids before."""
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            upto = np.cumsum(batch.column("n_tokens").to_numpy()) + before
            at = upto - batch.column("n_tokens").to_numpy()
            before = int(upto[-1]) if len(upto) else before
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, part), pa.int32()), batch.column("doc_id"), pa.array(at, pa.int64()), batch.column("n_tokens"), batch.column("chunks"), batch.column("leaf")], names=["part", "doc_id", "before", "n_tokens", "chunks", "leaf"])

    order = [F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc("__tie")]
    ranges = recipes.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(-(-n // DOCS_PER_PART) or 1, *order).sortWithinPartitions(*order)
    ranges.drop("__tie").mapInArrow(placed, RECIPES).write.option("compression", "zstd").parquet(f"{folder}/recipes")
    roots = staged(_roots(_recipes(spark, folder)), "roots")
    offset, rows = 0, []
    for r in roots.select("part", "n_tokens").orderBy("part").collect():  # a row for every DOCS_PER_PART documents
        rows.append((r.part, offset))
        offset += r.n_tokens
    starts = F.broadcast(spark.createDataFrame(rows, "part int, start long"))
    roots.join(starts, "part").select("part", "start", "n_tokens", "n_documents", "root").write.option("compression", "zstd").parquet(f"{folder}/manifest")


def _recipes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(RECIPES).parquet(f"{folder}/recipes")


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _roots(recipes: DataFrame) -> DataFrame:
    """part, n_tokens, n_documents, root of recipes; a part's documents must follow one another."""

    def root(group: pa.Table) -> pa.Table:
        by = np.lexsort((group.column("n_tokens").to_numpy(), group.column("before").to_numpy()))
        sizes, before = group.column("n_tokens").to_numpy()[by], group.column("before").to_numpy()[by]
        if not np.array_equal(before, np.cumsum(sizes) - sizes):
            raise ValueError("a part's recipes do not follow one another")
        leaves = group.column("leaf").take(pa.array(by)).to_pylist()
        return pa.table({"part": pa.array([group.column("part")[0].as_py()], pa.int32()), "n_tokens": pa.array([sizes.sum()], pa.int64()), "n_documents": pa.array([len(by)], pa.int64()), "root": pa.array([merkle_root(leaves)], pa.binary())})

    return recipes.select("part", "before", "n_tokens", "leaf").groupBy("part").applyInArrow(root, "part int, n_tokens long, n_documents long, root binary")


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("digest binary, body binary, kind string").parquet(f"{folder}/parts").filter("kind = 'chunk'").select("digest", "body")


def verify_manifest(spark: SparkSession, folder: str) -> None:
    """Raise unless every part's documents, ids and root are those of the manifest."""
    manifest = _manifest(spark, folder).drop("start")
    found = _roots(_recipes(spark, folder))
    odd = manifest.exceptAll(found).unionByName(found.exceptAll(manifest)).limit(1).collect()
    if odd:
        raise ValueError(f"part {odd[0].part} does not fit the manifest")


def _rebuilt(spark: SparkSession, folder: str, schema: str, columns) -> DataFrame:
    """Documents put together and verified: doc_id, start, n_tokens and what ``columns`` makes of a list of their ids."""
    recipes = _recipes(spark, folder).join(F.broadcast(_manifest(spark, folder).select("part", F.col("start").alias("__start"))), "part", "left")
    recipes = recipes.withColumn("start", F.col("__start") + F.col("before")).withColumn("slot", F.floor(F.coalesce("start", F.lit(0)) / SLOT_IDS).cast("long"))
    uses = recipes.select("slot", "start", "doc_id", "n_tokens", "leaf", F.posexplode("chunks").alias("at", "digest"))
    counts = uses.groupBy("digest").agg(F.count("*").alias("__n"))
    total = recipes.agg(F.sum(F.size("chunks"))).first()[0] or 0
    found = lookup(uses, _chunks(spark, folder).join(counts, "digest"), "digest", total, "left", stage=False)
    kind = np.dtype(f"<u{spark.read.parquet(f'{folder}/format').first().bytes}")

    def rebuild(group: pa.Table) -> pa.Table:
        by = np.lexsort((group.column("at").to_numpy(), group.column("start").fill_null(-1).to_numpy()))
        group = group.take(pa.array(by))
        keys, bodies = group.column("digest").to_pylist(), group.column("body").to_pylist()
        if any(b is None or digest(b) != k for k, b in zip(keys, bodies, strict=True)):
            raise ValueError("a chunk is missing or does not fit its digest")
        first = np.append(np.flatnonzero(group.column("at").to_numpy() == 0), len(keys))
        about = group.select(["doc_id", "start", "n_tokens"]).take(pa.array(first[:-1]))
        leaves, sizes = group.column("leaf").take(pa.array(first[:-1])).to_pylist(), about.column("n_tokens").to_pylist()
        if about.column("start").null_count:
            raise ValueError("a recipe's part is not in the manifest")
        ids = []
        for a, b, leaf, size in zip(first[:-1].tolist(), first[1:].tolist(), leaves, sizes, strict=True):
            if digest(b"".join(keys[a:b])) != leaf:
                raise ValueError("a recipe's leaf does not fit its chunks")
            ids.append(np.frombuffer(b"".join(bodies[a:b]), kind))
            if len(ids[-1]) != size:
                raise ValueError("a document's chunks do not have its number of ids")
        return columns(about, ids)

    return found.groupBy("slot").applyInArrow(rebuild, schema)


def document_crcs(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit) of the documents put together."""

    def crcs(about: pa.Table, ids: list[np.ndarray]) -> pa.Table:
        return about.append_column("ids_crc32", pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()))

    return _rebuilt(spark, folder, "doc_id long, start long, n_tokens long, ids_crc32 long", crcs)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, ids (array<long>), put together from the chunks and verified."""

    def arrays(about: pa.Table, ids: list[np.ndarray]) -> pa.Table:
        return about.select(["doc_id", "start"]).append_column("ids", pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))

    return _rebuilt(spark, folder, "doc_id long, start long, ids array<long>", arrays)
