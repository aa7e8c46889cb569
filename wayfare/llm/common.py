"""Shared plumbing: staged tables in the cluster's checkpoint folder and input tables.

Nothing here reads or writes through local paths: tables go through Spark's own readers and writers, so any store
that Spark reaches works, and a lost executor only repeats tasks.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset a folder of this session's own, on one machine only."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: executors of a cluster need a folder that they share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="wayfare-")
    return _own_dirs[app]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df below the shared folder and read it back: its lineage ends there, and readers see one fixed version."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_column(df: DataFrame, column: str = "text"):
    """The text column with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def as_row(df: DataFrame, columns: list[str] | None = None):
    """The columns as one struct: names with dots, or that clash, then pass through any function."""
    return F.struct(*[F.col(f"`{c}`") for c in (df.columns if columns is None else columns)])


def _text_name(columns: list[str]) -> str:
    return "text" if "text" in columns else next(c for c in columns if c.lower() == "text")


def text_apart(docs: DataFrame, columns: list[str]) -> DataFrame:
    """row: the columns but the text as one struct; text: the text as it is. A text then crosses to Python and back once."""
    rest = [c for c in columns if c != _text_name(columns)]
    return docs.select((as_row(docs, rest) if rest else F.struct(F.lit(True).alias("none"))).alias("row"), F.col("text"))


def put_together(columns: list[str], with_text: bool = True) -> list[Column]:
    """The columns that ``text_apart`` took apart, in their order."""
    name = _text_name(columns)
    return [(F.col("text") if c == name else F.col("row")[c]).alias(c) for c in columns if with_text or c != name]


def with_fields(field, ddl: str):
    """A schema of one field and those of a DDL string; names inside the field may be of any kind."""
    return T.StructType([field, *T.StructType.fromDDL(ddl).fields])


_kept: dict[tuple, object] = {}


def kept_in_worker(key: tuple, make):
    """What this Python worker keeps from one task to the next, made if it is not there. It is one thing at a time: what
    another query, or the same one on other tables, has left goes before."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def let_go() -> None:
    _kept.clear()


def give_back() -> None:
    """Return freed memory to the system, as far as the allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(run, keeps: bool = False):
    """A function for mapInArrow whose task leaves its worker small, as workers of several stages live side by side: what was
    kept for others goes first (``keeps``: unless it is this function's), and free memory is given back at the end."""

    def own(batches):
        if not keeps:
            let_go()
        try:
            yield from run(batches)
        finally:
            give_back()

    return own


def pow2_at_least(n: float) -> int:
    """Exponent of the least power of two that is n or more."""
    return max(0, int(n - 1).bit_length()) if n > 1 else 0
