"""Connected components: of edge tables by alternating stars, and of edge arrays within one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import staged

#: Edges that one task joins up by itself; more are contracted in parts of this size and then joined by stars.
TASK_EDGES = 2_000_000
#: A key with more than this share of a table's rows is joined by broadcast: there are fewer such keys than its inverse.
HOT_SHARE = 1 / 1000


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least node of each node's component, for edges a-b between nodes 0 .. n - 1."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        if np.array_equal(la, lb):
            break
        least = np.minimum(la, lb)
        np.minimum.at(label, la, least)
        np.minimum.at(label, lb, least)
        while not np.array_equal(label, up := label[label]):
            label = up
    return label


def joined_up(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that are not the least of their component, and those least nodes."""
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = ids[local_components(len(ids), place[: len(u)], place[len(u) :])]
    moved = ids != root
    return ids[moved], root[moved]


def lookup(df: DataFrame, found: DataFrame, key: str, rows: int, how: str = "inner", stage: bool = True) -> DataFrame:
    """df joined with ``found``, which has one row a key and its number of rows in df as __n. Keys that hold more than
    HOT_SHARE of df's ``rows`` rows, fewer than 1 / HOT_SHARE of them, are joined by broadcast, the others by shuffle.
    ``found`` is read three times and df twice, so it is staged unless told otherwise, and df should be a stored table."""
    found = staged(found, "found") if stage else found
    most = max(1, int(rows * HOT_SHARE))
    hot = F.broadcast(found.filter(F.col("__n") > most).drop("__n"))
    by_hot = df.join(hot, key)
    rest = df.join(hot.select(key), key, "left_anti").join(found.filter(F.col("__n") <= most).drop("__n"), key, how)
    return by_hot.unionByName(rest)


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges of each partition as a star of each component there."""

    def run(batches):
        u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            u = np.concatenate([u, batch.column("u").to_numpy()])
            v = np.concatenate([v, batch.column("v").to_numpy()])
            if len(u) > TASK_EDGES:
                u, v = joined_up(u, v)
        u, v = joined_up(u, v)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def star_components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """node, root (least node of its component) for each node of edges (u long, v long); nodes without edges are not there.

    Edges are dealt by hash into parts of at most about ``task_edges``, and each part becomes stars of its components.
    With one part that is the answer; otherwise large-star and small-star rounds follow, a logarithmic number of them,
    each a hash aggregate and a join on the node. Every round is staged in the shared folder, so neither lineage nor a
    lost executor brings earlier rounds back; a node with a great share of the edges is joined by broadcast.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges = staged(edges, "edges")
    n = edges.count()
    parts = n // task_edges + 1
    edges = staged(_contracted(edges.repartition(parts, "u", "v")), "edges")
    before = None
    while parts > 1:
        # large star: greater neighbours are linked to the least node of the neighbourhood
        both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("__n")).select("a", F.least("a", "m").alias("m"), "__n")
        large = staged(lookup(both, least, "a", 2 * n).filter("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "edges")
        # small star: lesser neighbours and the node itself are linked to the least of them
        least = large.groupBy(F.col("u").alias("a")).agg(F.min("v").alias("m"), F.count("*").alias("__n"))
        small = lookup(large.select(F.col("u").alias("a"), "v"), least, "a", n).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("a").alias("u"), F.col("m").alias("v")))
        edges = staged(small.filter("u <> v").distinct(), "edges")
        now = _summary(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
