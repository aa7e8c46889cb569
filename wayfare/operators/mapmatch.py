"""Map matching: the network path that follows a pattern's stops and shape.

A pattern is one task's work: links near the shape cost a tenth, stops snap to their nearest node, and the path is the
chain of shortest paths between successive stops, with runs back and forth removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.operators.paths import MAX_EDGES
from wayfare.operators.kernels import Network

DISCOUNT, BUFFER = 0.1, 20.0


def distances_to_line(x: np.ndarray, y: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Distance of each point to a polyline of one vertex or more."""
    best = np.hypot(x - line[0, 0], y - line[0, 1])
    for (ax, ay), (bx, by) in zip(line[:-1], line[1:], strict=True):
        dx, dy = bx - ax, by - ay
        t = np.clip(((x - ax) * dx + (y - ay) * dy) / max(dx * dx + dy * dy, 1e-18), 0, 1)
        best = np.minimum(best, np.hypot(x - ax - t * dx, y - ay - t * dy))
    return best


def without_returns(edges: list[int], net: Network) -> list[int]:
    """A path without steps that are taken straight back."""
    out: list[int] = []
    for e in edges:
        if out and net.tail[out[-1]] == net.head[e] and net.head[out[-1]] == net.tail[e]:
            out.pop()
        else:
            out.append(e)
    return out


def match_one(net: Network, x: np.ndarray, y: np.ndarray, stops: np.ndarray, shape: np.ndarray | None, buffer: float = BUFFER) -> list[int]:
    """Edges of the path along the stops, in order; parts that no path joins are left out."""
    cost = net.cost.copy()
    if shape is not None and len(shape):
        near = distances_to_line(x, y, shape) <= buffer
        cost[near[net.tail] & near[net.head]] *= DISCOUNT
    at = [int(np.argmin(np.hypot(x - sx, y - sy))) for sx, sy in stops]
    plain, out = cost.tolist(), []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if a != b:
            out += net.path(net.tree(a, plain, b)[1], b)
    return without_returns(out, net)


def match_patterns(spark: SparkSession, net: Network, nodes: DataFrame, patterns: DataFrame, buffer: float = BUFFER) -> DataFrame:
    """pattern_id, seq, link_id, direction for patterns (pattern_id, stops array<struct<lon,lat>>, shape the same or null);
    coordinates are those of nodes, planar."""
    if nodes.limit(2 * MAX_EDGES + 1).count() > 2 * MAX_EDGES:
        raise ValueError(f"more than {2 * MAX_EDGES} nodes")
    held = {r.node_id: (r.lon, r.lat) for r in nodes.select("node_id", "lon", "lat").collect()}  # the network's nodes, as bounded as it is
    place = np.array([held.get(int(i), (np.inf, np.inf)) for i in net.nodes], float)
    shared = spark.sparkContext.broadcast((net, place[:, 0], place[:, 1]))

    def run(batches):
        net, x, y = shared.value
        for batch in batches:
            rows = []
            for pattern, stops, shape in zip(*(batch.column(c).to_pylist() for c in ("pattern_id", "stops", "shape")), strict=True):
                line = lambda ps: np.array([(p["lon"], p["lat"]) for p in ps or []], float).reshape(-1, 2)
                for k, e in enumerate(match_one(net, x, y, line(stops), line(shape), buffer)):
                    rows.append((pattern, k, int(net.link[e]), int(net.direction[e])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["pattern_id", "seq", "link_id", "direction"])

    return patterns.select(F.col("pattern_id").cast("long"), "stops", "shape").mapInArrow(run, "pattern_id long, seq long, link_id long, direction int")
