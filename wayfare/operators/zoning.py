"""Zones: membership and nearest zone of points, desire lines on a Delaunay network, clean-up to a model area."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions.geo import convex_hull, inside_polygon
from wayfare.operators.kernels import Network, delaunay
from wayfare.operators.paths import all_or_nothing
from wayfare.operators.transit import grid, nearest

MAX_ZONES = 20_000


def boxed(zones: DataFrame, cell: float) -> DataFrame:
    """zones (zone_id, ring) repeated for every grid cell that their box touches: gx, gy."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    x0, y0 = grid(F.array_min(xs), F.array_min(ys), cell)
    x1, y1 = grid(F.array_max(xs), F.array_max(ys), cell)
    rows = zones.select("zone_id", "ring", F.explode(F.sequence(x0, x1)).alias("gx"), y0.alias("y0"), y1.alias("y1"))
    return rows.select("zone_id", "ring", "gx", F.explode(F.sequence("y0", "y1")).alias("gy"))


def zone_of(points: DataFrame, zones: DataFrame, cell: float) -> DataFrame:
    """point_id, zone_id: the least zone whose ring holds the point; an equi-join on grid cells, then the exact test."""
    x, y = grid(F.col("lon"), F.col("lat"), cell)
    held = points.select("point_id", "lon", "lat", x.alias("gx"), y.alias("gy")).join(boxed(zones, cell), ["gx", "gy"])
    return held.filter(inside_polygon(F.col("lon"), F.col("lat"), F.col("ring"))).groupBy("point_id").agg(F.min("zone_id").alias("zone_id"))


def closest_zone(points: DataFrame, zones: DataFrame, cell: float) -> DataFrame:
    """point_id, zone_id: the zone around the point, or the one with the nearest vertex within a cell's width."""
    inside = zone_of(points, zones, cell)
    outside = points.join(inside.select("point_id"), "point_id", "left_anti")
    corners = zones.select("zone_id", F.explode("ring").alias("p")).select(F.col("zone_id").alias("target_id"), F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))
    return inside.unionByName(nearest(outside, corners, cell).select("point_id", F.col("target_id").alias("zone_id")))


def clean_to_area(nodes: DataFrame, links: DataFrame, area: DataFrame, cell: float) -> DataFrame:
    """Links with both ends inside the area's rings (zone_id, ring)."""
    inside = zone_of(nodes.select(F.col("node_id").alias("point_id"), "lon", "lat"), area, cell).select(F.col("point_id").alias("n"))
    return links.join(inside.withColumnRenamed("n", "a_node"), "a_node", "left_semi").join(inside.withColumnRenamed("n", "b_node"), "b_node", "left_semi")


def add_centroid(nodes: DataFrame, zone_id: int, lon: float, lat: float) -> DataFrame:
    """nodes with a centroid of the zone's number at a place; a zone that has one, or a place that is taken, is an error."""
    if nodes.filter((F.col("node_id") == zone_id) | ((F.col("lon") == lon) & (F.col("lat") == lat))).limit(1).count():
        raise ValueError(f"node {zone_id}, or a node at its place, is there already")
    values = {"node_id": zone_id, "is_centroid": True, "lon": float(lon), "lat": float(lat)}
    return nodes.unionByName(nodes.sparkSession.createDataFrame([tuple(values.get(c) for c in nodes.columns)], nodes.schema))


def connect_mode(links: DataFrame, nodes: DataFrame, zones: DataFrame, mode: str, per_zone: int, cell: float, link_types: str = "") -> DataFrame:
    """links with connectors of a mode from each zone's centroid to nodes inside its ring (zone_id, ring) that links of the
    mode, of any of the types' letters if given, reach. Zones that have connectors of the mode keep them."""
    from wayfare.operators.network import connectors

    open_links = links.filter((F.instr("modes", mode) > 0) & (F.col("link_type") != "centroid_connector"))
    if link_types:
        open_links = open_links.filter(F.col("link_type").substr(1, 1).isin(list(link_types)))
    reached = open_links.select(F.explode(F.array("a_node", "b_node")).alias("node_id")).distinct()
    free = nodes.filter("NOT is_centroid").join(reached, "node_id", "left_semi")
    inside = zone_of(free.select(F.col("node_id").alias("point_id"), "lon", "lat"), zones, cell)
    held = links.filter((F.col("link_type") == "centroid_connector") & (F.instr("modes", mode) > 0)).select(F.col("a_node").alias("zone_id")).distinct()
    candidates = inside.select(F.col("point_id").alias("node_id"), "zone_id").join(free.select("node_id", "lon", "lat"), "node_id").join(held, "zone_id", "left_anti")
    centroids = nodes.filter("is_centroid").select(F.col("node_id").alias("zone_id"), "lon", "lat")
    first = (links.agg(F.max("link_id")).first()[0] or 0) + 1
    return links.unionByName(connectors(centroids, candidates, per_zone, first, mode), allowMissingColumns=True)


def disconnect_mode(links: DataFrame, zone_id: int, mode: str) -> DataFrame:
    """links without the connectors of a zone for a mode; connectors of several modes lose that one only."""
    own = (F.col("link_type") == "centroid_connector") & ((F.col("a_node") == zone_id) | (F.col("b_node") == zone_id)) & (F.instr("modes", mode) > 0)
    return links.filter(~(own & (F.col("modes") == mode))).withColumn("modes", F.when(own, F.translate("modes", mode, "")).otherwise(F.col("modes")))


def extent_hull(nodes: DataFrame) -> list[tuple[float, float]]:
    """Hull of all nodes: each task keeps the hull of its own, so a few vertices a task reach the driver."""
    import pyarrow as pa

    def part(batches):
        kept: list[tuple[float, float]] = []
        for b in batches:
            kept = convex_hull([*kept, *zip(b.column("lon").to_pylist(), b.column("lat").to_pylist(), strict=True)])
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept]), pa.array([y for _, y in kept])], names=["lon", "lat"])

    return convex_hull([(r.lon, r.lat) for r in nodes.select("lon", "lat").na.drop().mapInArrow(part, "lon double, lat double").collect()])


def delaunay_links(spark: SparkSession, centroids: DataFrame) -> DataFrame:
    """link_id, a_node, b_node, direction 0, distance of the triangulation of at most MAX_ZONES centroids."""
    rows = centroids.select("node_id", "lon", "lat").dropDuplicates(["lon", "lat"]).orderBy("node_id").limit(MAX_ZONES + 1).collect()
    if len(rows) > MAX_ZONES:
        raise ValueError(f"more than {MAX_ZONES} centroids")
    at = np.array([(r.lon, r.lat) for r in rows], float).reshape(-1, 2)
    out = [(k + 1, rows[i].node_id, rows[j].node_id, 0, float(np.hypot(*(at[i] - at[j])))) for k, (i, j) in enumerate(delaunay(at))]
    return spark.createDataFrame(out, "link_id long, a_node long, b_node long, direction int, distance double")


def desire_lines(spark: SparkSession, centroids: DataFrame, demand: DataFrame, cores: list[str]) -> DataFrame:
    """All-or-nothing loads of demand on the Delaunay network, by straight distances."""
    rows = delaunay_links(spark, centroids).collect()  # at most three per centroid
    a, b, link, way, cost = [], [], [], [], []
    for r in rows:
        for s, (x, y) in ((1, (r.a_node, r.b_node)), (-1, (r.b_node, r.a_node))):
            a.append(x), b.append(y), link.append(r.link_id), way.append(s), cost.append(r.distance)
    nodes = [r.node_id for r in centroids.select("node_id").distinct().collect()]
    net = Network(a, b, link, way, cost, {}, nodes, False)
    return all_or_nothing(spark, net, demand, cores)
