"""Route choice: route sets per pair, path-size logit, link loads, select links and sub-area demand.

Only the generation of route sets is a kernel; it runs per origin over a broadcast network. Costs, masks, overlap,
probabilities and loads are windows and aggregations over (origin, destination, route_id, links).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare.operators.kernels import Network, bfs_link_elimination, link_penalisation

METHODS = {"lp": "link-penalisation", "link-penalisation": "link-penalisation", "bfsle": "bfsle"}


def all_pairs(nodes: DataFrame) -> DataFrame:
    """Ordered pairs of different nodes of a list; the square of what is asked for, by definition."""
    a = nodes.select(F.col("node_id").alias("origin"))
    return a.crossJoin(nodes.select(F.col("node_id").alias("destination"))).filter("origin <> destination")


def check_parameters(max_routes: int, max_depth: int, beta: float, cutoff: float) -> None:
    if max_routes == 0 and max_depth == 0:
        raise ValueError("max_routes and max_depth cannot both be unlimited")
    if max_routes < 0 or max_depth < 0 or beta < 0 or not 0 <= cutoff <= 1:
        raise ValueError("max_routes, max_depth and beta are not negative, and the cutoff lies in 0 to 1")


def route_sets(spark: SparkSession, net: Network, pairs: DataFrame, method: str = "bfsle", max_routes: int = 0, max_depth: int = 0, max_misses: int = 100, penalty: float = 1.01, seed: int = 0) -> DataFrame:
    """origin, destination, route_id, links (signed by direction), in order of generation; none for equal ends."""
    check_parameters(max_routes, max_depth, 0.0, 0.0)
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    shared = spark.sparkContext.broadcast(net)
    penalised = METHODS[method] == "link-penalisation"

    def run(batches):
        net = shared.value
        for batch in batches:
            rows = []
            for origin, end in zip(batch.column("origin").to_pylist(), batch.column("destination").to_pylist(), strict=True):
                o, d = net.index(origin), net.index(end)
                if o < 0 or d < 0 or o == d:
                    continue
                if penalised:
                    found = link_penalisation(net, o, d, max_routes, max_depth, max_misses, penalty)
                else:
                    found = bfs_link_elimination(net, o, d, max_routes, max_depth, max_misses, penalty, seed)
                for k, route in enumerate(found):
                    es = np.array(route)
                    rows.append((origin, end, k, (net.link[es] * net.direction[es]).tolist()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["origin", "destination", "route_id", "links"])

    ends = pairs.select(F.col("origin").cast("long"), F.col("destination").cast("long")).distinct()
    return ends.mapInArrow(run, "origin long, destination long, route_id long, links array<long>")


def path_size_logit(routes: DataFrame, costs: DataFrame, beta: float = 1.0, cutoff: float = 0.0) -> DataFrame:
    """routes with cost, mask, path_overlap and probability. costs: (link, cost) by signed link.

    One shuffle by pair: the links of a route are exploded once, and everything else is windows over the same key.
    """
    check_parameters(1, 1, beta, cutoff)
    p = 0.5 + 0.5 * (1 - cutoff)
    slack = math.inf if p >= 1 else math.log(p / (1 - p))
    parts = routes.select("origin", "destination", "route_id", F.explode("links").alias("link")).join(costs.select("link", F.col("cost").alias("t")), "link")
    pair = Window.partitionBy("origin", "destination")
    route = Window.partitionBy("origin", "destination", "route_id")
    parts = parts.withColumn("cost", F.sum("t").over(route))
    parts = parts.withColumn("least", F.min("cost").over(pair))
    parts = parts.withColumn("mask", (F.col("least") > 0) & (F.col("cost") <= F.col("least") + F.lit(slack)))
    shared = Window.partitionBy("origin", "destination", "link")
    parts = parts.withColumn("n", F.sum(F.col("mask").cast("int")).over(shared))
    per_route = parts.groupBy("origin", "destination", "route_id").agg(F.first("cost").alias("cost"), F.first("least").alias("least"), F.first("mask").alias("mask"), F.coalesce(F.try_divide(F.sum(F.try_divide("t", "n")), F.first("cost")), F.lit(0.0)).alias("path_overlap"))
    weight = F.when(F.col("mask"), F.pow("path_overlap", F.lit(beta)) * F.exp(F.col("least") - F.col("cost"))).otherwise(0.0)
    per_route = per_route.withColumn("w", weight).withColumn("probability", F.coalesce(F.try_divide("w", F.sum("w").over(pair)), F.lit(0.0)))
    kept = per_route.select("origin", "destination", "route_id", "cost", "mask", F.when(F.col("mask"), F.col("path_overlap")).otherwise(0.0).alias("path_overlap"), "probability")
    return routes.join(kept, ["origin", "destination", "route_id"])


def link_loads(chosen: DataFrame, demand: DataFrame, cores: list[str]) -> DataFrame:
    """link_id, direction and loads: probability times demand, over all routes."""
    carried = chosen.filter("probability > 0").join(demand.select("origin", "destination", *cores), ["origin", "destination"])
    parts = carried.select(F.explode("links").alias("link"), *[(F.col("probability") * F.col(c)).alias(c) for c in cores])
    return parts.groupBy(F.abs("link").alias("link_id"), F.signum(F.col("link").cast("double")).cast("int").alias("direction")).agg(*[F.sum(c).alias(c) for c in cores])


def uses(sets: list[list[tuple[int, int]]], column: str = "links"):
    """Whether a route uses, of any of the sets, all links; (link, 0) is met by either way."""
    def met(link, direction):
        ways = [link * direction] if direction else [link, -link]
        return F.arrays_overlap(F.col(column), F.array(*[F.lit(w).cast("long") for w in ways]))

    whole = [[met(*x) for x in s] for s in sets if s]
    if not whole:
        raise ValueError("a select-link set is empty")
    out = None
    for s in whole:
        each = s[0]
        for m in s[1:]:
            each = each & m
        out = each if out is None else out | each
    return out


def select_link_loads(chosen: DataFrame, demand: DataFrame, cores: list[str], sets: list[list[tuple[int, int]]]) -> tuple[DataFrame, DataFrame]:
    """Loads of the routes that meet the sets, and their demand by pair."""
    hit = chosen.filter(uses(sets))
    od = hit.join(demand.select("origin", "destination", *cores), ["origin", "destination"]).groupBy("origin", "destination").agg(*[F.sum(F.col("probability") * F.col(c)).alias(c) for c in cores])
    return link_loads(hit, demand, cores), od


def sub_area(chosen: DataFrame, demand: DataFrame, core: str, gates: DataFrame, inside: DataFrame) -> DataFrame:
    """Demand between the ends of a sub-area: gates (link signed inwards, node_id inside) and inside (node_id).

    Trips that start or end inside keep that end; others take the node of the first gate they enter by or of the last
    they leave by. Pairs that never touch the area are left out.
    """
    zone = inside.select("node_id").distinct()
    flows = chosen.filter("probability > 0").join(demand.select("origin", "destination", F.col(core).alias("d")), ["origin", "destination"])
    parts = flows.select("origin", "destination", "route_id", (F.col("probability") * F.col("d")).alias("flow"), F.posexplode("links").alias("at", "link"))
    g = F.broadcast(gates.select(F.col("link").alias("g_link"), F.col("node_id").alias("gate")))  # the boundary's links
    crossing = parts.join(g, F.abs("link") == F.abs("g_link")).withColumn("enters", F.col("link") == F.col("g_link"))
    per = crossing.groupBy("origin", "destination", "route_id").agg(F.first("flow").alias("flow"), F.min(F.when(F.col("enters"), F.struct("at", "gate"))).alias("first_in"), F.max(F.when(~F.col("enters"), F.struct("at", "gate"))).alias("last_out"))
    whole = flows.select("origin", "destination", "route_id", (F.col("probability") * F.col("d")).alias("whole"))
    every = whole.join(per.drop("flow"), ["origin", "destination", "route_id"], "left")
    every = every.join(zone.select(F.col("node_id").alias("origin"), F.lit(True).alias("from_inside")), "origin", "left").join(zone.select(F.col("node_id").alias("destination"), F.lit(True).alias("to_inside")), "destination", "left")
    start = F.when(F.col("from_inside"), F.col("origin")).otherwise(F.col("first_in.gate"))
    end = F.when(F.col("to_inside"), F.col("destination")).otherwise(F.col("last_out.gate"))
    return every.select(start.alias("origin"), end.alias("destination"), "whole").na.drop().groupBy("origin", "destination").agg(F.sum("whole").alias(core))
