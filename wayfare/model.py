"""A transport model derived, deterministically, from the driver's business tables.

Nations are zones (node n_nationkey + 1), regions are hubs (101 + r_regionkey). Links: a zone and its hub (both ways),
a one-way ring over the zones, one-way chords, and a two-way ring over the hubs. Free-flow times are multiples of
2 ** -10, so sums along paths are exact in any order. Demand is quantity shipped from customers' to suppliers' nations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RING = 25
HUB = 101


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, is_centroid, lon, lat."""
    zones = read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("node_id"), F.lit(True).alias("is_centroid"))
    hubs = read(spark, sf_dir, "region").select((F.col("r_regionkey") + HUB).cast("long").alias("node_id"), F.lit(False).alias("is_centroid"))
    both = zones.unionByName(hubs)
    return both.select("*", ((F.col("node_id") * 37) % 64 / 8.0).cast("double").alias("lon"), ((F.col("node_id") * 23) % 64 / 8.0).cast("double").alias("lat"))


def free_flow(a: Column, b: Column) -> Column:
    return F.lit(1.0) + ((a * 7919 + b * 30011) % 8192) / F.lit(1024.0)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """link_id, a_node, b_node, direction, modes, link_type, distance, free_flow_time_ab/_ba, capacity_ab/_ba."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    key, hub = F.col("n_nationkey").cast("long"), F.col("r_regionkey").cast("long")
    parts = [
        nation.select((key + 1).alias("a_node"), (F.col("n_regionkey").cast("long") + HUB).alias("b_node"), F.lit(0).alias("direction"), F.lit("access").alias("link_type")),
        nation.select((key + 1).alias("a_node"), ((key + 1) % RING + 1).alias("b_node"), F.lit(1).alias("direction"), F.lit("ring").alias("link_type")),
        nation.select((key + 1).alias("a_node"), (((key + 1) * 7 + 3) % RING + 1).alias("b_node"), F.lit(1).alias("direction"), F.lit("chord").alias("link_type")),
        region.select((hub + HUB).alias("a_node"), ((hub + 1) % 5 + HUB).alias("b_node"), F.lit(0).alias("direction"), F.lit("trunk").alias("link_type")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.filter(f"a_node <> b_node AND NOT (link_type = 'chord' AND b_node = a_node % {RING} + 1)")  # no loops, no ring twice
    a, b = F.col("a_node"), F.col("b_node")
    order = Window.orderBy("a_node", "b_node", "link_type")  # a hundred rows
    return every.select(
        F.row_number().over(order).cast("long").alias("link_id"),
        "a_node",
        "b_node",
        F.col("direction").cast("int").alias("direction"),
        F.when((a + b) % 3 == 0, "c").when((a + b) % 3 == 1, "cw").otherwise("cwb").alias("modes"),
        "link_type",
        (((a * 13 + b * 7) % 50 + 1) * 100.0).alias("distance"),
        free_flow(a, b).alias("free_flow_time_ab"),
        free_flow(b, a).alias("free_flow_time_ba"),
        (20000.0 + (a * 31 + b * 17) % 16 * 1000.0).alias("capacity_ab"),
        (20000.0 + (b * 31 + a * 17) % 16 * 1000.0).alias("capacity_ba"),
    )


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per line item: origin, destination, quantity. Small dimensions join by broadcast, orders by key."""
    customer = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") + 1).cast("long").alias("origin"))
    supplier = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") + 1).cast("long").alias("destination"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag")
    return items.join(orders, "l_orderkey").join(customer, "o_custkey").join(supplier, "l_suppkey").select("origin", "destination", F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("class"))


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """origin, destination, demand: summed before anything else happens to the trips."""
    return trips(spark, sf_dir).groupBy("origin", "destination").agg(F.sum("quantity").alias("demand"))


def stop_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transit-like stop times: a trip per user and day, stops by event type; trip_id, pattern_id, seq, stop, arrival, departure."""
    e = read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", "event_type", (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("long").alias("arrival"))
    order = Window.partitionBy("user_id", "day").orderBy("arrival", "event_id")
    return e.select(
        (F.col("user_id") * 100 + F.dayofmonth("day")).cast("long").alias("trip_id"),
        (F.col("user_id") % 7).cast("long").alias("pattern_id"),
        (F.row_number().over(order) - 1).cast("long").alias("seq"),
        F.col("event_type").alias("stop"),
        "arrival",
        (F.col("arrival") + 30).cast("long").alias("departure"),
    )
