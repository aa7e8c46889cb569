"""Transit: line segments, travel times, headways, the graph's vertices and edges, hyperpath assignment, preloads."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare.functions.geo import TRANSIT_RADIUS, haversine
from wayfare.operators.kernels import hyperpath
from wayfare.operators.paths import MAX_EDGES
from wayfare.plans.ranking import numbered
from wayfare.plans.staging import cut, small

DWELL, ALIGHT_PENALTY, TINY = 30.0, 480.0, 1e-6


def segment_times(stop_times: DataFrame) -> DataFrame:
    """pattern_id, seq, travel_time: mean of arrival less the departure before it, over the trips of a pattern; seq is
    that of the segment's first stop."""
    w = Window.partitionBy("pattern_id", "trip_id").orderBy("seq")
    legs = stop_times.withColumn("t", F.col("arrival") - F.lag("departure").over(w)).filter("t IS NOT NULL")
    return legs.groupBy("pattern_id", (F.col("seq") - 1).alias("seq")).agg(F.avg("t").alias("travel_time"))


def segment_times_in(stop_times: DataFrame, start: int, end: int) -> DataFrame:
    """Segment times of the period, of the whole day where the period has none, of the period's length where neither has."""
    day = segment_times(stop_times).withColumnRenamed("travel_time", "of_day")
    period = segment_times(stop_times.filter(F.col("departure").between(start, end))).withColumnRenamed("travel_time", "of_period")
    every = stop_times.select("pattern_id", "seq").distinct()
    joined = every.join(period, ["pattern_id", "seq"], "left").join(day, ["pattern_id", "seq"], "left")
    return joined.select("pattern_id", "seq", F.coalesce("of_period", "of_day", F.lit(float(end - start))).alias("travel_time"))


def headways(stop_times: DataFrame, start: int, end: int) -> DataFrame:
    """pattern_id, headway: the least time between arrivals of successive trips at any stop; a stop of a single trip has
    the period's length."""
    inside = stop_times.filter(F.col("departure").between(start, end))
    w = Window.partitionBy("pattern_id", "seq").orderBy("arrival", "trip_id")
    gaps = inside.withColumn("gap", F.col("arrival") - F.lag("arrival").over(w))
    gaps = gaps.withColumn("gap", F.coalesce("gap", F.lead("gap").over(w), F.lit(end - start)))
    return gaps.groupBy("pattern_id").agg(F.min("gap").cast("double").alias("headway"))


def line_segments(stop_times: DataFrame, routes: DataFrame, start: int, end: int, with_headway: bool = True) -> DataFrame:
    """line_id, line_seg_idx, from_stop, to_stop, freq, travel_time of the segments that run in the period."""
    w = Window.partitionBy("pattern_id", "trip_id").orderBy("seq")
    legs = stop_times.filter(F.col("departure").between(start, end)).withColumn("to_stop", F.lead("stop").over(w)).filter("to_stop IS NOT NULL")
    segments = legs.select("pattern_id", "seq", F.col("stop").alias("from_stop"), "to_stop").distinct()
    named = segments.join(small(routes.select("pattern_id", "shortname")), "pattern_id")
    freq = F.when(F.col("headway") == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), F.col("headway"))) if with_headway else F.lit(float("inf"))
    timed = named.join(headways(stop_times, start, end), "pattern_id", "left").join(segment_times_in(stop_times, start, end), ["pattern_id", "seq"], "left")
    return timed.select(F.concat_ws("_", "shortname", F.col("pattern_id").cast("string")).alias("line_id"), F.col("seq").alias("line_seg_idx"), "from_stop", "to_stop", freq.alias("freq"), "travel_time")


def vertices(segments: DataFrame, stops: DataFrame, zones: DataFrame, blocking: bool = True) -> DataFrame:
    """node_id (from 1, in order of type and place), node_type, stop_id, line_id, line_seg_idx, taz_id, lon, lat."""
    blank = {c: F.lit(None).cast(t) for c, t in (("stop_id", "string"), ("line_id", "string"), ("line_seg_idx", "long"), ("taz_id", "string"))}

    def of(kind: int, name: str, df: DataFrame, **given) -> DataFrame:
        return df.select(F.lit(kind).alias("__k"), F.lit(name).alias("node_type"), *[given.get(c, blank[c]).alias(c) for c in blank], "lon", "lat")

    at = lambda stop: segments.select("line_id", F.col("line_seg_idx").cast("long").alias("line_seg_idx"), F.col(stop).cast("string").alias("at")).distinct()
    where = stops.select(F.col("stop_id").cast("string").alias("stop_id"), "lon", "lat")
    board = at("from_stop").join(where, F.col("at") == F.col("stop_id")).distinct()
    alight = at("to_stop").join(where, F.col("at") == F.col("stop_id")).distinct()
    parts = [
        of(1, "stop", where.distinct(), stop_id=F.col("stop_id")),
        of(2, "boarding", board, stop_id=F.col("stop_id"), line_id=F.col("line_id"), line_seg_idx=F.col("line_seg_idx")),
        of(3, "alighting", alight, stop_id=F.col("stop_id"), line_id=F.col("line_id"), line_seg_idx=F.col("line_seg_idx")),
    ]
    kinds = [(4, "origin"), (5, "destination")] if blocking else [(4, "od")]
    parts += [of(k, n, zones, taz_id=F.col("taz_id").cast("string")) for k, n in kinds]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return numbered(every, ["__k", "taz_id", "stop_id", "line_id", "line_seg_idx"], "node_id", 1).drop("__k")


EDGE = ["edge_type", "a_node", "b_node", "trav_time", "freq", "line_id", "line_seg_idx"]


def _edge(df: DataFrame, kind: str, a: str, b: str, time: Column, freq: Column | None = None, line="line_id", seg="line_seg_idx") -> DataFrame:
    get = lambda c: F.col(c) if c in df.columns else F.lit(None)
    return df.select(F.lit(kind).alias("edge_type"), F.col(a).alias("a_node"), F.col(b).alias("b_node"), time.cast("double").alias("trav_time"), (F.lit(float("inf")) if freq is None else freq).alias("freq"), get(line).cast("string").alias("line_id"), get(seg).cast("long").alias("line_seg_idx"))


def edges(segments: DataFrame, nodes: DataFrame, connectors: DataFrame | None = None, transfers: DataFrame | None = None) -> DataFrame:
    """On-board, boarding, alighting and dwell edges, and given connectors and transfers; a_node is the tail. A segment is
    known by its line, index and stops, so trips of a line that differ in stops keep an edge each; a line dwells only
    at the stop where a segment ends and the next begins."""
    node = lambda kind: nodes.filter(F.col("node_type") == kind)
    board = node("boarding").select(F.col("node_id").alias("board"), "line_id", "line_seg_idx", "stop_id")
    alight = node("alighting").select(F.col("node_id").alias("alight"), "line_id", "line_seg_idx", "stop_id")
    stop = node("stop").select(F.col("node_id").alias("at"), "stop_id")
    keys = ["line_id", "line_seg_idx"]
    ends = ["from_stop", "to_stop"]
    riding = segments.select("line_id", F.col("line_seg_idx").cast("long").alias("line_seg_idx"), *[F.col(c).cast("string").alias(c) for c in ends], "freq", "travel_time").dropDuplicates([*keys, *ends])
    start, end = board.withColumnRenamed("stop_id", "from_stop"), alight.withColumnRenamed("stop_id", "to_stop")
    onboard = _edge(riding.join(start, [*keys, "from_stop"]).join(end, [*keys, "to_stop"]), "on-board", "board", "alight", F.col("travel_time"))
    starts = riding.dropDuplicates([*keys, "from_stop"]).select(*keys, F.col("from_stop").alias("stop_id"), "freq")
    boarding = _edge(board.join(starts, [*keys, "stop_id"]).join(stop, "stop_id"), "boarding", "at", "board", F.lit(TINY), F.col("freq"))
    alighting = _edge(alight.join(stop, "stop_id"), "alighting", "alight", "at", F.lit(ALIGHT_PENALTY))
    dwell = _edge(alight.withColumn("line_seg_idx", F.col("line_seg_idx") + 1).join(board, [*keys, "stop_id"]), "dwell", "alight", "board", F.lit(DWELL))
    out = onboard.unionByName(boarding).unionByName(alighting).unionByName(dwell)
    for more in (connectors, transfers):
        if more is not None:
            out = out.unionByName(more.select(*EDGE))
    return numbered(out, ["edge_type", "a_node", "b_node", "line_id", "line_seg_idx"], "link_id", 1)


def grid(lon: Column, lat: Column, cell: float) -> tuple[Column, Column]:
    return F.floor(lon / cell).cast("long"), F.floor(lat / cell).cast("long")


def nearest(points: DataFrame, targets: DataFrame, cell: float) -> DataFrame:
    """point_id, target_id, distance (degrees of both axes, Euclidean) of each point's nearest target within a cell's
    width, by an equi-join on the nine cells around it: no point meets all targets."""
    x, y = grid(F.col("lon"), F.col("lat"), cell)
    near = F.sequence(F.lit(-1), F.lit(1))
    spread = points.select("point_id", F.col("lon").alias("px"), F.col("lat").alias("py"), x.alias("gx"), y.alias("gy")).withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near))
    spread = spread.withColumn("gx", F.col("gx") + F.col("dx")).withColumn("gy", F.col("gy") + F.col("dy"))
    held = targets.select("target_id", F.col("lon").alias("tx"), F.col("lat").alias("ty"), x.alias("gx"), y.alias("gy"))
    d = F.sqrt(F.pow(F.col("px") - F.col("tx"), 2) + F.pow(F.col("py") - F.col("ty"), 2))
    best = spread.join(held, ["gx", "gy"]).withColumn("distance", d).filter(F.col("distance") <= cell).groupBy("point_id").agg(F.min(F.struct("distance", "target_id")).alias("b"))
    return best.select("point_id", "b.target_id", "b.distance")


def within(points: DataFrame, targets: DataFrame, distance: float) -> DataFrame:
    """All (point_id, target_id, distance) up to a distance, by the same cells: a range join."""
    x, y = grid(F.col("lon"), F.col("lat"), distance)
    near = F.sequence(F.lit(-1), F.lit(1))
    spread = points.select("point_id", F.col("lon").alias("px"), F.col("lat").alias("py"), x.alias("gx"), y.alias("gy")).withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near))
    spread = spread.withColumn("gx", F.col("gx") + F.col("dx")).withColumn("gy", F.col("gy") + F.col("dy"))
    held = targets.select("target_id", F.col("lon").alias("tx"), F.col("lat").alias("ty"), x.alias("gx"), y.alias("gy"))
    d = F.sqrt(F.pow(F.col("px") - F.col("tx"), 2) + F.pow(F.col("py") - F.col("ty"), 2))
    return spread.join(held, ["gx", "gy"]).select("point_id", "target_id", d.alias("distance")).filter(F.col("distance") <= distance)


def node_mapping(nodes: DataFrame, blocking: bool = True) -> DataFrame:
    """taz_id, node_id_origin, node_id_destination: the vertices that each zone's trips leave from and arrive at."""
    of = lambda kind, name: nodes.filter(F.col("node_type") == kind).select("taz_id", F.col("node_id").alias(name))
    if blocking:
        return of("origin", "node_id_origin").join(of("destination", "node_id_destination"), "taz_id")
    return of("od", "node_id_origin").withColumn("node_id_destination", F.col("node_id_origin"))


def radius_pairs(points: DataFrame, targets: DataFrame) -> DataFrame:
    """point_id, target_id, distance: targets within each point's own radius. A point looks into the cells around it of
    a grid as wide as the power of two above its radius, so small radii meet few targets whatever the largest is."""
    level = F.ceil(F.log2("radius")).cast("int")
    width = F.pow(F.lit(2.0), F.col("level"))
    near = F.sequence(F.lit(-1), F.lit(1))
    spread = points.filter("radius > 0").select("point_id", F.col("lon").alias("px"), F.col("lat").alias("py"), "radius", level.alias("level"))
    levels = F.broadcast(spread.select("level").distinct())  # at most some thousand powers of two
    spread = spread.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near))
    spread = spread.withColumn("gx", F.floor(F.col("px") / width).cast("long") + F.col("dx")).withColumn("gy", F.floor(F.col("py") / width).cast("long") + F.col("dy"))
    held = targets.select("target_id", F.col("lon").alias("tx"), F.col("lat").alias("ty")).join(levels)
    held = held.withColumn("gx", F.floor(F.col("tx") / width).cast("long")).withColumn("gy", F.floor(F.col("ty") / width).cast("long"))
    d = F.sqrt(F.pow(F.col("px") - F.col("tx"), 2) + F.pow(F.col("py") - F.col("ty"), 2))
    return spread.join(held, ["level", "gx", "gy"]).withColumn("distance", d).filter("distance <= radius").select("point_id", "target_id", "distance")


def overlapping_regions(zones: DataFrame, stops: DataFrame, cell: float, fill_missing: bool = False) -> DataFrame:
    """taz_id, stop_id, distance: every stop that is no farther from a zone than its nearest other zone. Zones without a
    neighbour within a cell's width have no region; with ``fill_missing`` zones without stops get their nearest one."""
    places = zones.select(F.col("taz_id").alias("point_id"), "lon", "lat")
    others = zones.select(F.col("taz_id").alias("target_id"), "lon", "lat")
    apart = within(places, others, cell).filter("point_id <> target_id").groupBy("point_id").agg(F.min("distance").alias("radius"))
    targets = stops.select(F.col("stop_id").alias("target_id"), "lon", "lat")
    out = radius_pairs(places.join(apart, "point_id"), targets)
    if fill_missing:
        missing = places.join(out.select("point_id").distinct(), "point_id", "left_anti")
        out = out.unionByName(nearest(missing, targets, cell))
    return out.select(F.col("point_id").alias("taz_id"), F.col("target_id").alias("stop_id"), "distance")


def access_connectors(pairs: DataFrame, nodes: DataFrame, blocking: bool = True, speed: float = 1.0) -> DataFrame:
    """Edges from origin vertices to stop vertices for pairs (taz_id, stop_id), timed by great-circle distance."""
    o = nodes.filter(F.col("node_type") == ("origin" if blocking else "od")).select("taz_id", F.col("node_id").alias("a_node"), F.col("lon").alias("x1"), F.col("lat").alias("y1"))
    t = nodes.filter("node_type = 'stop'").select("stop_id", F.col("node_id").alias("b_node"), F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    held = pairs.select("taz_id", "stop_id").join(o, "taz_id").join(t, "stop_id")
    time = haversine("x1", "y1", "x2", "y2", TRANSIT_RADIUS) / speed + TINY
    return _edge(held, "access_connector", "a_node", "b_node", time)


def walking_edges(nodes: DataFrame, distance: float, speed: float = 1.0) -> DataFrame:
    """Edges between stop vertices that are up to a distance (degrees) apart, both ways, timed by great-circle distance."""
    stops = nodes.filter("node_type = 'stop'")
    pairs = within(stops.select(F.col("node_id").alias("point_id"), "lon", "lat"), stops.select(F.col("node_id").alias("target_id"), "lon", "lat"), distance).filter("point_id <> target_id")
    at = lambda name, x, y: stops.select(F.col("node_id").alias(name), F.col("lon").alias(x), F.col("lat").alias(y))
    held = pairs.select(F.col("point_id").alias("a_node"), F.col("target_id").alias("b_node")).join(at("a_node", "x1", "y1"), "a_node").join(at("b_node", "x2", "y2"), "b_node")
    return _edge(held, "walking", "a_node", "b_node", haversine("x1", "y1", "x2", "y2", TRANSIT_RADIUS) / speed + TINY)


CONNECTORS = ("nearest_neighbour", "overlapping_regions")


def transit_graph(stop_times: DataFrame, routes: DataFrame, stops: DataFrame, zones: DataFrame, start: int, end: int, cell: float, connectors: str = "nearest_neighbour", blocking: bool = True, walking: float | None = None, inner_transfers: bool = True, outer_transfers: bool = False, speed: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, edges, node mapping) of the lines that run in a period: segments, connectors of zones by one of
    CONNECTORS, transfers, and walking edges between stops up to a distance."""
    if connectors not in CONNECTORS:
        raise ValueError(f"unknown connectors {connectors}; there are {', '.join(CONNECTORS)}")
    segments = line_segments(stop_times, routes, start, end)
    nodes = cut(vertices(segments, stops, zones, blocking))
    mapping = node_mapping(nodes, blocking)
    zones = zones.select(F.col("taz_id").cast("string").alias("taz_id"), "lon", "lat")
    stops_at = stops.select(F.col("stop_id").cast("string").alias("stop_id"), "lon", "lat").distinct()
    if connectors == "nearest_neighbour":
        found = nearest(zones.withColumnRenamed("taz_id", "point_id"), stops_at.withColumnRenamed("stop_id", "target_id"), cell)
        pairs = found.select(F.col("point_id").alias("taz_id"), F.col("target_id").alias("stop_id"))
    else:
        pairs = overlapping_regions(zones, stops_at, cell, fill_missing=True)
    access = access_connectors(pairs, nodes, blocking, speed)
    more = [access, egress(access, mapping).select(*EDGE)]
    if inner_transfers:
        more.append(transfers(nodes, stops, speed).select(*EDGE))
    if outer_transfers:
        more.append(transfers(nodes, stops, speed, inner=False).select(*EDGE))
    if walking is not None:
        more.append(walking_edges(nodes, walking, speed).select(*EDGE))
    joined = more[0]
    for m in more[1:]:
        joined = joined.unionByName(m)
    return nodes, edges(segments, nodes, connectors=joined), mapping


def closest_k(connectors: DataFrame, k: int) -> DataFrame:
    """The k connectors of least travel time of each zone."""
    w = Window.partitionBy("taz_id").orderBy("trav_time", "stop_id")
    return connectors.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")


def egress(access: DataFrame, mapping: DataFrame) -> DataFrame:
    """Access connectors (a origin, b stop) turned into egress ones, to the destination vertex of the same zone."""
    m = mapping.select("node_id_origin", "node_id_destination")
    return access.join(m, F.col("a_node") == F.col("node_id_origin")).select(F.lit("egress_connector").alias("edge_type"), F.col("b_node").alias("a_node"), F.col("node_id_destination").alias("b_node"), "trav_time", "freq", "line_id", "line_seg_idx")


def transfers(nodes: DataFrame, stops: DataFrame, speed: float = 1.0, inner: bool = True) -> DataFrame:
    """Edges between an alighting and a boarding vertex of different lines: at one stop (inner) or at two stops of a
    station, timed by great-circle distance."""
    alight = nodes.filter("node_type = 'alighting'").select(F.col("node_id").alias("a_node"), F.col("stop_id").alias("s1"), F.col("line_id").alias("l1"), F.col("lon").alias("x1"), F.col("lat").alias("y1"))
    board = nodes.filter("node_type = 'boarding'").select(F.col("node_id").alias("b_node"), F.col("stop_id").alias("s2"), "line_id", "line_seg_idx", F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    if inner:
        pairs = alight.join(board, F.col("s1") == F.col("s2")).filter(F.col("l1") != F.col("line_id"))
    else:
        station = stops.select(F.col("stop_id").cast("string").alias("sid"), "parent_station").filter("parent_station IS NOT NULL AND parent_station <> ''")
        a = alight.join(small(station), F.col("s1") == F.col("sid")).drop("sid")
        b = board.join(small(station), F.col("s2") == F.col("sid")).drop("sid")
        pairs = a.join(b, "parent_station").filter((F.col("s1") != F.col("s2")) & (F.col("l1") != F.col("line_id")))
    time = haversine("x1", "y1", "x2", "y2", TRANSIT_RADIUS) / speed + TINY
    kind = "inner_transfer" if inner else "outer_transfer"
    return pairs.select(F.lit(kind).alias("edge_type"), "a_node", "b_node", time.alias("trav_time"), F.lit(float("inf")).alias("freq"), "line_id", "line_seg_idx").distinct()


def assign(spark: SparkSession, transit_edges: DataFrame, demand: DataFrame, origin="origin", destination="destination", flow="demand") -> DataFrame:
    """link_id, volume of optimal strategies: destinations are dealt over the cluster, each task sums its volumes first."""
    bad = transit_edges.filter("a_node IS NULL OR b_node IS NULL OR trav_time IS NULL OR isnan(trav_time) OR trav_time < 0 OR freq IS NULL OR isnan(freq) OR freq < 0").limit(1).count()
    if bad:
        raise ValueError("edges need nodes, and times and frequencies that are not negative")
    if demand.filter(f"{flow} < 0").limit(1).count():
        raise ValueError("demand is negative")
    if transit_edges.limit(MAX_EDGES + 1).count() > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} edges")
    t = transit_edges.select("link_id", "a_node", "b_node", "trav_time", "freq").toArrow().combine_chunks()
    get = lambda c: t.column(c).to_numpy()
    nodes = np.unique(np.concatenate([get("a_node"), get("b_node")]))
    shared = spark.sparkContext.broadcast((np.searchsorted(nodes, get("a_node")), np.searchsorted(nodes, get("b_node")), get("trav_time").astype(float), get("freq").astype(float), get("link_id"), nodes))
    packed = demand.filter(F.col(flow) > 0).groupBy(F.col(destination).alias("d")).agg(F.collect_list(F.struct(F.col(origin).alias("o"), F.col(flow).cast("double").alias("q"))).alias("cells"))

    def run(batches):
        tail, head, time, freq, link, nodes = shared.value
        index = {int(x): i for i, x in enumerate(nodes)}
        total = np.zeros(len(tail))
        for batch in batches:
            for d, cells in zip(batch.column("d").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                if d in index:
                    wanted: dict[int, float] = {}
                    for c in cells:
                        if c["o"] in index:
                            wanted[index[c["o"]]] = wanted.get(index[c["o"]], 0.0) + c["q"]
                    total += hyperpath(tail, head, time, freq, len(nodes), index[d], wanted)[0]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(link[used], pa.int64()), pa.array(total[used], pa.float64())], names=["link_id", "volume"])

    return packed.mapInArrow(run, "link_id long, volume double").groupBy("link_id").agg(F.sum("volume").alias("volume"))


def preload(stop_times: DataFrame, trips: DataFrame, mapping: DataFrame, start: int, end: int, inclusion: str = "start") -> DataFrame:
    """link_id, direction, preload: passenger-car equivalents of trips whose start, end or midpoint lies in the period,
    or any of whose stop times does."""
    spans = stop_times.groupBy("trip_id").agg(F.min("departure").alias("first"), F.max("arrival").alias("last"), F.max(F.col("arrival").between(start, end)).alias("any"))
    tests = {"start": F.col("first").between(start, end), "end": F.col("last").between(start, end), "middle": ((F.col("first") + F.col("last")) / 2).between(start, end), "any": F.col("any")}
    if inclusion not in tests:
        raise ValueError(f"inclusion is one of {', '.join(tests)}")
    running = spans.filter(tests[inclusion]).join(trips.select("trip_id", "pattern_id", "pce"), "trip_id").groupBy("pattern_id").agg(F.sum("pce").alias("pce"))
    return mapping.join(running, "pattern_id").groupBy("link_id", "direction").agg(F.sum("pce").alias("preload"))


def zone_demand(demand: DataFrame, mapping: DataFrame) -> DataFrame:
    """Demand between zones (origin_taz, destination_taz, demand) as demand between origin and destination vertices."""
    o = mapping.select(F.col("taz_id").alias("origin_taz"), F.col("node_id_origin").alias("origin"))
    d = mapping.select(F.col("taz_id").alias("destination_taz"), F.col("node_id_destination").alias("destination"))
    return demand.join(small(o), "origin_taz").join(small(d), "destination_taz").select("origin", "destination", "demand")
