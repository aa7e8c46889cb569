"""Queries do their whole job: counts and sums of results against the inputs, without the queries' SQL."""

import pytest
from pyspark.sql import functions as F

from wayfare import model
from wayfare.operators import graph, paths, route_choice
from wayfare.queries import QUERIES


def pairs(df):
    return {(r.origin, r.destination) for r in df.select("origin", "destination").distinct().collect()}


EVERY_PAIR = {(o, d) for o in range(1, 26) for d in range(1, 26) if o != d}


def test_route_sets_of_all_pairs(spark, sf_dir):
    assert pairs(QUERIES["route_sets_lp"](spark, sf_dir)) == EVERY_PAIR
    assert pairs(QUERIES["route_sets_bfsle"](spark, sf_dir)) == EVERY_PAIR


def test_subarea_takes_demand_of_all_pairs(spark, sf_dir):
    edges = graph.directed_edges(model.links(spark, sf_dir))
    net = paths.collect_network(edges, list(range(1, 26)), "free_flow_time")
    every = spark.createDataFrame(sorted(EVERY_PAIR), "origin long, destination long")
    signed = (F.col("link_id") * F.col("direction")).alias("link")
    chosen = route_choice.path_size_logit(route_choice.route_sets(spark, net, every, "lp", max_routes=4, max_depth=8, penalty=1.5), edges.select(signed, F.col("free_flow_time").alias("cost")))
    area = [1, 2, 3, 101, 102]
    gates = edges.filter(F.col("b_node").isin(area) & ~F.col("a_node").isin(area)).select(signed, F.col("b_node").alias("node_id"))
    inside = spark.createDataFrame([(n,) for n in area], "node_id long")
    want = {(r.origin, r.destination): r.demand for r in route_choice.sub_area(chosen, model.demand(spark, sf_dir), "demand", gates, inside).collect()}
    got = {(r.origin, r.destination): r.demand for r in QUERIES["subarea_matrix"](spark, sf_dir).collect()}
    assert want and got == pytest.approx(want)


def test_line_segments_of_all_stops(spark, sf_dir):
    trips = {}
    for r in model.stop_events(spark, sf_dir).collect():
        if r.departure <= 86400:
            trips.setdefault((r.pattern_id, r.trip_id), []).append((r.seq, r.stop))
    want = {(f"L{p}_{p}", a[0], a[1], b[1]) for (p, _), x in trips.items() for a, b in zip(sorted(x), sorted(x)[1:], strict=False)}
    got = [tuple(r) for r in QUERIES["line_segments"](spark, sf_dir).collect()]
    assert len(got) == len(want) and set(got) == want
    nodes = QUERIES["transit_vertices"](spark, sf_dir).collect()
    at = lambda kind: {(r.line_id, r.line_seg_idx, r.stop_id) for r in nodes if r.node_type == kind}
    assert at("boarding") == {x[:3] for x in want} and at("alighting") == {(x[0], x[1], x[3]) for x in want}
    place = {r.node_id: (r.line_id, r.line_seg_idx, r.stop_id) for r in nodes}
    edges = QUERIES["transit_edges"](spark, sf_dir).collect()
    ride = [(*place[e.a_node], place[e.b_node][2]) for e in edges if e.edge_type == "on-board"]
    assert len(ride) == len(want) and set(ride) == want
    assert all(place[e.a_node][2] == place[e.b_node][2] for e in edges if e.edge_type == "dwell")


def test_segments_past_the_fourth_stop(spark):
    from wayfare.operators import transit

    rows = [("L_1", k, f"s{k}", f"s{k + 1}", 1.0, 60.0) for k in range(6)] + [("L_1", 5, "s5", "s0", 1.0, 60.0)]
    segments = spark.createDataFrame(rows, "line_id string, line_seg_idx long, from_stop string, to_stop string, freq double, travel_time double")
    stops = spark.createDataFrame([(f"s{k}", float(k), 0.0) for k in range(7)], "stop_id string, lon double, lat double")
    nodes = transit.vertices(segments, stops, spark.createDataFrame([], "taz_id string, lon double, lat double"))
    kinds = [e.edge_type for e in transit.edges(segments, nodes).collect()]
    assert [kinds.count(k) for k in ("on-board", "boarding", "alighting", "dwell")] == [7, 6, 7, 5]


def test_every_trip_is_expanded(spark, sf_dir):
    clean = QUERIES["stop_times_clean"](spark, sf_dir).collect()
    out = QUERIES["frequency_expansion"](spark, sf_dir).collect()
    assert len(out) == 3 * len(clean)
    assert {int(r.trip_id.split("-")[0]) for r in out} == {r.trip_id for r in clean}


def test_rounds_do_not_end_silently(spark):
    way = spark.createDataFrame([(k, k, k + 1, 1, 1.0) for k in range(1, 8)], "link_id long, a_node long, b_node long, direction int, cost double")
    origin = spark.createDataFrame([(1,)], "origin long")
    assert {r.node: r.cost for r in paths.bellman_ford(way, origin, "cost").collect()} == {k: k - 1.0 for k in range(1, 9)}
    with pytest.raises(RuntimeError):
        paths.bellman_ford(way, origin, "cost", max_rounds=3)
    with pytest.raises(ValueError):
        paths.bellman_ford(way.withColumn("cost", -F.col("cost")), origin, "cost")
    spur = way.unionByName(way.select("link_id", F.col("b_node").alias("a_node"), F.col("a_node").alias("b_node"), F.lit(-1).alias("direction"), "cost"))
    zones = spark.createDataFrame([(1,)], "node_id long")
    assert graph.without_dead_ends(spur, zones).count() == 0
    with pytest.raises(RuntimeError):
        graph.without_dead_ends(spur, zones, max_rounds=3)


def test_logit_and_distances_of_all_pairs(spark, sf_dir):
    assert pairs(QUERIES["psl_probabilities"](spark, sf_dir)) == EVERY_PAIR
    assert pairs(QUERIES["distances_and_bearings"](spark, sf_dir)) == EVERY_PAIR
    between = float(model.demand(spark, sf_dir).filter("origin <> destination").agg(F.sum("demand")).first()[0])
    loads = {r.link_id: r.demand for r in QUERIES["psl_link_loads"](spark, sf_dir).collect()}
    assert sum(loads[k] for k in loads if k <= 25) == pytest.approx(between)  # a route's first link is its origin
    demand = {(r.origin, r.destination) for r in model.demand(spark, sf_dir).collect()} & EVERY_PAIR
    # origins of 0 modulo 5 have 31 as the link of their second route, those of 1 of their first
    found = pairs(QUERIES["psl_and_or_select_link"](spark, sf_dir))
    assert {p for p in demand if p[0] % 5 in (0, 1)} <= found <= demand
