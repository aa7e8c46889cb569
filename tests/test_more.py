import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare import model
from wayfare.more_queries import ORACLES, QUERIES
from wayfare.operators import distribution, graph, gtfs, kernels, paths, registers, transit, zoning
from wayfare.operators.assignment import Assignment, TrafficClass
from wayfare.operators.kernels import HEURISTICS, Network, a_star, least_cost_per_metre
from wayfare.sources import tables

LINKS = "link_id long, a_node long, b_node long, direction int, free_flow_time double, capacity double"


def grid_network(n=6):
    """A grid of nodes with costs above straight distances."""
    rng = np.random.RandomState(2)
    lon, lat = np.repeat(np.arange(n), n) * 0.01, np.tile(np.arange(n), n) * 0.01
    a, b = [], []
    for i in range(n * n):
        for j in ((i + 1) if (i + 1) % n else None, i + n if i + n < n * n else None):
            if j is not None:
                a += [i + 1, j + 1]
                b += [j + 1, i + 1]
    cost = 1000 * (1 + rng.rand(len(a)))
    return Network(a, b, np.arange(len(a)), np.ones(len(a)), cost, {}, [1, n * n], False), lon, lat


@pytest.mark.parametrize("heuristic", HEURISTICS)
def test_a_star_over_the_earth_is_dijkstra(heuristic):
    net, lon, lat = grid_network()
    scale = least_cost_per_metre(net, lon, lat)
    for o, d in ((0, 35), (5, 30), (14, 21)):
        cost, es = a_star(net, o, d, lon, lat, scale, heuristic)
        assert cost == pytest.approx(net.tree(o)[0][d]) and net.head[es[-1]] == d


def test_path_result_traces_again():
    net, lon, lat = grid_network()
    path = paths.PathResult(net, lon, lat)
    with pytest.raises(ValueError):
        path.update_trace(3)
    with pytest.raises(ValueError):
        path.set_heuristic("manhattan")
    path.set_heuristic("equirectangular")
    for early, star in ((False, False), (True, False), (False, True)):
        path.compute(1, 36, early, star)
        first = path.cost
        path.update_trace(22)
        other = paths.PathResult(net, lon, lat)
        other.compute(1, 22)
        assert (path.cost, path.links, path.nodes) == (pytest.approx(other.cost), other.links, other.nodes) and path.mileposts[-1] == pytest.approx(path.cost)
        path.update_trace(36)
        assert path.cost == pytest.approx(first)
    path.reset()
    assert path.origin is None and path.heuristics() == list(HEURISTICS)


def test_long_spurs_and_long_paths_reach_the_fixed_point(spark):
    core = [(1, 1, 2, 0), (2, 2, 3, 0), (3, 3, 1, 0)]
    spur = [(100 + i, 3 if i == 0 else 1000 + i, 1001 + i, 0) for i in range(40)]
    links = spark.createDataFrame(core + spur, "link_id long, a_node long, b_node long, direction int")
    zones = spark.createDataFrame([(1,), (2,)], "node_id long")
    kept = graph.without_dead_ends(graph.directed_edges(links), zones)
    assert {r.link_id for r in kept.collect()} == {1, 2, 3}
    with pytest.raises(RuntimeError):
        graph.without_dead_ends(graph.directed_edges(links), zones, max_rounds=3)
    chain = spark.createDataFrame([(i, i, i + 1, 1, 1.0) for i in range(1, 30)], "link_id long, a_node long, b_node long, direction int, t double")
    found = {r.node: r.cost for r in paths.bellman_ford(chain, spark.createDataFrame([(1,)], "origin long"), "t").collect()}
    assert found[30] == 29.0


def test_fit_in_one_task_is_the_fit_by_jobs(spark, monkeypatch):
    rng = np.random.RandomState(6)
    cells = [(int(i), int(j), float(rng.rand() * (rng.rand() > 0.2))) for i in range(1, 8) for j in range(1, 7)]
    seed = spark.createDataFrame(cells, "origin long, destination long, flow double")
    p = spark.createDataFrame([(i, float(i % 4)) for i in range(1, 8)], "zone_id long, production double")
    total = sum(i % 4 for i in range(1, 8))
    a = spark.createDataFrame([(j, total / 6) for j in range(1, 7)], "zone_id long, attraction double")
    results = []
    for most in (4_000_000, 0):
        monkeypatch.setattr(distribution, "TASK_CELLS", most)
        for how in ({"fixed_iterations": 4}, {"tolerance": 1e-3, "max_iterations": 6}):
            out, report = distribution.ipf(seed, p, a, **how)
            results.append((sorted((r.origin, r.destination, round(r.flow, 9)) for r in out.collect()), [(r["iteration"], round(r["error"], 9)) for r in report]))
    assert results[0] == results[2] and results[1] == results[3]


def test_searches_of_several_origins_at_once(monkeypatch):
    rng = np.random.RandomState(3)
    costs = rng.randint(0, 50, 300) / 7.0
    costs[rng.rand(300) < 0.1] = np.inf
    chain = np.arange(1, 200)
    hub = np.arange(2, 102)
    for a, b, cost in ((rng.randint(1, 80, 300), rng.randint(1, 80, 300), costs), (chain[::-1], chain[::-1] + 1, chain / 3.0), (hub, np.ones(100, int), hub / 3.0), (np.array([1, 2, 1]), np.array([2, 3, 3]), np.array([2.0, -1.5, 1.0]))):
        for blocked in (False, True):
            net = Network(a, b, np.arange(len(a)), np.ones(len(a)), cost, {}, [1, 2, 5, 40], blocked)
            origins = list(range(min(20, len(net.nodes))))
            for passes in (3, 4096):
                monkeypatch.setattr(kernels, "EDGES_AT_ONCE", passes)
                net._ranks = None
                assert np.array_equal(net.costs(origins), np.array([net.tree(o)[0] for o in origins]))


def test_supplier_searches_go_over_tasks_and_reach_what_sql_reaches(spark, tmp_path, monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    for keys in ([4], [3, 4, 5, 6, 7, 8], [1, 2, 3, 9, 4]):  # one alone, a run, a gap: 9's links leave the suppliers' nodes
        spark.createDataFrame([(k,) for k in keys], "s_suppkey long").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/supplier.parquet")
        db = duckdb.connect()
        db.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
        for work in (paths.TASK_WORK, (1, 1 << 28)):
            monkeypatch.setattr(paths, "TASK_WORK", work)
            out = QUERIES["supplier_path_costs"](spark, str(tmp_path))
            assert sorted(map(tuple, out.collect())) == sorted(db.execute(ORACLES["supplier_path_costs"]).fetchall())
    assert out.rdd.getNumPartitions() > 4


def test_fit_of_a_computed_seed_stores_no_matrix(spark, sf_dir, monkeypatch):
    seed = F.when(F.col("origin") != F.col("destination"), (F.col("origin") * 5 + F.col("destination") * 3) % 7).cast("double")
    p = spark.createDataFrame([(i, float(i % 4)) for i in range(1, 8)], "zone_id long, production double")
    a = spark.createDataFrame([(j, 2.0 * (j != 4)) for j in range(1, 7)], "zone_id long, attraction double")
    pairs = p.select(F.col("zone_id").alias("origin")).crossJoin(a.select(F.col("zone_id").alias("destination"))).withColumn("flow", seed)
    how = {"fixed_iterations": 4}, {"tolerance": 1e-3, "max_iterations": 6}
    results = lambda s: [(sorted((r.origin, r.destination, round(r.flow, 9)) for r in out.collect()), [(r["iteration"], round(r["error"], 9)) for r in report]) for out, report in (distribution.ipf(s, p, a.withColumn("attraction", F.col("attraction") * 1.2), **h) for h in how)]
    fitted = lambda: sorted((r.origin, r.destination, r.flow) for r in QUERIES["supplier_ipf"](spark, sf_dir).collect())
    in_task, stored, of_suppliers = results(seed), results(pairs), fitted()

    def refuse(df):
        raise AssertionError("the matrix is stored")

    monkeypatch.setattr(distribution, "TASK_CELLS", 0)
    monkeypatch.setattr(distribution, "cut", refuse)
    assert results(seed) == in_task == stored
    again = fitted()
    assert [r[:2] for r in again] == [r[:2] for r in of_suppliers] and np.allclose([r[2] for r in again], [r[2] for r in of_suppliers], rtol=0, atol=1e-6)


def test_assignment_keeps_skims_and_paths(spark, tmp_path):
    links = [(1, 1, 3, 1, 1.0, 10.0), (2, 3, 2, 1, 1.0, 10.0), (3, 1, 4, 1, 1.5, 10.0), (4, 4, 2, 1, 1.5, 10.0)]
    edges = spark.createDataFrame(links, LINKS).withColumn("toll", F.lit(0.5))
    demand = spark.createDataFrame([(1, 2, 30.0)], "origin long, destination long, demand double")
    folder = f"file://{tmp_path}/paths"
    a = Assignment(spark, edges, [1, 2], [TrafficClass("car", demand), TrafficClass("truck", demand, fixed_cost="toll")])
    result = a.execute("msa", 2, 1e-12, skim_fields=("cost", "free_flow_time"), path_folder=folder)
    final = a.final_skims(result, ("cost",))
    assert set(result.skims) == {"car", "truck"} == set(final)
    cost = {c: {(r.origin, r.destination): r.cost for r in result.skims[c]["final"].collect()}[1, 2] for c in final}
    assert cost["truck"] == pytest.approx(cost["car"] + 1.0)  # the class's own toll counts
    blended = {(r.origin, r.destination): r for r in result.skims["car"]["blended"].collect()}[1, 2]
    assert blended.free_flow_time == pytest.approx((2.0 + 3.0) / 2) or blended.free_flow_time == pytest.approx(2.0)
    stored = spark.read.parquet(folder)
    assert {(r.iteration, r["class"]) for r in stored.select("iteration", "class").distinct().collect()} == {(1, "car"), (2, "car"), (1, "truck"), (2, "truck")}
    tables.save_class_skims(result.skims, f"{tmp_path}/skims")
    tables.save_select_links(a.select_links(result, {"s": [(1, 1), (3, 1)]}), f"{tmp_path}/sl")
    assert spark.read.parquet(f"{tmp_path}/sl/car_demand.parquet").first().demand == 30.0
    assert "cost_blended" in spark.read.parquet(f"{tmp_path}/skims/car.parquet").columns


def test_registers_protect_their_rows(spark):
    links = spark.createDataFrame([(1, "cw", "road")], "link_id long, modes string, link_type string")
    modes = spark.createDataFrame([("c", "car", 1.0)], "mode_id string, mode_name string, pce double")
    more = registers.add_mode(modes, "w", "walk")
    assert {r.mode_id for r in more.collect()} == {"c", "w"}
    for bad in (("ww", "x"), ("c", "x"), ("x", "car"), ("x", "no digits 1")):
        with pytest.raises(ValueError):
            registers.add_mode(more, *bad)
    with pytest.raises(ValueError):
        registers.drop_mode(more, links, "w")
    assert registers.drop_mode(registers.add_mode(more, "b", "bicycle"), links, "b").count() == 2
    types = registers.add_link_type(spark.createDataFrame([("z", "centroid_connector"), ("y", "default")], "link_type_id string, link_type string"), "r", "road")
    for name in ("road", "default", "unknown"):
        with pytest.raises(ValueError):
            registers.drop_link_type(types, links, name)
    periods = registers.add_period(spark.createDataFrame([(1, 0, 86400, "day")], tables.SCHEMAS["periods"]), 2, 25200, 36000)
    assert sorted(r.period_id for r in registers.renumber_period(periods, 2, 5).collect()) == [1, 5]
    for edit in (lambda: registers.drop_period(periods, 1), lambda: registers.renumber_period(periods, 1, 3), lambda: registers.add_period(periods, 3, 9, 9)):
        with pytest.raises(ValueError):
            edit()


def test_zones_connect_and_disconnect(spark):
    nodes = spark.createDataFrame([(10, False, 0.2, 0.2), (11, False, 0.8, 0.8), (12, False, 5.0, 5.0)], "node_id long, is_centroid boolean, lon double, lat double")
    nodes = zoning.add_centroid(nodes, 1, 0.5, 0.5)
    with pytest.raises(ValueError):
        zoning.add_centroid(nodes, 1, 0.6, 0.6)
    links = spark.createDataFrame([(1, 10, 11, 0, "road", "cw"), (2, 11, 12, 0, "road", "w")], "link_id long, a_node long, b_node long, direction int, link_type string, modes string")
    ring = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 1.0}]
    zones = spark.createDataFrame([(1, ring)], "zone_id long, ring array<struct<x:double,y:double>>")
    out = zoning.connect_mode(links, nodes, zones, "c", 2, 1.0).cache()
    made = out.filter("link_type = 'centroid_connector'")
    assert made.count() >= 1 and {r.a_node for r in made.collect()} == {1} and {r.b_node for r in made.collect()} <= {10, 11}
    assert zoning.connect_mode(out, nodes, zones, "c", 2, 1.0).count() == out.count()  # connected already
    assert zoning.disconnect_mode(out, 1, "c").count() == 2


FEED = {
    "agency": (["agency_id", "agency_name"], [("A", "Lines")]),
    "stops": (["stop_id", "stop_lat", "stop_lon"], [("s1", 0.0, 0.0), ("s2", 0.0, 1.0), ("s3", 0.0, 2.0)]),
    "routes": (["route_id", "route_type"], [("r1", 3), ("r2", 3)]),
    "trips": (["trip_id", "route_id", "service_id"], [("t1", "r1", "d"), ("t2", "r1", "d"), ("t3", "r2", "d"), ("t4", "r2", "other")]),
    "calendar": (["service_id", "start_date", "end_date", *gtfs.DAYS], [("d", "20240101", "20240131", *[1] * 7), ("other", "20250101", "20250131", *[1] * 7)]),
    "frequencies": (["trip_id", "start_time", "end_time", "headway_secs"], [("t3", "06:00:00", "07:00:00", 1800)]),
    "fare_attributes": (["fare_id", "agency_id", "price", "currency_type", "payment_method", "transfers", "transfer_duration"], [("f", "A", "1.5", "EUR", "0", "", "")]),
    "fare_rules": (["fare_id", "route_id", "origin_id", "destination_id"], [("f", "r1", "", ""), ("f", "", "z1", "z2"), ("unknown", "", "", "")]),
}
TIMES = [(t, k, s, f"{h:02d}:{m:02d}:00", f"{h:02d}:{m:02d}:00") for t, h, stops in (("t1", 8, "123"), ("t2", 9, "123"), ("t3", 5, "13"), ("t4", 5, "12")) for k, (s, m) in enumerate(zip([f"s{c}" for c in stops], (0, 10, 20), strict=False))]


def test_feed_of_a_day(spark):
    feed = {name: spark.createDataFrame(rows, columns) for name, (columns, rows) in FEED.items()}
    feed["stop_times"] = spark.createDataFrame(TIMES, "trip_id string, stop_sequence int, stop_id string, arrival_time string, departure_time string")
    day = gtfs.load_day(feed, "2024-01-15")
    assert {r.trip_id for r in day["trips"].collect()} == {"t1", "t2", "t3-21600", "t3-23400"}
    assert day["patterns"].count() == 2 and day["schedule"].count() == 10
    assert sorted((r.from_stop, r.to_stop) for r in day["route_links"].collect()) == [("s1", "s2"), ("s1", "s3"), ("s2", "s3")]
    assert day["fares"].first().price == 1.5 and day["fares"].first().transfer is None
    assert sorted((r.route_id or 0, r.origin or 0, r.destination or 0) for r in day["fare_rules"].collect()) == [(0, 1, 2), (1, 0, 0)]


def test_transit_chain_carries_all_demand(spark, sf_dir):
    from wayfare.more_queries import _taz
    from wayfare.queries import _stops

    st = model.stop_events(spark, sf_dir)
    routes = spark.range(7).select(F.col("id").alias("pattern_id"), F.concat(F.lit("L"), F.col("id").cast("string")).alias("shortname"))
    for kind in transit.CONNECTORS:
        nodes, edges, mapping = transit.transit_graph(st, routes, _stops(spark, sf_dir), _taz(spark, sf_dir), 0, 86400, 16.0, connectors=kind, walking=4.0, outer_transfers=True)
        types = {r.edge_type for r in edges.select("edge_type").distinct().collect()}
        assert {"access_connector", "egress_connector", "boarding", "on-board", "alighting", "walking"} <= types
    zones = transit.zone_demand(spark.createDataFrame([("1", "7", 5.0), ("3", "9", 7.0)], "origin_taz string, destination_taz string, demand double"), mapping)
    edges = edges.cache()
    loads = transit.assign(spark, edges, zones).join(edges, "link_id")
    out = {r.edge_type: r.v for r in loads.groupBy("edge_type").agg(F.sum("volume").alias("v")).collect()}
    assert out["access_connector"] == pytest.approx(12.0) and out["egress_connector"] == pytest.approx(12.0)


def test_project_parameters_log_and_names(spark, tmp_path):
    project = tables.Project.new(spark, f"file://{tmp_path}/p")
    assert project.parameters() == tables.PARAMETERS and project.log() == []
    project.set_parameters({"assignment": {"rgap": 0.5}})
    assert project.parameters()["assignment"]["rgap"] == 0.5
    project.restore_parameters()
    assert project.parameters() == tables.PARAMETERS
    project.register("m", spark.range(3).toDF("origin"))
    project.describe("m", "n", "three")
    assert project.registered("n").count() == 3
    project.note("one")
    project.close()
    assert project.log() == ["one", "closed"]
    project.clear_log()
    assert project.log() == []
    # a replacement that broke off after the old table was set aside
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    path = fs(f"file://{tmp_path}/p")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(fs(f"file://{tmp_path}/p/links.parquet"), fs(f"file://{tmp_path}/p/.links.old"))
    assert "links" in tables.Project.open(spark, f"file://{tmp_path}/p").tables()
    assert [tables.cores_wanted(n, 8) for n in (0, 3, 20, -2, -20)] == [8, 3, 8, 6, 1]
    with pytest.raises(ValueError):
        tables.cores_wanted(1.5, 8)
