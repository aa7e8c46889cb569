import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare import model
from wayfare.operators import graph, paths, route_choice
from wayfare.operators.assignment import Assignment, TrafficClass, brent
from wayfare.operators.kernels import Network, hyperpath

TRIANGLE = [(1, 1, 3, 2.0), (2, 3, 2, 4.0), (3, 2, 1, 5.0), (4, 1, 4, 0.1), (4, 4, 1, 0.1), (5, 2, 5, 0.1), (5, 5, 2, 0.1), (6, 3, 6, 0.1), (6, 6, 3, 0.1)]


def triangle(blocked=True):
    link, a, b, cost = (np.array(x) for x in zip(*TRIANGLE, strict=True))
    direction = np.array([1, 1, 1, 1, -1, 1, -1, 1, -1])
    return Network(a, b, link, direction, cost, {"c": cost}, [4, 5, 6], blocked)


@pytest.mark.parametrize(("o", "d", "nodes", "links"), [(4, 5, [4, 1, 3, 2, 5], [4, 1, 2, 5]), (5, 4, [5, 2, 1, 4], [5, 3, 4]), (6, 4, [6, 3, 2, 1, 4], [6, 2, 3, 4]), (6, 5, [6, 3, 2, 5], [6, 2, 5]), (4, 6, [4, 1, 3, 6], [4, 1, 6]), (5, 6, [5, 2, 1, 3, 6], [5, 3, 1, 6])])
def test_golden_paths(o, d, nodes, links):
    net = triangle()
    far, into, order = net.tree(net.index(o))
    es = net.path(into, net.index(d))
    assert net.link[es].tolist() == links
    assert [o, *net.nodes[net.head[es]].tolist()] == nodes
    assert net.skims(into, order)["c"][net.index(d)] == pytest.approx(far[net.index(d)])


def test_blocked_centroids_and_unreachable():
    a, b = [1, 2, 3], [2, 3, 4]
    blocked = Network(a, b, [1, 2, 3], [1, 1, 1], [1.0, 1.0, 1.0], {}, [1, 3, 4], True)
    far, _, _ = blocked.tree(blocked.index(1))
    assert far == [0.0, 1.0, 2.0, np.inf]
    free = Network(a, b, [1, 2, 3], [1, 1, 1], [1.0, 1.0, 1.0], {}, [1, 3, 4], False)
    assert free.tree(free.index(1))[0] == [0.0, 1.0, 2.0, 3.0]


def test_loads_conserve_flow():
    net = triangle()
    far, into, order = net.tree(net.index(4))
    at = np.zeros((len(net.nodes), 2))
    at[net.index(5)], at[net.index(6)] = [3, 1], [2, 0]
    load = net.load(into, order, at)
    out = load[net.tail == net.index(4)].sum(axis=0)
    assert out.tolist() == [5, 1]
    assert load[net.head == net.index(5)].sum(axis=0).tolist() == [3, 1]


def test_all_or_nothing_doubles(spark, sf_dir):
    edges = graph.directed_edges(model.links(spark, sf_dir))
    net = paths.collect_network(edges, list(range(1, 26)), "free_flow_time")
    demand = model.demand(spark, sf_dir)
    once = {(r.link_id, r.direction): r.demand for r in paths.all_or_nothing(spark, net, demand, ["demand"]).collect()}
    twice = {(r.link_id, r.direction): r.demand for r in paths.all_or_nothing(spark, net, demand.withColumn("demand", F.col("demand") * 2), ["demand"], 3).collect()}
    assert twice == {k: 2 * v for k, v in once.items()}


def test_equilibrium_laws(spark, sf_dir):
    edges = graph.directed_edges(model.links(spark, sf_dir))
    demand = model.demand(spark, sf_dir).withColumn("demand", F.col("demand") * 300)

    def gap(algorithm, n):
        a = Assignment(spark, edges, list(range(1, 26)), [TrafficClass("car", demand)])
        report = a.execute(algorithm, n, 1e-9).report
        return report[-1]["rgap"]

    msa5, msa25, fw, bfw = gap("msa", 5), gap("msa", 25), gap("fw", 25), gap("bfw", 25)
    assert msa25 < msa5
    assert fw < msa5 and bfw < msa25
    with pytest.raises(ValueError):
        gap("unknown", 1)


def test_preload_and_checks(spark, sf_dir):
    edges = graph.directed_edges(model.links(spark, sf_dir))
    a = Assignment(spark, edges, list(range(1, 26)), [TrafficClass("car", model.demand(spark, sf_dir))])
    a.add_preload(spark.createDataFrame([(1, 1, 500.0)], "link_id long, direction int, preload double"))
    rows = {(r.link_id, r.direction): r for r in a.execute("all-or-nothing").flows.collect()}
    assert rows[1, 1].Preload == 500.0 and rows[1, 1].PCE == rows[1, 1].car + 500.0
    with pytest.raises(ValueError):
        a.add_preload(spark.createDataFrame([(999, 1, 1.0)], "link_id long, direction int, preload double"))
    with pytest.raises(ValueError):
        Assignment(spark, edges.withColumn("capacity", F.lit(0.0)), [1, 2], [TrafficClass("car", model.demand(spark, sf_dir))])


def test_brent():
    g = lambda x: x**3 - 0.2
    assert brent(g, 0, 1, g(0), g(1), 1e-12) == pytest.approx(0.2 ** (1 / 3), abs=1e-9)


INF = float("inf")
LINES = {"L1": 2 / 720, "L2": 2 / 720, "L3": 2 / 1800, "L4": 2 / 360, "inf": INF}
SF = [(0, 2, "L1", 0, 0.5), (0, 1, "L2", 0, 0.5), (2, 15, "inf", 1500, 0.5), (1, 5, "inf", 420, 0.5), (5, 3, "inf", 0, 0), (5, 6, "inf", 0, 0.5), (5, 4, "L3", 0, 0), (3, 6, "L2", 0, 0), (3, 4, "L3", 0, 0), (6, 11, "inf", 360, 0.5), (4, 9, "inf", 240, 0), (9, 7, "inf", 0, 0), (11, 7, "inf", 0, 0), (11, 10, "L3", 0, 0.083333), (11, 8, "L4", 0, 0.416667), (9, 8, "L4", 0, 0), (9, 10, "inf", 0, 0), (7, 10, "L3", 0, 0), (7, 8, "L4", 0, 0), (10, 14, "inf", 240, 0.083333), (8, 13, "inf", 600, 0.416667), (15, 12, "inf", 0, 0.5), (14, 12, "inf", 0, 0.083333), (13, 12, "inf", 0, 0.416667)]
LABELS = [1665, 1470, 1500, 1144.28572, 480, 1050, 1050, 690, 600, 240, 240, 690, 0, 0, 0, 0]


def test_hyperpath_golden():
    tail, head, line, time, volume = zip(*SF, strict=True)
    got, u = hyperpath(tail, head, time, [LINES[x] for x in line], 16, 12, {0: 1.0})
    assert got == pytest.approx(volume, abs=1e-5)
    assert u == pytest.approx(LABELS, rel=1e-6, abs=1e-6)


def test_transit_assignment_tasks_agree(spark):
    from wayfare.operators import transit

    edges = spark.createDataFrame([(i + 1, t, h, float(x), LINES[line]) for i, (t, h, line, x, _) in enumerate(SF)], "link_id long, a_node long, b_node long, trav_time double, freq double")
    demand = spark.createDataFrame([(0, 12, 1.0), (5, 12, 2.0), (99, 12, 1.0), (0, 14, 0.0)], "origin long, destination long, demand double")
    got = {r.link_id: r.volume for r in transit.assign(spark, edges, demand).collect()}
    assert got[24] + got[23] + got[22] == pytest.approx(3.0)
    with pytest.raises(ValueError):
        transit.assign(spark, edges.withColumn("freq", F.lit(-1.0)), demand)


def test_route_set_laws(spark, sf_dir):
    edges = graph.directed_edges(model.links(spark, sf_dir))
    net = paths.collect_network(edges, list(range(1, 26)), "free_flow_time")
    pairs = spark.createDataFrame([(1, 9), (3, 14), (5, 5)], "origin long, destination long")
    one = route_choice.route_sets(spark, net, pairs, "bfsle", max_depth=1).collect()
    assert sorted((r.origin, r.destination) for r in one) == [(1, 9), (3, 14)]
    two = route_choice.route_sets(spark, net, pairs, "bfsle", max_depth=2).collect()
    assert len({(r.origin, r.destination, tuple(r.links)) for r in two}) == len(two)
    assert {tuple(r.links) for r in one} <= {tuple(r.links) for r in two}
    seeds = [{tuple(r.links) for r in route_choice.route_sets(spark, net, pairs, "bfsle", max_depth=2, seed=s).collect()} for s in (1, 2)]
    assert seeds[0] == seeds[1]
    lp = route_choice.route_sets(spark, net, pairs, "lp", max_routes=3, penalty=1.5)
    costs = edges.select((F.col("link_id") * F.col("direction")).alias("link"), F.col("free_flow_time").alias("cost"))
    sums = route_choice.path_size_logit(lp, costs, cutoff=0.2).groupBy("origin", "destination").agg(F.sum("probability").alias("p")).collect()
    assert [r.p for r in sums] == pytest.approx([1.0] * len(sums))
    with pytest.raises(ValueError):
        route_choice.route_sets(spark, net, pairs)


def test_zero_cost_routes_are_masked(spark):
    routes = spark.createDataFrame([(1, 2, 0, [1]), (1, 2, 1, [2])], "origin long, destination long, route_id long, links array<long>")
    costs = spark.createDataFrame([(1, 0.0), (2, 1.0)], "link long, cost double")
    assert {r.mask for r in route_choice.path_size_logit(routes, costs).collect()} == {False}
