import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare import model
from wayfare.operators import zoning
from wayfare.operators.kernels import Network, a_star, delaunay, reachable
from wayfare.operators.mapmatch import match_patterns


def lattice(n=6, blocked=False):
    a, b = [], []
    for i in range(n):
        for j in range(n):
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < n and y < n:
                    a += [i * n + j + 1, x * n + y + 1]
                    b += [x * n + y + 1, i * n + j + 1]
    k = np.arange(len(a))
    return Network(a, b, k // 2 + 1, np.where(k % 2, -1, 1), np.ones(len(a)), {}, [1, n * n], blocked)


def test_a_star_is_dijkstra():
    net = lattice()
    x, y = (net.nodes - 1) // 6 * 1.0, (net.nodes - 1) % 6 * 1.0
    for target in (5, 20, 35):
        cost, path = a_star(net, 0, target, x, y, 1.0)
        assert cost == net.tree(0)[0][target] == len(path)
    assert reachable(net, 0).all()
    one_way = Network([1], [2], [1], [1], [1.0], {}, [1, 2], False)
    assert reachable(one_way, 1).tolist() == [False, True]
    assert a_star(one_way, 1, 0, np.zeros(2), np.zeros(2), 1.0) == (np.inf, [])


def test_delaunay_has_empty_circles():
    points = np.random.RandomState(3).rand(40, 2)
    edges = delaunay(points)
    near = {tuple(sorted((i, int(np.argsort(np.hypot(*(points - points[i]).T))[1])))) for i in range(40)}
    assert near <= set(edges)  # nearest neighbours are always joined
    assert len(edges) <= 3 * 40 - 6
    assert delaunay(np.array([[0.0, 0], [1, 0], [2, 0]])) == [(0, 1), (1, 2)]


def test_zones(spark):
    ring = lambda x: [(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0)]
    zones = spark.createDataFrame([(1, ring(0.0)), (2, ring(1.0))], "zone_id long, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 0.2), (3, 2.3, 0.1), (4, 9.0, 9.0)], "point_id long, lon double, lat double")
    assert {(r.point_id, r.zone_id) for r in zoning.closest_zone(points, zones, 0.7).collect()} == {(1, 1), (2, 2), (3, 2)}
    assert sorted(zoning.extent_hull(points)) == [(0.5, 0.5), (1.5, 0.2), (2.3, 0.1), (9.0, 9.0)]


def test_desire_lines_carry_all_demand(spark, sf_dir):
    centroids = model.nodes(spark, sf_dir).filter("is_centroid")
    demand = model.demand(spark, sf_dir).filter("origin <> destination")
    links = {r.link_id: (r.a_node, r.b_node) for r in zoning.delaunay_links(spark, centroids).collect()}
    loads = zoning.desire_lines(spark, centroids, demand, ["demand"]).collect()
    into = sum(r.demand for r in loads if links[r.link_id][::-1 if r.direction == -1 else 1][1] == 1)
    out = sum(r.demand for r in loads if links[r.link_id][::-1 if r.direction == -1 else 1][0] == 1)
    ends = demand.agg(F.sum(F.when(F.col("destination") == 1, F.col("demand"))), F.sum(F.when(F.col("origin") == 1, F.col("demand")))).first()
    assert into - out == pytest.approx((ends[0] or 0) - (ends[1] or 0))


def test_map_matching_follows_the_shape(spark):
    net = lattice()
    nodes = spark.createDataFrame([(int(i), float((i - 1) // 6) * 100, float((i - 1) % 6) * 100) for i in net.nodes], "node_id long, lon double, lat double")
    stops, shape = [(0.0, 0.0), (300.0, 300.0)], [(0.0, 0.0), (0.0, 300.0), (300.0, 300.0)]
    patterns = spark.createDataFrame([(7, stops, shape), (8, [(0.0, 0.0)], None)], "pattern_id long, stops array<struct<lon:double,lat:double>>, shape array<struct<lon:double,lat:double>>")
    rows = match_patterns(spark, net, nodes, patterns).orderBy("seq").collect()
    assert {r.pattern_id for r in rows} == {7} and len(rows) == 6
    ends = {(int(link), int(d)): (int(net.nodes[t]), int(net.nodes[h])) for link, d, t, h in zip(net.link, net.direction, net.tail, net.head, strict=True)}
    assert [ends[r.link_id, r.direction][1] for r in rows] == [2, 3, 4, 10, 16, 22]
