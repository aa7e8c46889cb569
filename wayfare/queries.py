"""Queries over the derived model, one per operator, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare import model
from wayfare.functions import clock, geo
from wayfare.functions.vdf import FUNCTIONS
from wayfare.operators import distribution, graph, gtfs, matrix, network, paths, route_choice, transit, zoning
from wayfare.operators.assignment import Assignment, TrafficClass, results_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

FFT = "(1.0 + (({a} * 7919 + {b} * 30011) % 8192) / 1024.0)"
CAP = "(20000.0 + ({a} * 31 + {b} * 17) % 16 * 1000.0)"
LINKS = f"""raw AS (
  SELECT n_nationkey::BIGINT + 1 AS a_node, n_regionkey::BIGINT + 101 AS b_node, 0 AS direction, 'access' AS link_type FROM nation
  UNION ALL SELECT n_nationkey::BIGINT + 1, (n_nationkey::BIGINT + 1) % 25 + 1, 1, 'ring' FROM nation
  UNION ALL SELECT n_nationkey::BIGINT + 1, ((n_nationkey::BIGINT + 1) * 7 + 3) % 25 + 1, 1, 'chord' FROM nation
  UNION ALL SELECT r_regionkey::BIGINT + 101, (r_regionkey::BIGINT + 1) % 5 + 101, 0, 'trunk' FROM region),
links AS (
  SELECT row_number() OVER (ORDER BY a_node, b_node, link_type) AS link_id, a_node, b_node, direction,
    CASE (a_node + b_node) % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'cw' ELSE 'cwb' END AS modes, link_type,
    ((a_node * 13 + b_node * 7) % 50 + 1) * 100.0::DOUBLE AS distance,
    {FFT.format(a="a_node", b="b_node")}::DOUBLE AS free_flow_time_ab, {FFT.format(a="b_node", b="a_node")}::DOUBLE AS free_flow_time_ba,
    {CAP.format(a="a_node", b="b_node")}::DOUBLE AS capacity_ab, {CAP.format(a="b_node", b="a_node")}::DOUBLE AS capacity_ba
  FROM raw WHERE a_node <> b_node AND NOT (link_type = 'chord' AND b_node = a_node % 25 + 1)),
edges AS (
  SELECT link_id, a_node, b_node, 1 AS direction, modes, link_type, distance, free_flow_time_ab AS free_flow_time, capacity_ab AS capacity FROM links WHERE direction <> -1
  UNION ALL SELECT link_id, b_node, a_node, -1, modes, link_type, distance, free_flow_time_ba, capacity_ba FROM links WHERE direction <> 1)"""
TRIPS = """trips AS (
  SELECT c_nationkey::BIGINT + 1 AS origin, s_nationkey::BIGINT + 1 AS destination, l_quantity AS quantity, l_returnflag AS class
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
od AS (SELECT origin, destination, sum(quantity) AS demand FROM trips GROUP BY 1, 2)"""
STOPS = """st AS (
  SELECT user_id * 100 + day(ts) AS trip_id, user_id % 7 AS pattern_id,
    row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY hour(ts) * 3600 + minute(ts) * 60 + second(ts), event_id) - 1 AS seq,
    event_type AS stop, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS arrival, hour(ts) * 3600 + minute(ts) * 60 + second(ts) + 30 AS departure
  FROM events)"""
# labels of all paths of at most 10 edges by least cost to each node, with blocked centroids
REACH = """sp AS (
  SELECT z.origin, z.origin AS node, 0.0::DOUBLE AS cost, 0 AS hops, ''::VARCHAR AS route FROM (SELECT DISTINCT n_nationkey::BIGINT + 1 AS origin FROM nation) z
  UNION ALL
  SELECT origin, node, cost, hops, route FROM (
    SELECT sp.origin, e.b_node AS node, sp.cost + e.free_flow_time AS cost, sp.hops + 1 AS hops, sp.route || (e.link_id * e.direction)::VARCHAR || ',' AS route,
      row_number() OVER (PARTITION BY sp.origin, e.b_node ORDER BY sp.cost + e.free_flow_time) AS k
    FROM sp JOIN edges e ON e.a_node = sp.node WHERE sp.hops < 10 AND (sp.node = sp.origin OR sp.node > 100) AND e.b_node <> sp.origin) WHERE k = 1),
best AS (SELECT origin, node AS destination, min(cost) AS cost, arg_min(route, cost) AS route FROM sp WHERE node < 100 GROUP BY 1, 2)"""


def query(oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _edges(spark, sf):
    return graph.directed_edges(model.links(spark, sf))


def _zones(spark, sf):
    return model.nodes(spark, sf).filter("is_centroid")


def _centroids(spark, sf):
    return sorted(r.node_id for r in _zones(spark, sf).select("node_id").collect())  # 25 zones


def _net(spark, sf, fields=(), blocked=True):
    return paths.collect_network(_edges(spark, sf), _centroids(spark, sf), "free_flow_time", fields, blocked)


# demand and matrices


@query(f"WITH {TRIPS} SELECT origin, destination, demand FROM od")
def od_matrix_from_trips(spark, sf):
    return model.demand(spark, sf)


@query(f"WITH {TRIPS} SELECT origin, sum(demand) AS total FROM od GROUP BY 1")
def od_row_totals(spark, sf):
    return matrix.row_totals(model.demand(spark, sf), "demand")


@query(f"WITH {TRIPS} SELECT destination, sum(demand) AS total FROM od GROUP BY 1")
def od_column_totals(spark, sf):
    return matrix.column_totals(model.demand(spark, sf), "demand")


@query(f"WITH {TRIPS} SELECT origin, destination, demand FROM od WHERE origin = destination")
def od_intrazonal(spark, sf):
    return matrix.intrazonal(model.demand(spark, sf))


@query(f"""WITH {TRIPS}, r AS (SELECT origin, destination, sum(quantity) AS returned FROM trips WHERE class = 'R' GROUP BY 1, 2),
a AS (SELECT origin, destination, sum(quantity) AS accepted FROM trips WHERE class = 'A' GROUP BY 1, 2)
SELECT coalesce(r.origin, a.origin) AS origin, coalesce(r.destination, a.destination) AS destination, coalesce(returned, 0) AS returned, coalesce(accepted, 0) AS accepted
FROM r FULL JOIN a ON r.origin = a.origin AND r.destination = a.destination""")
def od_core_outer_join(spark, sf):
    trips = model.trips(spark, sf)
    part = lambda c, name: matrix.from_trip_list(trips.filter(F.col("class") == c).withColumnRenamed("quantity", name), "origin", "destination", [name])
    return matrix.combine([part("R", "returned"), part("A", "accepted")])


@query(f"WITH {TRIPS}, z AS (SELECT origin AS zone_id FROM od UNION SELECT destination FROM od) SELECT zone_id, row_number() OVER (ORDER BY zone_id) - 1 AS index FROM z")
def od_zone_index(spark, sf):
    return matrix.zone_index(model.demand(spark, sf))


# graphs


@query(f"WITH {LINKS} SELECT link_id, a_node, b_node, direction, modes, link_type, distance, capacity, free_flow_time FROM edges")
def directed_edges(spark, sf):
    return _edges(spark, sf)


@query(f"WITH {LINKS}, e AS (SELECT a_node AS node_id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT b_node, 0, 1 FROM edges) SELECT node_id, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM e GROUP BY 1")
def node_degrees(spark, sf):
    return graph.degrees(_edges(spark, sf))


@query(f"WITH {LINKS}, c AS (SELECT a_node, count(*) AS n_edges FROM edges GROUP BY 1) SELECT a_node, coalesce(sum(n_edges) OVER (ORDER BY a_node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first, n_edges FROM c")
def forward_star_offsets(spark, sf):
    return graph.forward_star(_edges(spark, sf))


@query(f"WITH {LINKS} SELECT link_id, direction, row_number() OVER (ORDER BY link_id, direction) - 1 AS supernet_id FROM edges")
def supernet_ids(spark, sf):
    return graph.supernet_ids(_edges(spark, sf)).select("link_id", "direction", "supernet_id")


@query(f"WITH {LINKS}, n AS (SELECT a_node AS node_id FROM edges UNION SELECT b_node FROM edges) SELECT node_id, row_number() OVER (ORDER BY node_id > 100, node_id) - 1 AS index FROM n")
def node_index(spark, sf):
    return graph.node_index(_edges(spark, sf), _zones(spark, sf))


@query(f"WITH {LINKS} SELECT link_id, direction FROM edges WHERE a_node = 3 OR a_node > 100")
def blocked_edges(spark, sf):
    return graph.usable_from(_edges(spark, sf), _zones(spark, sf), 3).select("link_id", "direction")


@query(f"WITH {LINKS} SELECT link_id, modes FROM links WHERE contains(modes, 'w')")
def mode_filtered_links(spark, sf):
    return graph.of_mode(model.links(spark, sf), "w").select("link_id", "modes")


@query(f"WITH {LINKS} SELECT link_id FROM links WHERE link_id % 5 <> 0")
def exclude_links(spark, sf):
    links = model.links(spark, sf)
    return graph.exclude_links(links, links.filter("link_id % 5 = 0")).select("link_id")


def _with_spurs(spark, sf):
    """The network with two-link spurs and four-link chains hung on hubs."""
    hubs = model.read(spark, sf, "region").select((F.col("r_regionkey").cast("long") + model.HUB).alias("h"))
    spur = hubs.select(F.explode(F.array(F.struct((F.col("h") + 9000).alias("link_id"), F.col("h").alias("a_node"), (F.col("h") + 100).alias("b_node")), F.struct((F.col("h") + 9500).alias("link_id"), (F.col("h") + 100).alias("a_node"), (F.col("h") + 200).alias("b_node")))).alias("x")).select("x.*").withColumn("direction", F.lit(0))
    chain = hubs.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct((F.col("h") * 10 + k + 20000).alias("link_id"), F.when(k == 0, F.col("h")).otherwise(F.col("h") * 10 + k).cast("long").alias("a_node"), F.when(k == 3, F.col("h") - 100).otherwise(F.col("h") * 10 + k + 1).cast("long").alias("b_node")))).alias("x")).select("x.*").withColumn("direction", F.lit(0))
    base = model.links(spark, sf).select("link_id", "a_node", "b_node", "direction")
    return base, spur, chain


@query(f"WITH {LINKS} SELECT link_id, direction FROM edges")
def dead_end_links(spark, sf):
    base, spur, _ = _with_spurs(spark, sf)
    return graph.without_dead_ends(graph.directed_edges(base.unionByName(spur)), _zones(spark, sf)).select("link_id", "direction")


@query(f"""WITH {LINKS}, c AS (SELECT link_id AS chain, [link_id] AS links FROM links
UNION ALL SELECT (r_regionkey + 101) * 10 + 20000, [(r_regionkey + 101) * 10 + 20000, (r_regionkey + 101) * 10 + 20001, (r_regionkey + 101) * 10 + 20002, (r_regionkey + 101) * 10 + 20003] FROM region)
SELECT (SELECT max((r_regionkey + 101) * 10 + 20003) FROM region)::BIGINT * 10 + row_number() OVER (ORDER BY chain) - 1 AS compressed_id, array_to_string(links, ',') AS links FROM c""")
def compressed_links(spark, sf):
    base, _, chain = _with_spurs(spark, sf)
    out = graph.compressed_links(graph.contracted(base.unionByName(chain), _zones(spark, sf)))
    return out.select("compressed_id", F.array_join("links", ",").alias("links"))


@query(f"WITH {LINKS} SELECT direction AS way, sum(free_flow_time) AS free_flow_time, count(*) AS n_links FROM edges GROUP BY 1")
def crosswalk_costs(spark, sf):
    links = model.links(spark, sf)
    walk = graph.contracted(links.select("link_id", "a_node", "b_node", "direction"), _zones(spark, sf))
    return graph.compressed_values(_edges(spark, sf), walk, ["free_flow_time"]).groupBy("way").agg(F.sum("free_flow_time").alias("free_flow_time"), F.sum("n_links").alias("n_links"))


# volume-delay functions: flow is a multiple of the capacity by the link's id

_V = "(link_id % 9) / 4.0 * capacity"
_VDF_SQL = {
    "bpr": ("free_flow_time * (1 + 0.15 * pow(x, 4))", "free_flow_time * 0.15 * 4 * pow(x, 3) / capacity"),
    "bpr2": ("free_flow_time * (1 + 0.15 * pow(x, CASE WHEN x > 1 THEN 8 ELSE 4 END))", "free_flow_time * 0.15 * (CASE WHEN x > 1 THEN 8 ELSE 4 END) * pow(x, CASE WHEN x > 1 THEN 7 ELSE 3 END) / capacity"),
    "conical": ("free_flow_time * (sqrt(pow(9 * (1 - x), 2) + 1.06 * 1.06) - 9 * (1 - x) - 1.06 + 2)", "free_flow_time * (9 / capacity) * (1 - 9 * (1 - x) / sqrt(pow(9 * (1 - x), 2) + 1.06 * 1.06))"),
    "inrets": ("CASE WHEN x <= 1 THEN free_flow_time * (1.1 - 0.95 * x) / (1.1 - x) ELSE free_flow_time * ((1.1 - 0.95) / 0.1) * x * x END", "CASE WHEN x <= 1 THEN free_flow_time * 1.1 * (1 - 0.95) / pow(1.1 - x, 2) / capacity ELSE free_flow_time * ((1.1 - 0.95) / 0.1) * 2 * x / capacity END"),
}
_PARAMETERS = {"bpr": (0.15, 4.0), "bpr2": (0.15, 4.0), "conical": (9.0, 1.06), "inrets": (0.95, 1.0)}


def _vdf_query(name: str, derivative: bool):
    def run(spark, sf):
        e = _edges(spark, sf).withColumn("v", (F.col("link_id") % 9) / 4.0 * F.col("capacity"))
        return e.select("link_id", "direction", F.round(FUNCTIONS[name][derivative]("v", "capacity", "free_flow_time", *_PARAMETERS[name]), 7).alias("value"))

    run.__name__ = f"vdf_{name}" + "_derivative" * derivative
    sql = _VDF_SQL[name][derivative]
    query(f"WITH {LINKS}, t AS (SELECT *, {_V} AS v, (link_id % 9) / 4.0::DOUBLE AS x FROM edges) SELECT link_id, direction, round((CASE WHEN v > 0 THEN {sql} ELSE free_flow_time END)::DOUBLE, 7) AS value FROM t")(run)


for _name in FUNCTIONS:
    _vdf_query(_name, False)
    _vdf_query(_name, True)


# paths


@query(f"WITH RECURSIVE {LINKS}, {REACH} SELECT origin, destination, cost FROM best UNION ALL SELECT DISTINCT n_nationkey::BIGINT + 1, n_nationkey::BIGINT + 1, 0.0 FROM nation WHERE n_nationkey + 1 NOT IN (SELECT destination FROM best WHERE origin = destination)")
def shortest_path_cost(spark, sf):
    return paths.skims(spark, _net(spark, sf), _zones(spark, sf).select(F.col("node_id").alias("origin")))


@query(f"WITH RECURSIVE {LINKS}, {REACH} SELECT origin, destination, cost, rtrim(route, ',') AS links FROM best WHERE origin <> destination")
def shortest_path_links(spark, sf):
    zones = _zones(spark, sf)
    out = paths.shortest_paths(spark, _net(spark, sf), route_choice.all_pairs(zones))
    signed = F.transform(F.zip_with("links", "directions", lambda a, b: a * b), lambda x: x.cast("string"))
    return out.select("origin", "destination", "cost", F.array_join(signed, ",").alias("links"))


@query(f"WITH RECURSIVE {LINKS}, {REACH}, steps AS (SELECT origin, destination, unnest(string_split(rtrim(route, ','), ',')) AS s FROM best WHERE origin <> destination) SELECT origin, destination, sum(distance) AS distance FROM steps JOIN links ON abs(s::BIGINT) = link_id GROUP BY 1, 2")
def skims(spark, sf):
    net = _net(spark, sf, ("distance",))
    out = paths.skims(spark, net, _zones(spark, sf).select(F.col("node_id").alias("origin")), ("distance",))
    return out.filter("origin <> destination").select("origin", "destination", "distance")


@query(f"WITH {LINKS} SELECT a.n_nationkey::BIGINT + 1 AS origin, b.n_nationkey::BIGINT + 1 AS destination FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey AND a.n_regionkey <> b.n_regionkey")
def unreachable_pairs(spark, sf):
    access = _edges(spark, sf).filter("link_type = 'access'")
    return paths.unreachable(spark, paths.collect_network(access, _centroids(spark, sf), "free_flow_time"), _zones(spark, sf))


@query(f"WITH RECURSIVE {LINKS}, {REACH} SELECT origin, destination AS node, cost FROM best WHERE origin <> destination")
def bellman_ford_cost(spark, sf):
    e = _edges(spark, sf)
    origin = _zones(spark, sf).select(F.col("node_id").alias("origin"))
    # blocking: edges out of centroids start paths only; splitting zones into a source and a sink node says the same
    split = e.withColumn("a_node", F.when(F.col("a_node") < 100, F.col("a_node") + 1000).otherwise(F.col("a_node")))
    out = paths.bellman_ford(split, origin.select((F.col("origin") + 1000).alias("origin")), "free_flow_time")
    return out.filter("node < 100").select((F.col("origin") - 1000).alias("origin"), "node", "cost").filter("origin <> node")


_LOADS = f"WITH RECURSIVE {LINKS}, {TRIPS}, {REACH}, used AS (SELECT b.origin, b.destination, demand, string_split(rtrim(route, ','), ',') AS ways FROM best b JOIN od ON b.origin = od.origin AND b.destination = od.destination WHERE b.origin <> b.destination), steps AS (SELECT origin, destination, demand, unnest(ways)::BIGINT AS way FROM used)"


@query(f"{_LOADS} SELECT abs(way) AS link_id, sign(way)::INT AS direction, sum(demand) AS demand FROM steps GROUP BY 1, 2")
def aon_link_loads(spark, sf):
    return paths.all_or_nothing(spark, _net(spark, sf), model.demand(spark, sf), ["demand"])


@query(f"{_LOADS}, l AS (SELECT abs(way) AS link_id, way > 0 AS up, sum(demand) AS d FROM steps GROUP BY 1, 2) SELECT link_id, max(CASE WHEN up THEN d END) AS demand_ab, max(CASE WHEN NOT up THEN d END) AS demand_ba, sum(d) AS demand_tot FROM l GROUP BY 1")
def network_results_pivot(spark, sf):
    return graph.network_columns(aon_link_loads(spark, sf), ["demand"])


@query(f"WITH {TRIPS} SELECT origin, destination, demand, 'intrazonal' AS reason FROM od WHERE origin = destination")
def unassigned_demand(spark, sf):
    return paths.unassigned(model.demand(spark, sf), shortest_path_cost(spark, sf), "demand")


_SETS = {"hub": [(1, 1), (2, 0)], "ring": [(7, 1), (30, 1)]}


def _select(spark, sf):
    found = paths.shortest_paths(spark, _net(spark, sf), route_choice.all_pairs(_zones(spark, sf)))
    return paths.select_link(found, model.demand(spark, sf), _SETS, "demand")


_HIT = f"{_LOADS}, hit AS (SELECT 'hub' AS set_name, * FROM used WHERE list_has_any(ways, ['1', '2', '-2']) UNION ALL SELECT 'ring', * FROM used WHERE list_has_any(ways, ['7', '30']))"


@query(f"{_HIT} SELECT set_name, origin, destination, demand FROM hit")
def select_link_od(spark, sf):
    return _select(spark, sf)[1]


@query(f"{_HIT}, s AS (SELECT set_name, demand, unnest(ways)::BIGINT AS way FROM hit) SELECT set_name, abs(way) AS link_id, sign(way)::INT AS direction, sum(demand) AS load FROM s GROUP BY 1, 2, 3")
def select_link_loads(spark, sf):
    return _select(spark, sf)[0]


# equilibrium


def _assignment(spark, sf, **options):
    demand = model.demand(spark, sf)
    return Assignment(spark, _edges(spark, sf), _centroids(spark, sf), options.pop("classes", None) or [TrafficClass("car", demand)], **options)


def _flows(algorithm, iterations=10):
    def run(spark, sf):
        a = _assignment(spark, sf)
        return a.execute(algorithm, iterations, 1e-6).flows

    return run


for _alg, _title in (("msa", "msa_flows"), ("frank-wolfe", "fw_flows"), ("cfw", "cfw_flows"), ("bfw", "bfw_flows")):
    _f = _flows(_alg)
    _f.__name__ = _title
    query()(_f)


@query(f"{_LOADS}, l AS (SELECT abs(way) AS link_id, sign(way)::INT AS direction, sum(demand) AS v FROM steps GROUP BY 1, 2) SELECT e.link_id, e.direction, coalesce(v, 0) AS car, round(free_flow_time * (1 + 0.15 * pow(coalesce(v, 0) / capacity, 4)), 6) AS congested_time, round(coalesce(v, 0) / capacity, 9) AS voc FROM edges e LEFT JOIN l ON e.link_id = l.link_id AND e.direction = l.direction")
def all_or_nothing_results(spark, sf):
    out = _assignment(spark, sf).execute("all-or-nothing").flows
    return out.select("link_id", "direction", "car", F.round("Congested_Time", 6).alias("congested_time"), F.round("VOC", 9).alias("voc"))


@query()
def multiclass_flows(spark, sf):
    trips = model.trips(spark, sf)
    part = lambda c: matrix.from_trip_list(trips.filter(F.col("class") == c).withColumnRenamed("quantity", "demand"), "origin", "destination", ["demand"])
    classes = [TrafficClass("car", part("R")), TrafficClass("truck", part("A"), pce=2.0, vot=0.5, fixed_cost="distance", fixed_cost_multiplier=0.001)]
    return results_table(_assignment(spark, sf, classes=classes).execute("bfw", 6, 1e-6).flows, ["car", "truck"])


@query(f"WITH {LINKS} SELECT link_id, direction, round(free_flow_time * (1 + 0.15 * pow((capacity / 2 + CASE WHEN link_id % 3 = 0 THEN capacity / 4 ELSE 0 END) / capacity, 4)), 9) AS time FROM edges")
def preloaded_vdf(spark, sf):
    e = _edges(spark, sf)
    pre = e.filter("link_id % 3 = 0").select("link_id", "direction", (F.col("capacity") / 4).alias("preload"))
    joined = e.join(pre, ["link_id", "direction"], "left").withColumn("v", F.col("capacity") / 2 + F.coalesce("preload", F.lit(0.0)))
    return joined.select("link_id", "direction", F.round(FUNCTIONS["bpr"][0]("v", "capacity", "free_flow_time", 0.15, 4.0), 9).alias("time"))


# distribution


def _margins(spark, sf):
    d = model.demand(spark, sf)
    p = d.groupBy(F.col("origin").alias("zone_id")).agg(F.sum("demand").alias("production"))
    a = d.groupBy(F.col("destination").alias("zone_id")).agg(F.sum("demand").alias("attraction"))
    return p, a


_IPF_BASE = f"""WITH {TRIPS}, p AS (SELECT origin, sum(demand) AS production FROM od GROUP BY 1), a AS (SELECT destination, sum(demand) AS attraction FROM od GROUP BY 1)"""


def _ipf_sql(seed: str, rounds: int) -> str:
    sql = f"{_IPF_BASE}, x0 AS ({seed})"
    for k in range(1, rounds + 1):
        sql += f", r{k} AS (SELECT x.origin, any_value(production) / sum(flow) AS f FROM x{k - 1} x JOIN p ON x.origin = p.origin GROUP BY 1), y{k} AS (SELECT x.origin, x.destination, flow * f AS flow FROM x{k - 1} x JOIN r{k} r ON x.origin = r.origin), c{k} AS (SELECT y.destination, any_value(attraction) / sum(flow) AS f FROM y{k} y JOIN a ON y.destination = a.destination GROUP BY 1), x{k} AS (SELECT y.origin, y.destination, flow * f AS flow FROM y{k} y JOIN c{k} c ON y.destination = c.destination)"
    return sql + f" SELECT origin, destination, round(flow, 4) AS flow FROM x{rounds}"


_SEED = "SELECT p.origin, a.destination, (1 + (p.origin * 7 + a.destination * 3) % 11)::DOUBLE AS flow FROM p, a"


@query(_ipf_sql(_SEED, 5))
def ipf_k5(spark, sf):
    p, a = _margins(spark, sf)
    zones = matrix.create_empty(p.select("zone_id"), ["flow"])  # 25 zones squared
    seed = zones.withColumn("flow", (1 + (F.col("origin") * 7 + F.col("destination") * 3) % 11).cast("double"))
    return distribution.ipf(seed, p, a, fixed_iterations=5)[0].withColumn("flow", F.round("flow", 4))


_COST = "(1 + ((p.origin * 13 + a.destination * 5) % 17) / 4.0)::DOUBLE"


def _gravity_query(name: str, sql: str, grav: distribution.GravityModel):
    def run(spark, sf):
        p, a = _margins(spark, sf)
        cost = matrix.create_empty(p.select("zone_id"), []).withColumn("cost", 1 + ((F.col("origin") * 13 + F.col("destination") * 5) % 17) / 4.0)
        return distribution.apply_gravity(cost, p, a, grav, fixed_iterations=3)[0].withColumn("flow", F.round("flow", 4))

    run.__name__ = f"gravity_{name}"
    query(_ipf_sql(f"SELECT p.origin, a.destination, ({sql}) * production * attraction AS flow FROM p, a", 3))(run)


_gravity_query("expo", f"exp(-0.1 * {_COST})", distribution.GravityModel("EXPO", beta=0.1))
_gravity_query("power", f"pow({_COST}, -0.5)", distribution.GravityModel("POWER", alpha=0.5))
_gravity_query("gamma", f"pow({_COST}, 0.2) * exp(-0.1 * {_COST})", distribution.GravityModel("GAMMA", alpha=0.2, beta=0.1))


@query(f"WITH RECURSIVE {LINKS}, {TRIPS}, {REACH} SELECT round(sum(od.demand * b.cost) / sum(od.demand), 6) AS mean_cost FROM od JOIN best b ON od.origin = b.origin AND od.destination = b.destination WHERE od.origin <> od.destination")
def gravity_mean_cost(spark, sf):
    d = model.demand(spark, sf).filter("origin <> destination")
    joined = d.join(shortest_path_cost(spark, sf), ["origin", "destination"])
    return joined.agg(F.round(F.sum(F.col("demand") * F.col("cost")) / F.sum("demand"), 6).alias("mean_cost"))


@query()
def gravity_calibrated(spark, sf):
    d = model.demand(spark, sf).withColumnRenamed("demand", "flow")
    cost = d.select("origin", "destination", (1 + ((F.col("origin") * 13 + F.col("destination") * 5) % 17) / 4.0).alias("cost"))
    fitted, report = distribution.calibrate_gravity(d, cost, "EXPO", max_iterations=3, fixed_iterations=3)
    return spark.createDataFrame([(fitted.function, float(fitted.beta), r["iteration"], float(r["cost"])) for r in report], "function string, beta double, iteration int, mean_cost double")


# route choice on three enumerated routes a pair: by the hubs, by the ring, and by both


def _enumerated(spark, sf):
    pairs = route_choice.all_pairs(_zones(spark, sf))
    k = F.sequence(F.lit(0), F.lit(2))
    return pairs.withColumn("route_id", F.explode(k)).select("origin", "destination", F.col("route_id").cast("long"), F.array(F.col("origin"), (F.col("origin") % 5 + 30 + F.col("route_id")).cast("long"), (F.col("destination") + 60 + F.col("route_id") % 2).cast("long")).alias("links"))


def _route_costs(spark, sf):
    return spark.range(1, 101).select(F.col("id").alias("link"), (1 + (F.col("id") * 37 % 64) / 64.0).alias("cost"))


_ROUTES = """routes AS (SELECT o.n_nationkey::BIGINT + 1 AS origin, d.n_nationkey::BIGINT + 1 AS destination, k AS route_id,
 unnest([o.n_nationkey::BIGINT + 1, (o.n_nationkey + 1) % 5 + 30 + k, d.n_nationkey + 1 + 60 + k % 2]) AS link FROM nation o, nation d, range(3) t(k) WHERE o.n_nationkey <> d.n_nationkey),
priced AS (SELECT *, 1 + (link * 37 % 64) / 64.0::DOUBLE AS t FROM routes),
r1 AS (SELECT *, sum(t) OVER (PARTITION BY origin, destination, route_id) AS cost FROM priced),
r2 AS (SELECT *, min(cost) OVER (PARTITION BY origin, destination) AS least FROM r1),
r3 AS (SELECT *, cost <= least + ln(0.75 / 0.25) AS mask FROM r2),
r4 AS (SELECT *, sum(mask::INT) OVER (PARTITION BY origin, destination, link) AS n FROM r3),
r5 AS (SELECT origin, destination, route_id, any_value(cost) AS cost, any_value(least) AS least, bool_or(mask) AS mask, sum(CASE WHEN n > 0 THEN t / n END) / any_value(cost) AS overlap FROM r4 GROUP BY 1, 2, 3),
r6 AS (SELECT *, CASE WHEN mask THEN overlap * exp(least - cost) ELSE 0 END AS w FROM r5),
psl AS (SELECT origin, destination, route_id, cost, mask, CASE WHEN mask THEN overlap ELSE 0 END AS path_overlap, w / sum(w) OVER (PARTITION BY origin, destination) AS probability FROM r6)"""


def _psl(spark, sf):
    return route_choice.path_size_logit(_enumerated(spark, sf), _route_costs(spark, sf), 1.0, 0.5)


@query(f"WITH {_ROUTES} SELECT origin, destination, route_id, cost, mask, round(path_overlap, 9) AS path_overlap, round(probability, 9) AS probability FROM psl")
def psl_probabilities(spark, sf):
    return _psl(spark, sf).select("origin", "destination", "route_id", "cost", "mask", F.round("path_overlap", 9).alias("path_overlap"), F.round("probability", 9).alias("probability"))


@query(f"WITH {_ROUTES}, {TRIPS} SELECT link AS link_id, 1 AS direction, round(sum(probability * demand), 5) AS demand FROM psl JOIN routes USING (origin, destination, route_id) JOIN od USING (origin, destination) WHERE probability > 0 GROUP BY 1")
def psl_link_loads(spark, sf):
    return route_choice.link_loads(_psl(spark, sf), model.demand(spark, sf), ["demand"]).withColumn("demand", F.round("demand", 5))


@query(f"WITH {_ROUTES}, {TRIPS}, l AS (SELECT origin, destination, route_id, list(link) AS links FROM routes GROUP BY 1, 2, 3) SELECT origin, destination, round(sum(probability * demand), 5) AS demand FROM psl JOIN l USING (origin, destination, route_id) JOIN od USING (origin, destination) WHERE (list_has_all(links, [3, 33]) OR list_has_any(links, [31])) GROUP BY 1, 2")
def psl_and_or_select_link(spark, sf):
    sets = [[(3, 1), (33, 1)], [(31, 0)]]
    return route_choice.select_link_loads(_psl(spark, sf), model.demand(spark, sf), ["demand"], sets)[1].withColumn("demand", F.round("demand", 5))


def _net_pairs(spark, sf):
    return route_choice.all_pairs(_zones(spark, sf))


@query()
def route_sets_lp(spark, sf):
    return route_choice.route_sets(spark, _net(spark, sf), _net_pairs(spark, sf), "lp", max_routes=4, max_depth=8, penalty=1.5)


@query()
def route_sets_bfsle(spark, sf):
    return route_choice.route_sets(spark, _net(spark, sf), _net_pairs(spark, sf), "bfsle", max_routes=4)


@query()
def subarea_matrix(spark, sf):
    sets = route_sets_lp(spark, sf)
    costs = _edges(spark, sf).select((F.col("link_id") * F.col("direction")).alias("link"), F.col("free_flow_time").alias("cost"))
    chosen = route_choice.path_size_logit(sets, costs)
    inside = model.nodes(spark, sf).filter("node_id IN (1, 2, 3, 101, 102)").select("node_id")
    e = _edges(spark, sf)
    gates = e.join(inside.select(F.col("node_id").alias("b_node")), "b_node").join(inside.select(F.col("node_id").alias("a_node")), "a_node", "left_anti").select((F.col("link_id") * F.col("direction")).alias("link"), F.col("b_node").alias("node_id"))
    return route_choice.sub_area(chosen, model.demand(spark, sf), "demand", gates, inside)


# transit on the event log


@query(f"WITH {STOPS}, l AS (SELECT *, lag(departure) OVER (PARTITION BY pattern_id, trip_id ORDER BY seq) AS d FROM st) SELECT pattern_id, seq - 1 AS seq, round(avg(arrival - d), 6) AS travel_time FROM l WHERE d IS NOT NULL GROUP BY 1, 2")
def segment_travel_time(spark, sf):
    return transit.segment_times(model.stop_events(spark, sf)).withColumn("travel_time", F.round("travel_time", 6))


@query(f"""WITH {STOPS}, s AS (SELECT * FROM st WHERE departure BETWEEN 25200 AND 36000), g AS (SELECT *, arrival - lag(arrival) OVER (PARTITION BY pattern_id, seq ORDER BY arrival, trip_id) AS gap FROM s),
h AS (SELECT pattern_id, coalesce(gap, lead(gap) OVER (PARTITION BY pattern_id, seq ORDER BY arrival, trip_id), 10800) AS gap FROM g) SELECT pattern_id, min(gap)::DOUBLE AS headway FROM h GROUP BY 1""")
def pattern_headway(spark, sf):
    return transit.headways(model.stop_events(spark, sf), 25200, 36000)


@query(f"""WITH {STOPS}, spans AS (SELECT trip_id, pattern_id, min(departure) AS f, max(arrival) AS l FROM st GROUP BY 1, 2) SELECT pattern_id + 1 AS link_id, 1 AS direction, (count(*) * 3.5)::DOUBLE AS preload FROM spans WHERE (f + l) / 2.0 BETWEEN 28800 AND 43200 GROUP BY 1""")
def pt_preload(spark, sf):
    st = model.stop_events(spark, sf)
    trips = st.select("trip_id", "pattern_id").distinct().withColumn("pce", F.lit(3.5))
    mapping = spark.range(7).select(F.col("id").alias("pattern_id"), (F.col("id") + 1).alias("link_id"), F.lit(1).alias("direction"))
    return transit.preload(st, trips, mapping, 28800, 43200, "middle")


def _lines(spark, sf):
    st = model.stop_events(spark, sf)
    routes = spark.range(7).select(F.col("id").alias("pattern_id"), F.concat(F.lit("L"), F.col("id").cast("string")).alias("shortname"))
    return transit.line_segments(st, routes, 0, 86400)


def _stops(spark, sf):
    names = model.read(spark, sf, "events").select("event_type").distinct()
    k = F.row_number().over(Window.orderBy("event_type"))
    return names.select(F.col("event_type").alias("stop_id"), (k * 1.5).cast("double").alias("lon"), (k * 0.5).cast("double").alias("lat"), F.lit("S").alias("parent_station"))


@query(f"""WITH {STOPS}, f AS (SELECT * FROM st WHERE departure BETWEEN 0 AND 86400), l AS (SELECT *, lead(stop) OVER (PARTITION BY pattern_id, trip_id ORDER BY seq) AS t FROM f) SELECT DISTINCT 'L' || pattern_id || '_' || pattern_id AS line_id, seq AS line_seg_idx, stop AS from_stop, t AS to_stop FROM l WHERE t IS NOT NULL""")
def line_segments(spark, sf):
    return _lines(spark, sf).select("line_id", "line_seg_idx", "from_stop", "to_stop")


def _transit_graph(spark, sf):
    segments = _lines(spark, sf)
    zones = model.nodes(spark, sf).filter("is_centroid").select(F.col("node_id").cast("string").alias("taz_id"), "lon", "lat")
    nodes = transit.vertices(segments, _stops(spark, sf), zones)
    return segments, nodes


_SEGMENTS = f"""{STOPS}, f AS (SELECT * FROM st WHERE departure BETWEEN 0 AND 86400),
legs AS (SELECT *, lead(stop) OVER (PARTITION BY pattern_id, trip_id ORDER BY seq) AS to_stop FROM f),
gaps AS (SELECT *, arrival - lag(arrival) OVER (PARTITION BY pattern_id, seq ORDER BY arrival, trip_id) AS gap FROM f),
filled AS (SELECT pattern_id, coalesce(gap, lead(gap) OVER (PARTITION BY pattern_id, seq ORDER BY arrival, trip_id), 86400) AS gap FROM gaps),
headway AS (SELECT pattern_id, min(gap)::DOUBLE AS headway FROM filled GROUP BY 1),
day AS (SELECT pattern_id, seq - 1 AS seq, avg(t) AS of_day FROM (SELECT *, arrival - lag(departure) OVER (PARTITION BY pattern_id, trip_id ORDER BY seq) AS t FROM st) WHERE t IS NOT NULL GROUP BY 1, 2),
period AS (SELECT pattern_id, seq - 1 AS seq, avg(t) AS of_period FROM (SELECT *, arrival - lag(departure) OVER (PARTITION BY pattern_id, trip_id ORDER BY seq) AS t FROM f) WHERE t IS NOT NULL GROUP BY 1, 2),
segments AS (SELECT 'L' || s.pattern_id || '_' || s.pattern_id AS line_id, s.seq AS line_seg_idx, from_stop, to_stop, CASE WHEN headway = 0 THEN 'inf'::DOUBLE ELSE 1.0::DOUBLE / headway END AS freq, coalesce(of_period, of_day, 86400.0) AS travel_time
  FROM (SELECT DISTINCT pattern_id, seq, stop AS from_stop, to_stop FROM legs WHERE to_stop IS NOT NULL) s LEFT JOIN headway h ON s.pattern_id = h.pattern_id
  LEFT JOIN period p ON s.pattern_id = p.pattern_id AND s.seq = p.seq LEFT JOIN day d ON s.pattern_id = d.pattern_id AND s.seq = d.seq),
places AS (SELECT event_type AS stop_id, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events)),
kinds AS (SELECT 1 AS k, 'stop' AS node_type, stop_id, NULL AS line_id, NULL::BIGINT AS line_seg_idx, NULL AS taz_id, k * 1.5::DOUBLE AS lon, k * 0.5::DOUBLE AS lat FROM places
  UNION ALL SELECT 2, 'boarding', stop_id, line_id, line_seg_idx, NULL, k * 1.5, k * 0.5 FROM (SELECT DISTINCT line_id, line_seg_idx, from_stop FROM segments) JOIN places ON from_stop = stop_id
  UNION ALL SELECT 3, 'alighting', stop_id, line_id, line_seg_idx, NULL, k * 1.5, k * 0.5 FROM (SELECT DISTINCT line_id, line_seg_idx, to_stop FROM segments) JOIN places ON to_stop = stop_id
  UNION ALL SELECT t.k, CASE t.k WHEN 4 THEN 'origin' ELSE 'destination' END, NULL, NULL, NULL, (n_nationkey + 1)::VARCHAR, ((n_nationkey + 1) * 37) % 64 / 8.0, ((n_nationkey + 1) * 23) % 64 / 8.0 FROM nation, (VALUES (4), (5)) t(k)),
vertices AS (SELECT row_number() OVER (ORDER BY k, taz_id NULLS FIRST, stop_id NULLS FIRST, line_id NULLS FIRST, line_seg_idx NULLS FIRST) AS node_id, node_type, stop_id, line_id, line_seg_idx, taz_id, lon::DOUBLE AS lon, lat::DOUBLE AS lat FROM kinds),
board AS (SELECT * FROM vertices WHERE node_type = 'boarding'), alight AS (SELECT * FROM vertices WHERE node_type = 'alighting'), stops AS (SELECT * FROM vertices WHERE node_type = 'stop'),
transfers AS (SELECT DISTINCT 'inner_transfer' AS edge_type, a.node_id AS a_node, b.node_id AS b_node, 1e-6::DOUBLE AS trav_time, 'inf'::DOUBLE AS freq, b.line_id, b.line_seg_idx FROM alight a JOIN board b ON a.stop_id = b.stop_id AND a.line_id <> b.line_id),
ways AS (SELECT 'on-board' AS edge_type, b.node_id AS a_node, a.node_id AS b_node, travel_time AS trav_time, 'inf'::DOUBLE AS freq, s.line_id, s.line_seg_idx FROM segments s JOIN board b ON s.line_id = b.line_id AND s.line_seg_idx = b.line_seg_idx AND from_stop = b.stop_id JOIN alight a ON s.line_id = a.line_id AND s.line_seg_idx = a.line_seg_idx AND to_stop = a.stop_id
  UNION ALL SELECT 'boarding', t.node_id, b.node_id, 1e-6, freq, b.line_id, b.line_seg_idx FROM board b JOIN (SELECT DISTINCT line_id, line_seg_idx, from_stop, freq FROM segments) s ON s.line_id = b.line_id AND s.line_seg_idx = b.line_seg_idx AND from_stop = b.stop_id JOIN stops t ON t.stop_id = b.stop_id
  UNION ALL SELECT 'alighting', a.node_id, t.node_id, 480.0, 'inf'::DOUBLE, a.line_id, a.line_seg_idx FROM alight a JOIN stops t ON t.stop_id = a.stop_id
  UNION ALL SELECT 'dwell', a.node_id, b.node_id, 30.0, 'inf'::DOUBLE, b.line_id, b.line_seg_idx FROM alight a JOIN board b ON a.line_id = b.line_id AND a.line_seg_idx + 1 = b.line_seg_idx AND a.stop_id = b.stop_id
  UNION ALL SELECT * FROM transfers)"""


@query(f"WITH {_SEGMENTS} SELECT * FROM vertices")
def transit_vertices(spark, sf):
    return _transit_graph(spark, sf)[1]


@query(f"WITH {_SEGMENTS} SELECT row_number() OVER (ORDER BY edge_type, a_node, b_node, line_id NULLS FIRST, line_seg_idx NULLS FIRST) AS link_id, * FROM ways")
def transit_edges(spark, sf):
    segments, nodes = _transit_graph(spark, sf)
    return transit.edges(segments, nodes, transfers=transit.transfers(nodes, _stops(spark, sf)))


@query(f"WITH {_SEGMENTS} SELECT * FROM transfers")
def transfer_edges(spark, sf):
    nodes = _transit_graph(spark, sf)[1]
    return transit.transfers(nodes, _stops(spark, sf))


@query(f"WITH {_SEGMENTS} SELECT DISTINCT line_id, freq FROM segments")
def line_frequency(spark, sf):
    return _lines(spark, sf).select("line_id", "freq").distinct()


@query("""WITH z AS (SELECT n_nationkey + 1 AS p, ((n_nationkey + 1) * 37) % 64 / 8.0 AS x, ((n_nationkey + 1) * 23) % 64 / 8.0 AS y FROM nation),
h AS (SELECT r_regionkey + 101 AS t, ((r_regionkey + 101) * 37) % 64 / 8.0 AS x, ((r_regionkey + 101) * 23) % 64 / 8.0 AS y FROM region),
d AS (SELECT p, t, sqrt(pow(z.x - h.x, 2) + pow(z.y - h.y, 2)) AS d FROM z, h)
SELECT p::BIGINT AS point_id, arg_min(t, d * 1000 + t / 1e6)::BIGINT AS target_id, round(min(d), 9) AS distance FROM d WHERE d <= 4 GROUP BY 1""")
def nearest_connectors(spark, sf):
    n = model.nodes(spark, sf)
    out = transit.nearest(n.filter("is_centroid").select(F.col("node_id").alias("point_id"), "lon", "lat"), n.filter("NOT is_centroid").select(F.col("node_id").alias("target_id"), "lon", "lat"), 4.0)
    return out.withColumn("distance", F.round("distance", 9))


@query("""WITH z AS (SELECT n_nationkey + 1 AS p, ((n_nationkey + 1) * 37) % 64 / 8.0 AS x, ((n_nationkey + 1) * 23) % 64 / 8.0 AS y FROM nation)
SELECT a.p::BIGINT AS point_id, b.p::BIGINT AS target_id, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 9) AS distance FROM z a, z b WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 2""")
def range_join(spark, sf):
    z = model.nodes(spark, sf).filter("is_centroid")
    out = transit.within(z.select(F.col("node_id").alias("point_id"), "lon", "lat"), z.select(F.col("node_id").alias("target_id"), "lon", "lat"), 2.0)
    return out.withColumn("distance", F.round("distance", 9))


@query()
def hyperpath_volumes(spark, sf):
    e = _edges(spark, sf)
    w = Window.orderBy("link_id", "direction")
    te = e.select(F.row_number().over(w).cast("long").alias("link_id"), "a_node", "b_node", F.col("free_flow_time").alias("trav_time"), (1 / (1 + F.col("link_id") % 5)).alias("freq"))
    return transit.assign(spark, te, model.demand(spark, sf).filter("origin <> destination"))


# GTFS


@query("SELECT s AS service_id, d::DATE AS date FROM range(5) t(s), generate_series(DATE '2024-01-01', DATE '2024-02-29', INTERVAL 1 DAY) g(d) WHERE (isodow(d::DATE) - 1 + s) % 7 < 5 AND NOT (d::DATE = DATE '2024-01-15') UNION SELECT s, DATE '2024-03-10' FROM range(5) t(s)")
def service_calendar(spark, sf):
    base = spark.range(5).select(F.col("id").alias("service_id"), F.lit("20240101").alias("start_date"), F.lit("20240229").alias("end_date"), *[F.when((F.lit(k) + F.col("id")) % 7 < 5, 1).otherwise(0).alias(d) for k, d in enumerate(gtfs.DAYS)])
    odd = spark.range(5).select(F.col("id").alias("service_id"), F.explode(F.array(F.struct(F.lit("20240115").alias("date"), F.lit(2).alias("exception_type")), F.struct(F.lit("20240310").alias("date"), F.lit(1).alias("exception_type")))).alias("x")).select("service_id", "x.*")
    return gtfs.service_days(base, odd)


_CLEAN = f"WITH {STOPS}, n AS (SELECT *, lead(stop) OVER (PARTITION BY trip_id ORDER BY seq) AS nx FROM st), k AS (SELECT * FROM n WHERE (nx IS NULL OR nx <> stop) AND stop <> 'error'), clean AS (SELECT trip_id, stop AS stop_id, seq AS stop_sequence, departure AS arrival, departure, row_number() OVER (PARTITION BY trip_id ORDER BY seq) - 1 AS seq FROM k)"


def _clean(spark, sf):
    rows = model.stop_events(spark, sf).select("trip_id", F.col("seq").alias("stop_sequence"), F.col("stop").alias("stop_id"), "arrival", "departure")
    return gtfs.clean_stop_times(rows, _stops(spark, sf).filter("stop_id <> 'error'"))


@query(f"{_CLEAN} SELECT * FROM clean")
def stop_times_clean(spark, sf):
    return _clean(spark, sf)


@query(f"{_CLEAN} SELECT trip_id, (trip_id // 100) % 7 AS route_id, md5(((trip_id // 100) % 7)::VARCHAR || string_agg(stop_id, '' ORDER BY seq)) AS pattern_hash FROM clean GROUP BY 1")
def trip_patterns_md5(spark, sf):
    rows = _clean(spark, sf)
    trips = rows.select("trip_id").distinct().withColumn("route_id", F.floor(F.col("trip_id") / 100) % 7)
    return gtfs.pattern_hashes(rows, trips)


@query(f"{_CLEAN} SELECT DISTINCT trip_id FROM st WHERE trip_id NOT IN (SELECT trip_id FROM clean)")
def trips_without_stops(spark, sf):
    trips = model.stop_events(spark, sf).select("trip_id").distinct()
    return trips.join(_clean(spark, sf), "trip_id", "left_anti")


@query(f"{_CLEAN}, f AS (SELECT trip_id, min(departure) AS d FROM clean GROUP BY 1) SELECT c.trip_id || '-' || (d + k * 1800) AS trip_id, stop_id, seq, arrival + k * 1800 AS arrival, departure + k * 1800 AS departure FROM clean c JOIN f ON c.trip_id = f.trip_id, range(3) t(k)")
def frequency_expansion(spark, sf):
    rows = _clean(spark, sf)
    freq = rows.groupBy("trip_id").agg(F.min("departure").alias("start")).select("trip_id", "start", (F.col("start") + 5400).alias("end"), F.lit(1800).cast("long").alias("headway_secs"))
    return gtfs.expand_frequencies(freq, rows)


@query("SELECT event_id, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS seconds FROM events")
def clock_seconds(spark, sf):
    return model.read(spark, sf, "events").select("event_id", clock.to_seconds(F.date_format("ts", "H:m:s")).alias("seconds"))


# network tables


@query(f"WITH {LINKS}, e AS (SELECT a_node AS n, modes, link_type FROM links UNION ALL SELECT b_node, modes, link_type FROM links), c AS (SELECT n, unnest(string_split(modes, '')) AS m FROM e) SELECT n AS node_id, (SELECT string_agg(DISTINCT m, '' ORDER BY m) FROM c WHERE c.n = e.n) AS modes, count(DISTINCT link_type) AS n_link_types FROM e GROUP BY 1")
def node_modes(spark, sf):
    return network.node_modes(model.links(spark, sf))


@query(f"WITH {LINKS} SELECT r_regionkey::BIGINT + 101 AS node_id FROM region WHERE r_regionkey + 101 NOT IN (SELECT a_node FROM links WHERE link_type = 'ring' UNION SELECT b_node FROM links WHERE link_type = 'ring')")
def orphan_nodes(spark, sf):
    return network.orphans(model.nodes(spark, sf), model.links(spark, sf).filter("link_type = 'ring'")).select("node_id")


@query(f"WITH {LINKS} SELECT 'modes are known' AS rule, link_id::VARCHAR AS id FROM links WHERE contains(modes, 'b') UNION ALL SELECT 'link types are known', link_id::VARCHAR FROM links WHERE link_type = 'trunk'")
def rule_violations(spark, sf):
    modes = spark.createDataFrame([("c", "car"), ("w", "walk")], "mode_id string, mode_name string")
    types = spark.createDataFrame([("access",), ("ring",), ("chord",)], "link_type string")
    return network.violations(model.links(spark, sf), model.nodes(spark, sf), modes, types)


@query(f"WITH {LINKS} SELECT link_id, CASE WHEN a_node < 100 THEN a_node + 500 ELSE a_node END AS a_node, CASE WHEN b_node < 100 THEN b_node + 500 ELSE b_node END AS b_node FROM links")
def renumber_nodes(spark, sf):
    n = model.nodes(spark, sf)
    mapping = n.filter("is_centroid").select("node_id", (F.col("node_id") + 500).alias("new_id"))
    return network.renumber(model.links(spark, sf), n, mapping)[0].select("link_id", "a_node", "b_node")


@query(f"WITH {LINKS} SELECT link_id + CASE WHEN direction = -1 THEN (SELECT max(link_id) FROM links) ELSE 0 END AS link_id, a_node AS from_node_id, b_node AS to_node_id, true AS directed, distance / 1000 AS length, link_type AS facility_type, modes AS allowed_uses FROM edges")
def gmns_links(spark, sf):
    return network.to_gmns(model.links(spark, sf))


@query("""WITH w AS (SELECT n_nationkey AS way_id, [n_nationkey * 3, n_nationkey * 3 + 1, n_nationkey * 3 + 2, (n_nationkey * 3 + 3) % 75, (n_nationkey * 3 + 4) % 75] AS nodes FROM nation),
u AS (SELECT way_id, generate_subscripts(nodes, 1) - 1 AS k, unnest(nodes) AS node FROM w), s AS (SELECT *, count(*) OVER (PARTITION BY node) > 1 AS shared FROM u),
c AS (SELECT * FROM s WHERE k IN (0, 4) OR shared), l AS (SELECT way_id, node AS a_node, lead(node) OVER (PARTITION BY way_id ORDER BY k) AS b_node, row_number() OVER (PARTITION BY way_id ORDER BY k) - 1 AS part, lead(k) OVER (PARTITION BY way_id ORDER BY k) AS t FROM c)
SELECT way_id::BIGINT AS way_id, part, a_node::BIGINT AS a_node, b_node::BIGINT AS b_node FROM l WHERE t IS NOT NULL""")
def osm_split_links(spark, sf):
    k = F.col("n_nationkey").cast("long")
    ways = model.read(spark, sf, "nation").select(k.alias("way_id"), F.array(*[(k * 3 + i) % 75 if i > 2 else k * 3 + i for i in range(5)]).alias("nodes"))
    return network.osm_links(ways).select("way_id", "part", "a_node", "b_node")


@query(f"WITH {LINKS} SELECT count(*) AS n_links, 30::BIGINT AS n_nodes, 25::BIGINT AS n_centroids FROM links")
def network_counts(spark, sf):
    return network.counts(model.links(spark, sf), model.nodes(spark, sf)).select("n_links", "n_nodes", "n_centroids")


@query("""WITH z AS (SELECT n_nationkey::BIGINT + 1 AS node_id, ((n_nationkey + 1) * 37) % 64 / 8.0 AS x, ((n_nationkey + 1) * 23) % 64 / 8.0 AS y FROM nation)
SELECT a.node_id AS origin, b.node_id AS destination, round(2 * 6371000 * asin(sqrt(pow(sin((radians(b.y) - radians(a.y)) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin((radians(b.x) - radians(a.x)) / 2), 2))), 3) AS metres, round(degrees(atan2(abs(b.y - a.y), abs(b.x - a.x))), 9) AS bearing FROM z a, z b WHERE a.node_id <> b.node_id""")
def distances_and_bearings(spark, sf):
    z = model.nodes(spark, sf).filter("is_centroid").select("node_id", "lon", "lat")
    a, b = z.toDF("origin", "x1", "y1"), z.toDF("destination", "x2", "y2")
    pairs = a.crossJoin(b).filter("origin <> destination")
    return pairs.select("origin", "destination", F.round(geo.haversine("x1", "y1", "x2", "y2"), 3).alias("metres"), F.round(geo.bearing("x1", "y1", "x2", "y2"), 9).alias("bearing"))


# geometry


@query()
def desire_line_loads(spark, sf):
    return zoning.desire_lines(spark, _zones(spark, sf), model.demand(spark, sf).filter("origin <> destination"), ["demand"])


def _squares(spark, sf):
    k = F.col("node_id") - 101
    x, y = (k % 3 * 2.5).cast("double"), (F.floor(k / 3) * 4.0).cast("double")
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    return model.nodes(spark, sf).filter("NOT is_centroid").select(F.col("node_id").alias("zone_id"), F.array(corner(0.0, 0.0), corner(2.5, 0.0), corner(2.5, 4.0), corner(0.0, 4.0)).alias("ring"))


@query("""WITH z AS (SELECT n_nationkey::BIGINT + 1 AS point_id, ((n_nationkey + 1) * 37) % 64 / 8.0 + 0.01 AS x, ((n_nationkey + 1) * 23) % 64 / 8.0 + 0.01 AS y FROM nation),
s AS (SELECT r_regionkey::BIGINT + 101 AS zone_id, r_regionkey % 3 * 2.5 AS x0, (r_regionkey // 3) * 4.0 AS y0 FROM region)
SELECT point_id, min(zone_id) AS zone_id FROM z JOIN s ON x > x0 AND x < x0 + 2.5 AND y > y0 AND y < y0 + 4.0 GROUP BY 1""")
def zone_of_points(spark, sf):
    points = _zones(spark, sf).select(F.col("node_id").alias("point_id"), (F.col("lon") + 0.01).alias("lon"), (F.col("lat") + 0.01).alias("lat"))
    return zoning.zone_of(points, _squares(spark, sf), 1.0)


@query(f"WITH {LINKS}, e AS (SELECT * FROM edges), f AS (SELECT allowed.*, n_nationkey FROM (SELECT link_id, least(a_node, b_node) AS low, greatest(a_node, b_node) AS high, direction FROM edges) allowed, (SELECT 0 AS n_nationkey) z) SELECT low, high, count(*) AS n_ways FROM f GROUP BY 1, 2")
def gmns_round_trip(spark, sf):
    """Ways between each pair of nodes, from links that went out as GMNS rows."""
    rows = network.to_gmns(model.links(spark, sf))
    low, high = F.least("from_node_id", "to_node_id").alias("low"), F.greatest("from_node_id", "to_node_id").alias("high")
    return rows.groupBy(low, high).agg(F.count("*").alias("n_ways"))
