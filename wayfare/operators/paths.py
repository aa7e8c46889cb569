"""Shortest paths, skims, all-or-nothing loads and select-link analysis.

The network is broadcast once per call as arrays, after a check that it has at most ``MAX_EDGES`` edges; origins are
dealt over the cluster and each task keeps one load vector, so what is shuffled is a row per edge and task, whatever
the number of origins. Beyond that bound ``bellman_ford`` does the same search as joins, nothing broadcast.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.operators.kernels import HEURISTICS, ORIGINS_AT_ONCE, Network, a_star, least_cost_per_metre
from wayfare.plans.staging import cut

MAX_EDGES = 20_000_000
#: Origins times edges of a task, at least where there are tasks enough for all cores, and at most.
TASK_WORK = 1 << 21, 1 << 28


def collect_network(edges: DataFrame, centroids: list[int], cost: str, fields: tuple[str, ...] = (), blocked: bool = True) -> Network:
    """The network as arrays, refused beyond MAX_EDGES; edges of null cost are not usable."""
    names = list(dict.fromkeys((cost, *fields)))
    n = edges.limit(MAX_EDGES + 1).count()
    if n > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} edges: use bellman_ford")
    t = edges.select("a_node", "b_node", "link_id", "direction", *[F.coalesce(F.col(c).cast("double"), F.lit(float("inf"))).alias(c) for c in names]).toArrow()
    get = lambda c: t.column(c).to_numpy()
    return Network(get("a_node"), get("b_node"), get("link_id"), get("direction"), get(cost), {f: get(f) for f in fields}, centroids, blocked)


def _by_origin(demand: DataFrame, cores: list[str], partitions: int | None) -> DataFrame:
    """Demand packed to a row an origin: small, and split evenly."""
    cells = F.collect_list(F.struct("destination", *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in cores]))
    packed = demand.groupBy("origin").agg(cells.alias("cells"))
    return packed.repartition(partitions, "origin") if partitions else packed


def _dealt(spark, net: Network, origins: DataFrame) -> DataFrame:
    """Distinct origins over as many tasks as searches from all centroids are worth: their few bytes tell nothing of it."""
    work = int(net.is_centroid.sum()) * len(net.head)
    tasks = max(min(work // TASK_WORK[0], 4 * spark.sparkContext.defaultParallelism), work // TASK_WORK[1])
    origins = origins.select(F.col("origin").cast("long"))
    return (origins.repartition(tasks, "origin") if tasks > 1 else origins).distinct()


def _costs(net: Network, origins: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(origin, cost to each node) of the origins that are in the network."""
    known = [(z, o) for z in origins if (o := net.index(z)) >= 0]
    for at in range(0, len(known), ORIGINS_AT_ONCE):
        some = known[at : at + ORIGINS_AT_ONCE]
        yield from zip((z for z, _ in some), net.costs([o for _, o in some]), strict=True)


def skims(spark, net: Network, origins: DataFrame, field_names: tuple[str, ...] = ()) -> DataFrame:
    """origin, destination, cost and fields for all centroid pairs: 0 on the diagonal, infinite where unreachable."""
    shared = spark.sparkContext.broadcast(net)
    names = list(field_names)

    def trees(net: Network, origins: list[int]):
        for origin in origins:
            if (o := net.index(origin)) >= 0:
                far, into, order = net.tree(o)
                yield origin, np.asarray(far), net.skims(into, order)

    def run(batches: Iterator[pa.RecordBatch]):
        net = shared.value
        zones = np.flatnonzero(net.is_centroid)
        for batch in batches:
            ids = batch.column("origin").to_pylist()
            for origin, far, extra in trees(net, ids) if names else ((z, far, {}) for z, far in _costs(net, ids)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(zones), origin), pa.int64()), pa.array(net.nodes[zones], pa.int64()), pa.array(far[zones], pa.float64()), *[pa.array(extra[f][zones], pa.float64()) for f in names]], names=["origin", "destination", "cost", *names])

    return _dealt(spark, net, origins).mapInArrow(run, ", ".join(["origin long", "destination long", "cost double", *[f"`{f}` double" for f in names]]))


def skim_totals(spark, net: Network, origins: DataFrame) -> DataFrame:
    """origin, n_reached, total, farthest: number, sum and greatest of the costs to the centroids that an origin reaches,
    itself included where it is one. The pairs stay in the tasks that search, so a row an origin is all that leaves them."""
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]):
        net = shared.value
        for batch in batches:
            rows = [(z, far[net.is_centroid & np.isfinite(far)]) for z, far in _costs(net, batch.column("origin").to_pylist())]
            rows = [(z, len(x), float(x.sum()), float(x.max())) for z, x in rows if len(x)]
            if rows:
                types = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["origin", "n_reached", "total", "farthest"])

    return _dealt(spark, net, origins).mapInArrow(run, "origin long, n_reached long, total double, farthest double")


def shortest_paths(spark, net: Network, pairs: DataFrame) -> DataFrame:
    """origin, destination, cost, links, directions, nodes, mileposts of each pair that is connected; one tree an origin."""
    shared = spark.sparkContext.broadcast(net)
    schema = "origin long, destination long, cost double, links array<long>, directions array<int>, nodes array<long>, mileposts array<double>"
    packed = pairs.select(F.col("origin").cast("long"), F.col("destination").cast("long")).groupBy("origin").agg(F.collect_set("destination").alias("ends"))

    def run(batches):
        net = shared.value
        for batch in batches:
            rows = []
            for origin, ends in zip(batch.column("origin").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                o = net.index(origin)
                if o < 0:
                    continue
                far, into, _ = net.tree(o)
                for end in ends:
                    d = net.index(end)
                    if d < 0 or d == o or not np.isfinite(far[d]):
                        continue
                    es = net.path(into, d)
                    rows.append((origin, end, far[d], net.link[es].tolist(), net.direction[es].tolist(), [origin, *net.nodes[net.head[es]].tolist()], [0.0, *np.cumsum(net.cost[es]).tolist()]))
            if rows:
                types = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["origin", "destination", "cost", "links", "directions", "nodes", "mileposts"])

    return packed.mapInArrow(run, schema)


def places_of(net: Network, nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Longitudes and latitudes of the network's nodes; nodes are no more than twice the edges of a network that fits."""
    lon, lat = np.zeros(len(net.nodes)), np.zeros(len(net.nodes))
    ids = nodes.select("node_id", "lon", "lat").toArrow()
    at = np.searchsorted(net.nodes, ids.column("node_id").to_numpy())
    own = (at < len(net.nodes)) & (net.nodes[np.minimum(at, len(net.nodes) - 1)] == ids.column("node_id").to_numpy())
    lon[at[own]], lat[at[own]] = ids.column("lon").to_numpy()[own], ids.column("lat").to_numpy()[own]
    return lon, lat


def a_star_paths(spark, net: Network, nodes: DataFrame, pairs: DataFrame, heuristic: str = "haversine") -> DataFrame:
    """origin, destination, cost, links (signed) of connected pairs, each by A* with distances over the earth."""
    lon, lat = places_of(net, nodes)
    shared = spark.sparkContext.broadcast((net, lon, lat, least_cost_per_metre(net, lon, lat)))

    def run(batches):
        net, lon, lat, scale = shared.value
        for batch in batches:
            rows = []
            for origin, end in zip(batch.column("origin").to_pylist(), batch.column("destination").to_pylist(), strict=True):
                o, d = net.index(origin), net.index(end)
                cost, es = a_star(net, o, d, lon, lat, scale, heuristic) if o >= 0 and d >= 0 and o != d else (np.inf, [])
                if es:
                    rows.append((origin, end, cost, (net.link[es] * net.direction[es]).tolist()))
            if rows:
                types = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["origin", "destination", "cost", "links"])

    return pairs.select(F.col("origin").cast("long"), F.col("destination").cast("long")).distinct().mapInArrow(run, "origin long, destination long, cost double, links array<long>")


class PathResult:
    """The path of one origin over a network that the driver holds: compute once, then trace other destinations from the
    same tree; after an early exit or A*, whose trees are not whole, a new destination is searched for again."""

    def __init__(self, net: Network, lon: np.ndarray | None = None, lat: np.ndarray | None = None):
        self.net, self.lon, self.lat, self.heuristic = net, lon, lat, HEURISTICS[0]
        self.reset()

    def reset(self) -> None:
        self.origin = self.destination = None
        self.links, self.directions, self.nodes, self.mileposts, self.cost = [], [], [], [], float("inf")
        self._tree, self._whole = None, False

    def heuristics(self) -> list[str]:
        return list(HEURISTICS)

    def set_heuristic(self, heuristic: str) -> None:
        if heuristic not in HEURISTICS:
            raise ValueError(f"unknown heuristic {heuristic}; there are {', '.join(HEURISTICS)}")
        self.heuristic = heuristic

    def compute(self, origin: int, destination: int, early_exit: bool = False, a_star_search: bool = False) -> None:
        o, d = self.net.index(origin), self.net.index(destination)
        if o < 0 or d < 0:
            raise ValueError(f"node {origin if o < 0 else destination} is not in the network")
        self.reset()
        self.origin, self._early, self._by_a_star = origin, early_exit, a_star_search
        if a_star_search:
            if self.lon is None:
                raise ValueError("A* needs the places of nodes")
            cost, es = a_star(self.net, o, d, self.lon, self.lat, least_cost_per_metre(self.net, self.lon, self.lat), self.heuristic)
            self._take(destination, cost, es)
            return
        far, into, _ = self.net.tree(o, target=d if early_exit else -1)
        self._tree, self._whole = (far, into), not early_exit
        self._take(destination, far[d], self.net.path(into, d) if d != o else [])

    def update_trace(self, destination: int) -> None:
        d = self.net.index(destination)
        if self.origin is None or d < 0:
            raise ValueError("compute a path first" if self.origin is None else f"node {destination} is not in the network")
        if not self._whole:
            self.compute(self.origin, destination, self._early, self._by_a_star)
            return
        far, into = self._tree
        self._take(destination, far[d], self.net.path(into, d))

    def _take(self, destination: int, cost: float, es: list[int]) -> None:
        self.destination, self.cost = destination, float(cost)
        self.links, self.directions = self.net.link[es].tolist(), self.net.direction[es].tolist()
        self.nodes = [self.origin, *self.net.nodes[self.net.head[es]].tolist()] if es else []
        self.mileposts = [0.0, *np.cumsum(self.net.cost[es]).tolist()] if es else []


def path_trees(spark, net: Network, origins: DataFrame) -> DataFrame:
    """origin, node, cost, link (signed) into the node and the node before: the whole tree of each origin, to be stored."""
    shared = spark.sparkContext.broadcast(net)

    def run(batches):
        net = shared.value
        for batch in batches:
            for origin in batch.column("origin").to_pylist():
                o = net.index(origin)
                if o < 0:
                    continue
                far, into, order = net.tree(o)
                at = np.array([n for n in order if n != o], np.int64)
                es = np.array([into[n] for n in at], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), origin), pa.int64()), pa.array(net.nodes[at], pa.int64()), pa.array(np.asarray(far)[at], pa.float64()), pa.array(net.link[es] * net.direction[es], pa.int64()), pa.array(net.nodes[net.tail[es]], pa.int64())], names=["origin", "node", "cost", "link", "before"])

    return origins.select(F.col("origin").cast("long")).distinct().mapInArrow(run, "origin long, node long, cost double, link long, before long")


def traced(trees: DataFrame, destinations: DataFrame) -> DataFrame:
    """origin, destination, links of stored trees: all wanted traces go back one node a round, until all have arrived."""
    wanted = trees.join(destinations.select(F.col("destination").alias("node")).distinct(), "node")
    step = trees.select("origin", F.col("node").alias("at"), F.col("link").alias("own"), F.col("before").alias("next"))
    live = cut(wanted.select("origin", F.col("node").alias("destination"), F.array("link").alias("links"), F.col("before").alias("at")))
    done = []
    while True:
        done.append(live.filter(F.col("at") == F.col("origin")).select("origin", "destination", "links"))
        rest = live.filter(F.col("at") != F.col("origin"))
        if not rest.limit(1).count():
            break
        live = cut(rest.join(step, ["origin", "at"]).select("origin", "destination", F.concat(F.array("own"), "links").alias("links"), F.col("next").alias("at")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def unreachable(spark, net: Network, zones: DataFrame) -> DataFrame:
    """origin, destination of centroid pairs without a path, sorted."""
    out = skims(spark, net, zones.select(F.col("node_id").alias("origin")))
    return out.filter((F.col("cost") == float("inf")) & (F.col("origin") != F.col("destination"))).select("origin", "destination").orderBy("origin", "destination")


def packed_demand(demand: DataFrame, cores: list[str], partitions: int | None = None) -> DataFrame:
    """Demand as one row an origin, stored: for loads that are asked for again and again."""
    return cut(_by_origin(demand, cores, partitions))


def all_or_nothing(spark, net: Network, demand: DataFrame, cores: list[str], partitions: int | None = None) -> DataFrame:
    """link_id, direction and a load per core for edges that carry any: each task adds its origins' loads up first."""
    return loads_at(spark.sparkContext.broadcast(net), None, _by_origin(demand, cores, partitions), cores)


def loads_at(shared, cost, packed: DataFrame, cores: list[str]) -> DataFrame:
    """all_or_nothing of packed demand over a network that is broadcast already, at other costs if a broadcast of them
    is given: an iteration then sends its costs only."""

    def run(batches):
        net = shared.value
        if cost is not None:
            net.cost, net._lists, net._ranks = cost.value, None, None
        total = np.zeros((len(net.head), len(cores)))
        for batch in batches:
            for origin, cells in zip(batch.column("origin").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                total += one_origin(net, origin, cells, cores)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(net.link[used], pa.int64()), pa.array(net.direction[used], pa.int32()), *[pa.array(total[used, k], pa.float64()) for k in range(len(cores))]], names=["link_id", "direction", *cores])

    parts = packed.mapInArrow(run, ", ".join(["link_id long", "direction int", *[f"`{c}` double" for c in cores]]))
    return parts.groupBy("link_id", "direction").agg(*[F.sum(c).alias(c) for c in cores])


def one_origin(net: Network, origin: int, cells: list[dict], cores: list[str]) -> np.ndarray:
    o = net.index(origin)
    at = np.zeros((len(net.nodes), len(cores)))
    for c in cells:
        d = net.index(c["destination"])
        if d >= 0 and d != o:
            at[d] += [c[k] for k in cores]
    if o < 0 or not at.any():
        return np.zeros((len(net.head), len(cores)))
    far, into, order = net.tree(o)
    at[~np.isfinite(far)] = 0
    return net.load(into, order, at)


def unassigned(demand: DataFrame, skimmed: DataFrame, core: str) -> DataFrame:
    """Demand that is not loaded: within zones, or without a path."""
    joined = demand.join(skimmed.select("origin", "destination", "cost"), ["origin", "destination"], "left")
    why = F.when(F.col("origin") == F.col("destination"), "intrazonal").when(F.col("cost").isNull() | (F.col("cost") == float("inf")), "no path")
    return joined.select("origin", "destination", core, why.alias("reason")).filter("reason IS NOT NULL")


def link_set_expression(links: list[tuple[int, int]], column: str = "ways"):
    """Whether an array of signed links holds any of (link, direction); direction 0 stands for both."""
    signed = [s * link for link, d in links for s in ((d,) if d else (1, -1))]
    return F.arrays_overlap(F.col(column), F.array(*[F.lit(x).cast("long") for x in signed]))


def select_link(paths: DataFrame, demand: DataFrame, sets: dict[str, list[tuple[int, int]]], core: str) -> tuple[DataFrame, DataFrame]:
    """For named sets of (link_id, direction): loads (set_name, link_id, direction, load) and demand (set_name, origin,
    destination, demand) of the paths that use any of the set's links."""
    for name, links in sets.items():
        if not links or any(d not in (-1, 0, 1) for _, d in links):
            raise ValueError(f"set {name} needs links with directions -1, 0 or 1")
    ways = paths.withColumn("ways", F.zip_with("links", "directions", lambda link, d: link * d)).join(demand.select("origin", "destination", F.col(core).alias("demand")), ["origin", "destination"])
    names = F.filter(F.array(*[F.when(link_set_expression(links), F.lit(name)) for name, links in sets.items()]), lambda x: x.isNotNull())
    hit = ways.withColumn("set_name", F.explode(names))
    loads = hit.select("set_name", "demand", F.explode("ways").alias("way")).groupBy("set_name", F.abs("way").alias("link_id"), F.signum(F.col("way").cast("double")).cast("int").alias("direction")).agg(F.sum("demand").alias("load"))
    return loads, hit.select("set_name", "origin", "destination", "demand")


def bellman_ford(edges: DataFrame, origins: DataFrame, cost: str, max_rounds: int | None = None) -> DataFrame:
    """origin, node, cost by rounds of joins on the node until nothing improves: for networks that fit no single machine.
    Only labels that improved go on to the next round. Costs are not negative; if max_rounds are not enough, that is an
    error."""
    if edges.filter(F.col(cost) < 0).limit(1).count():
        raise ValueError("costs are negative")
    labels = cut(origins.select(F.col("origin").cast("long"), F.col("origin").cast("long").alias("node"), F.lit(0.0).alias("cost"), F.lit(True).alias("new")))
    for k in itertools.count(1):
        reached = labels.filter("new").join(edges.select(F.col("a_node").alias("node"), "b_node", F.col(cost).alias("step")), "node").select("origin", F.col("b_node").alias("node"), (F.col("cost") + F.col("step")).alias("cost"), F.lit(True).alias("new"))
        best = labels.withColumn("new", F.lit(False)).unionByName(reached).groupBy("origin", "node").agg(F.min(F.struct("cost", "new")).alias("b"))
        labels = cut(best.select("origin", "node", "b.cost", "b.new"))
        if not labels.filter("new").limit(1).count():
            break
        if k == max_rounds:
            raise RuntimeError(f"labels still improve after {max_rounds} rounds")
    return labels.select("origin", "node", "cost")
