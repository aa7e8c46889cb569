"""Graph preparation: directed expansion, indices, costs, culling, contraction and the way back to links.

A network is a DataFrame of links (link_id, a_node, b_node, direction in -1/0/1, attributes; ``_ab``/``_ba`` pairs where
they differ by way). A directed graph is keyed by (link_id, direction). All steps are relational; the two that iterate
(dead ends, chains) cut their lineage by reliable checkpoints and run until nothing changes.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.plans.ranking import numbered
from wayfare.plans.staging import cut

KEYS = ("link_id", "a_node", "b_node", "direction")


def paired_fields(links: DataFrame) -> list[str]:
    """Names that come as _ab and _ba; a name with one of them only is an error."""
    names = set(links.columns)
    ab, ba = ({c[:-3] for c in names if c.endswith(s)} for s in ("_ab", "_ba"))
    if ab != ba:
        raise ValueError(f"fields with one direction only: {', '.join(sorted(ab ^ ba))}")
    return sorted(ab)


def check_network(links: DataFrame) -> None:
    """Required fields are there and hold no nulls."""
    missing = [c for c in KEYS if c not in links.columns]
    if missing:
        raise ValueError(f"fields missing: {', '.join(missing)}")
    nulls = links.agg(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in KEYS]).first()
    bad = [c for c in KEYS if nulls[c]]
    if bad:
        raise ValueError(f"fields with nulls: {', '.join(bad)}")


def directed_edges(links: DataFrame) -> DataFrame:
    """One row per permitted way: forward rows take the _ab values, reverse rows swap the nodes and take the _ba ones.
    One pass over the links, without a shuffle."""
    pairs = paired_fields(links)
    plain = [c for c in links.columns if c not in KEYS and c[:-3] not in pairs]
    side = lambda way, a, b, sign: F.struct(F.col(a).alias("a_node"), F.col(b).alias("b_node"), F.lit(sign).alias("direction"), *[F.col(f"{p}_{way}").alias(p) for p in pairs])
    ways = F.filter(F.array(side("ab", "a_node", "b_node", 1), side("ba", "b_node", "a_node", -1)), lambda w: F.col("direction") != -w["direction"])
    rows = links.withColumn("__ways", ways).select("link_id", *plain, F.explode("__ways").alias("way"))
    return rows.select("link_id", "way.a_node", "way.b_node", "way.direction", *plain, *[f"way.{p}" for p in pairs])


def check_centroids(centroids: list[int]) -> None:
    if not centroids:
        raise ValueError("there are no centroids")
    if any(not isinstance(c, int) or isinstance(c, bool) or c <= 0 for c in centroids):
        raise ValueError("centroids are positive integers")
    if len(set(centroids)) < len(centroids):
        raise ValueError("centroids repeat")


def node_index(edges: DataFrame, centroids: DataFrame) -> DataFrame:
    """node_id, index: centroids first, then the other nodes, each in order of id."""
    every = edges.select(F.col("a_node").alias("node_id")).unionByName(edges.select(F.col("b_node").alias("node_id"))).distinct()
    marked = every.join(centroids.select("node_id", F.lit(1).alias("c")).distinct(), "node_id", "full")
    return numbered(marked, [F.coalesce("c", F.lit(0)).desc(), F.col("node_id")], "index").select("node_id", "index")


def forward_star(edges: DataFrame) -> DataFrame:
    """a_node, first, n_edges: where each node's edges begin in the order of (a_node, b_node)."""
    counts = edges.groupBy("a_node").agg(F.count("*").alias("n_edges"))
    before = Window.orderBy("a_node").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("a_node", F.coalesce(F.sum("n_edges").over(before), F.lit(0)).alias("first"), "n_edges")


def supernet_ids(edges: DataFrame) -> DataFrame:
    """edges with supernet_id, the rank of (link_id, direction): the same for all modes of a network."""
    return numbered(edges, ["link_id", "direction"], "supernet_id")


def exclude_links(links: DataFrame, excluded: DataFrame) -> DataFrame:
    return links.join(excluded.select("link_id").distinct(), "link_id", "left_anti")


def of_mode(links: DataFrame, mode: str) -> DataFrame:
    """Links open to a mode, a letter of their ``modes``."""
    return links.filter(F.instr("modes", mode) > 0)


def usable_from(edges: DataFrame, centroids: DataFrame, origin: int) -> DataFrame:
    """Edges that paths from origin may use when flow through centroids is blocked: none that leave another centroid."""
    others = centroids.filter(F.col("node_id") != origin).select(F.col("node_id").alias("a_node"))
    return edges.join(others, "a_node", "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """node_id, n_out, n_in, in one aggregation over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a_node").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("b_node").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.node_id").agg(F.sum("e.o").alias("n_out"), F.sum("e.i").alias("n_in"))


def without_dead_ends(edges: DataFrame, centroids: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Edges that a path between centroids may use. Round by round, over non-centroid nodes: edges out of nodes that
    nothing enters go; so do all edges of nodes joined with one single neighbour. Nodes nothing leaves are left. Rounds go on
    until nothing changes; if max_rounds are not enough, that is an error."""
    kept = edges
    held = centroids.select("node_id").distinct()
    before = kept.count()
    for k in itertools.count(1):
        sides = kept.select(F.col("a_node").alias("n"), F.col("b_node").alias("m"), F.lit(True).alias("out")).unionByName(kept.select(F.col("b_node").alias("n"), F.col("a_node").alias("m"), F.lit(False).alias("out")))
        about = sides.groupBy(F.col("n").alias("node_id")).agg(F.sum((~F.col("out")).cast("int")).alias("i"), F.sum(F.col("out").cast("int")).alias("o"), F.min("m").alias("least"), F.max("m").alias("most"))
        gone = about.filter("(i = 0 AND o > 0) OR (i > 0 AND o > 0 AND least = most)").join(held, "node_id", "left_anti").select("node_id", (F.col("i") > 0).alias("spur"))
        kept = kept.join(gone.select(F.col("node_id").alias("a_node")), "a_node", "left_anti").join(gone.filter("spur").select(F.col("node_id").alias("b_node")), "b_node", "left_anti")
        kept = cut(kept.select(*edges.columns))
        now = kept.count()
        if now == before:
            break
        if k == max_rounds:
            raise RuntimeError(f"there are dead ends still after {max_rounds} rounds")
        before = now
    return kept


def contracted(links: DataFrame, centroids: DataFrame, max_rounds: int = 60) -> DataFrame:
    """link_id, compressed_id, position, forward: each link's place in its chain.

    Chains run through non-centroid nodes of exactly two links. A chain's ends and order come from pointer doubling:
    each way along a link points at the way that continues it, pointers double every round, so a chain of n links needs
    log2 n rounds. compressed_id is 10 * max(link_id) + a dense rank of the chain's least link; ``forward`` says whether
    the link lies along the chain. Loops without any other node keep their least link as both ends.
    """
    ends = links.select("link_id", F.explode(F.array(F.struct(F.col("a_node").alias("node"), F.lit(True).alias("from_a")), F.struct(F.col("b_node").alias("node"), F.lit(False).alias("from_a")))).alias("e")).select("link_id", "e.*")
    passing = ends.groupBy("node").agg(F.count("*").alias("n"), F.countDistinct("link_id").alias("d")).filter("n = 2 AND d = 2").join(centroids.select(F.col("node_id").alias("node")), "node", "left_anti").select("node")
    # a way is (link, from_a): travelling the link away from that end; it is continued by the other link at its far end
    through = ends.join(passing, "node")
    other = through.select("node", F.col("link_id").alias("next_link"), F.col("from_a").alias("next_from_a"))
    ways = ends.select("link_id", "from_a")
    step = through.select("node", "link_id", (~F.col("from_a")).alias("from_a")).join(other, "node").filter("link_id <> next_link").select("link_id", "from_a", "next_link", "next_from_a")
    at = ways.join(step, ["link_id", "from_a"], "left").select("link_id", "from_a", F.coalesce("next_link", "link_id").alias("p_link"), F.coalesce("next_from_a", "from_a").alias("p_from_a"), F.when(F.col("next_link").isNull(), 0).otherwise(1).cast("long").alias("ahead"), F.least("link_id", F.coalesce("next_link", "link_id")).alias("least"))
    at = cut(at)
    before = None
    for _ in range(max_rounds):
        jump = at.select(F.col("link_id").alias("p_link"), F.col("from_a").alias("p_from_a"), F.col("p_link").alias("q_link"), F.col("p_from_a").alias("q_from_a"), F.col("ahead").alias("further"), F.col("least").alias("least_ahead"))
        at = cut(at.join(jump, ["p_link", "p_from_a"]).select("link_id", "from_a", F.col("q_link").alias("p_link"), F.col("q_from_a").alias("p_from_a"), F.least(F.col("ahead") + F.col("further"), F.lit(1 << 40)).alias("ahead"), F.least("least", "least_ahead").alias("least")))
        now = tuple(at.agg(F.sum(F.when(F.col("ahead") < 1 << 39, F.col("ahead"))), F.sum("least"), F.sum("p_link")).first())
        if now == before:
            break
        before = now
    both = at.groupBy("link_id").agg(F.min("least").alias("chain"), F.max(F.when(F.col("from_a"), F.struct("p_link", "ahead"))).alias("f"), F.max(F.when(~F.col("from_a"), F.struct("p_link", "ahead"))).alias("r"))
    # the chain runs so that its least end link comes first
    both = both.withColumn("forward", (F.col("r.p_link") < F.col("f.p_link")) | ((F.col("r.p_link") == F.col("f.p_link")) & F.lit(True)))
    both = both.withColumn("position", F.when(F.col("forward"), F.col("r.ahead")).otherwise(F.col("f.ahead")))
    top = links.agg(F.max("link_id").alias("top"))
    ranked = numbered(both.select("chain").distinct(), ["chain"], "k").crossJoin(F.broadcast(top))  # one row
    return both.join(ranked.select("chain", (F.col("top") * 10 + F.col("k")).alias("compressed_id")), "chain").select("link_id", "compressed_id", "position", "forward")


def compressed_values(edges: DataFrame, crosswalk: DataFrame, fields: list[str]) -> DataFrame:
    """Sums of fields over the edges of each (compressed_id, way along the chain)."""
    along = F.when(F.col("forward"), F.col("direction")).otherwise(-F.col("direction")).alias("way")
    return edges.join(crosswalk, "link_id").groupBy("compressed_id", along).agg(*[F.sum(f).alias(f) for f in fields], F.count("*").alias("n_links"))


def _along(column: str = "direction"):
    return F.when(F.col("forward"), F.col(column)).otherwise(-F.col(column))


def compressed_edges(edges: DataFrame, crosswalk: DataFrame, fields: list[str]) -> DataFrame:
    """The directed edges of the contracted network: link_id (the chain's compressed_id), a_node, b_node, direction (the way
    along the chain) and sums of fields. A way is there if every link of the chain permits it."""
    whole = crosswalk.groupBy("compressed_id").agg(F.count("*").alias("size"))
    held = edges.join(crosswalk, "link_id").withColumn("way", _along()).withColumn("at", F.col("position") * F.col("way"))
    ends = held.groupBy("compressed_id", "way").agg(F.min_by("a_node", "at").alias("a_node"), F.max_by("b_node", "at").alias("b_node"), F.count("*").alias("n"), *[F.sum(f).alias(f) for f in fields])
    ends = ends.join(whole, "compressed_id").filter(F.col("n") == F.col("size"))
    return ends.select(F.col("compressed_id").alias("link_id"), "a_node", "b_node", F.col("way").cast("int").alias("direction"), *fields)


def network_loads(loads: DataFrame, crosswalk: DataFrame, cores: list[str]) -> DataFrame:
    """Loads (link_id, direction) of a contracted network on the links of its chains."""
    held = loads.select(F.col("link_id").alias("compressed_id"), F.col("direction").alias("way"), *cores).join(crosswalk, "compressed_id")
    return held.select("link_id", _along("way").cast("int").alias("direction"), *cores)


def expanded_routes(routes: DataFrame, crosswalk: DataFrame, keys: list[str]) -> DataFrame:
    """keys and links: routes as arrays of signed compressed ids, as arrays of signed network links."""
    steps = routes.select(*keys, F.posexplode("links").alias("step", "way")).withColumn("compressed_id", F.abs("way"))
    held = steps.join(crosswalk, "compressed_id").withColumn("sign", F.signum(F.col("way").cast("double")).cast("long"))
    placed = F.struct("step", (F.col("position") * F.col("sign")).alias("at"), (F.col("link_id") * F.col("sign") * F.when(F.col("forward"), 1).otherwise(-1)).alias("link"))
    return held.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(placed)), lambda x: x["link"]).alias("links"))


def skimmable_fields(links: DataFrame) -> list[str]:
    """Numeric fields that can be summed along paths; pairs by their common name."""
    pairs = paired_fields(links)
    numeric = [n for n, t in links.dtypes if t in ("int", "bigint", "smallint", "float", "double") and n not in KEYS]
    return sorted({n[:-3] if n[:-3] in pairs else n for n in numeric})


def with_time_field(edges: DataFrame, field: str) -> DataFrame:
    """edges with the field as ``time``; values that are missing or not positive are an error."""
    if edges.filter(F.col(field).isNull() | F.isnan(F.col(field).cast("double")) | (F.col(field) <= 0)).limit(1).count():
        raise ValueError(f"{field} holds values that are missing or not positive")
    return edges.withColumn("time", F.col(field).cast("double"))


def mode_graphs(links: DataFrame, modes: list[str]) -> dict[str, DataFrame]:
    """The directed edges of each mode."""
    return {m: directed_edges(of_mode(links, m)) for m in modes}


def shared_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    """node_id of the nodes of both tables."""
    return a.select("node_id").intersect(b.select("node_id"))


def other_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    """node_id of the nodes of the first table only."""
    return a.select("node_id").subtract(b.select("node_id"))


def compressed_links(crosswalk: DataFrame) -> DataFrame:
    """compressed_id and its links in order."""
    return crosswalk.groupBy("compressed_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "link_id"))), lambda x: x["link_id"]).alias("links"))


def network_columns(values: DataFrame, fields: list[str]) -> DataFrame:
    """Values by (link_id, direction) as one row a link with _ab, _ba and _tot columns; the total reads a missing way as 0."""
    way = lambda f, sign: F.sum(F.when(F.col("direction") == sign, F.col(f)))
    wide = values.groupBy("link_id").agg(*[x for f in fields for x in (way(f, 1).alias(f"{f}_ab"), way(f, -1).alias(f"{f}_ba"))])
    return wide.select("link_id", *[x for f in fields for x in (f"{f}_ab", f"{f}_ba", (F.coalesce(f"{f}_ab", F.lit(0.0)) + F.coalesce(f"{f}_ba", F.lit(0.0))).alias(f"{f}_tot"))])
