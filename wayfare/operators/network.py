"""Network tables: edits, the rules that row triggers would enforce, and exchange formats.

Edits are rewrites of whole tables by joins; ``normalised`` brings tables in line once after any number of edits, and
does nothing when run again. ``violations`` states the rules as queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONNECTOR_CAPACITY = 99_999


def letters(values: Column) -> Column:
    """Distinct letters of collected strings, sorted, as one string."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.array_join(values, ""), ""), lambda c: c != ""))), "")


def _ends(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("a_node", "b_node")).alias("node_id"), "modes", "link_type")


def node_modes(links: DataFrame) -> DataFrame:
    """node_id, modes, n_link_types of the links that meet there."""
    return _ends(links).groupBy("node_id").agg(letters(F.collect_set("modes")).alias("modes"), F.countDistinct("link_type").alias("n_link_types"))


def orphans(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes without links that are not centroids."""
    return nodes.filter("NOT is_centroid").join(_ends(links).select("node_id").distinct(), "node_id", "left_anti")


def normalised(links: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, nodes) with missing end nodes added, orphans removed and node modes and link types kept."""
    used = _ends(links).groupBy("node_id").agg(letters(F.collect_set("modes")).alias("modes"), F.array_join(F.array_sort(F.collect_set("link_type")), ",").alias("link_types"))
    base = nodes.drop("modes", "link_types")
    every = base.join(used, "node_id", "full").withColumn("is_centroid", F.coalesce("is_centroid", F.lit(False)))
    return links, every.filter("is_centroid OR modes IS NOT NULL").fillna("", ["modes", "link_types"])


def violations(links: DataFrame, nodes: DataFrame, modes: DataFrame, link_types: DataFrame) -> DataFrame:
    """rule, id of what breaks a rule."""
    out = []
    add = lambda rule, df, key: out.append(df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("id")))
    add("direction is -1, 0 or 1", links.filter(~F.col("direction").isin(-1, 0, 1) | F.col("direction").isNull()), "link_id")
    add("a link has a mode", links.filter("modes IS NULL OR modes = ''"), "link_id")
    add("a link's ends differ", links.filter("a_node = b_node"), "link_id")
    add("ids are unique", links.groupBy("link_id").count().filter("count > 1"), "link_id")
    add("ids are unique", nodes.groupBy("node_id").count().filter("count > 1"), "node_id")
    used = links.select("link_id", F.explode(F.filter(F.split("modes", ""), lambda c: c != "")).alias("mode_id"))
    add("modes are known", used.join(modes.select("mode_id"), "mode_id", "left_anti").select("link_id").distinct(), "link_id")
    add("link types are known", links.join(link_types.select("link_type"), "link_type", "left_anti"), "link_id")
    ends = links.select("link_id", F.explode(F.array("a_node", "b_node")).alias("node_id"))
    add("ends are nodes", ends.join(nodes.select("node_id"), "node_id", "left_anti").select("link_id").distinct(), "link_id")
    add("mode ids are one letter", modes.filter(~F.col("mode_id").rlike("^[A-Za-z]$")), "mode_id")
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result


def duplicate_places(nodes: DataFrame) -> DataFrame:
    """lon, lat, node_ids of nodes on one place."""
    return nodes.groupBy("lon", "lat").agg(F.array_sort(F.collect_list("node_id")).alias("node_ids")).filter("size(node_ids) > 1")


def renumber(links: DataFrame, nodes: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables with nodes renumbered by (node_id, new_id), others as they are; a new id that is taken is an error."""
    m = mapping.select("node_id", "new_id")
    clash = m.join(nodes.join(m, "node_id", "left_anti").select(F.col("node_id").alias("new_id")), "new_id").limit(1).collect()
    if clash or m.groupBy("new_id").count().filter("count > 1").limit(1).count():
        raise ValueError("a new node id is taken")

    def swap(df: DataFrame, column: str) -> DataFrame:
        own = m.select(F.col("node_id").alias(column), F.col("new_id").alias("__new"))
        return df.join(own, column, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")

    return swap(swap(links, "a_node"), "b_node").select(*links.columns), swap(nodes, "node_id").select(*nodes.columns)


def merge_nodes(links: DataFrame, nodes: DataFrame, kept: int, gone: int) -> tuple[DataFrame, DataFrame]:
    """The links of one node moved to another, and the node dropped; a centroid is never merged away."""
    if nodes.filter((F.col("node_id") == gone) & F.col("is_centroid")).limit(1).count():
        raise ValueError(f"node {gone} is a centroid")
    move = lambda c: F.when(F.col(c) == gone, kept).otherwise(F.col(c)).alias(c)
    return links.select(*[move(c) if c in ("a_node", "b_node") else F.col(c) for c in links.columns]), nodes.filter(F.col("node_id") != gone)


def edit_modes(links: DataFrame, ids: list[int], add: str = "", drop: str = "", to: str | None = None) -> DataFrame:
    """Modes of some links set, added to or dropped from; at least one letter has to stay."""
    own = F.col("link_id").isin(ids)
    want = F.lit(to) if to is not None else F.translate(F.concat(F.col("modes"), F.lit(add)), drop, "") if drop else F.concat(F.col("modes"), F.lit(add))
    out = links.withColumn("modes", F.when(own, letters(F.array(want))).otherwise(F.col("modes")))
    if out.filter(own & (F.col("modes") == "")).limit(1).count():
        raise ValueError("a link keeps at least one mode")
    return out


def delete_links(links: DataFrame, nodes: DataFrame, ids: list[int]) -> tuple[DataFrame, DataFrame]:
    return normalised(links.filter(~F.col("link_id").isin(ids)), nodes)


def counts(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """n_links, n_nodes, n_centroids, and the extent of the nodes."""
    about = nodes.agg(F.count("*").alias("n_nodes"), F.sum(F.col("is_centroid").cast("int")).alias("n_centroids"), F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"))
    return links.agg(F.count("*").alias("n_links")).crossJoin(about)  # one row each


def connectors(zones: DataFrame, candidates: DataFrame, per_zone: int, first_id: int, mode: str = "c") -> DataFrame:
    """Centroid connectors to the nearest candidate nodes (node_id, zone_id, lon, lat) of each zone, spread out: the
    first is nearest, each next is the farthest from those before it among the nearer half."""
    w = Window.partitionBy("zone_id").orderBy("d", "node_id")
    d = F.sqrt(F.pow(F.col("lon") - F.col("zlon"), 2) + F.pow(F.col("lat") - F.col("zlat"), 2))
    near = candidates.join(zones.select("zone_id", F.col("lon").alias("zlon"), F.col("lat").alias("zlat")), "zone_id").withColumn("d", d)
    near = near.withColumn("r", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("zone_id")))
    step = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") / 2) / per_zone))
    chosen = near.filter(((F.col("r") - 1) % step == 0) & ((F.col("r") - 1) / step < per_zone))
    return chosen.select((F.row_number().over(Window.orderBy("zone_id", "r")) + first_id - 1).alias("link_id"), F.col("zone_id").alias("a_node"), F.col("node_id").alias("b_node"), F.lit(0).alias("direction"), F.lit("centroid_connector").alias("link_type"), F.lit(mode).alias("modes"), F.lit(float(CONNECTOR_CAPACITY)).alias("capacity_ab"), F.lit(float(CONNECTOR_CAPACITY)).alias("capacity_ba"))


def from_gmns(links: DataFrame) -> DataFrame:
    """GMNS links (link_id, from_node_id, to_node_id, directed, lanes, capacity, free_speed, length, allowed_uses) as
    network links: parallel directed links are summed, opposite ones become one two-way link of the least id."""
    directed = F.col("directed").cast("int") != 0
    flat = links.select("link_id", F.col("from_node_id").alias("f"), F.col("to_node_id").alias("t"), directed.alias("one_way"), "lanes", "capacity", "free_speed", "length", "allowed_uses")
    ways = flat.unionByName(flat.filter("NOT one_way").withColumn("x", F.col("f")).withColumn("f", F.col("t")).withColumn("t", F.col("x")).drop("x"))
    low, high = F.least("f", "t").alias("low"), F.greatest("f", "t").alias("high")
    summed = ways.groupBy("f", "t").agg(F.min("link_id").alias("link_id"), F.sum("lanes").alias("lanes"), F.sum("capacity").alias("capacity"), F.max("free_speed").alias("speed"), F.min("length").alias("length"), letters(F.collect_set(F.substring("allowed_uses", 1, 1))).alias("modes"))
    pairs = summed.select("*", low, high, (F.col("f") <= F.col("t")).alias("up"))
    side = lambda c, up: F.max(F.when(F.col("up") == up, F.col(c)))
    both = pairs.groupBy("low", "high").agg(F.min("link_id").alias("link_id"), F.max(F.when(F.col("up"), 1).otherwise(0)).alias("u"), F.max(F.when(~F.col("up"), 1).otherwise(0)).alias("v"), F.min("length").alias("distance"), letters(F.collect_list("modes")).alias("modes"), *[x for c in ("lanes", "capacity", "speed") for x in (side(c, True).alias(f"{c}_up"), side(c, False).alias(f"{c}_down"))])
    turned = (F.col("u") == 0) & (F.col("v") == 1)
    ab = lambda c: F.when(turned, F.col(f"{c}_down")).otherwise(F.col(f"{c}_up")).alias(f"{c}_ab")
    ba = lambda c: F.when(turned, F.lit(None)).otherwise(F.col(f"{c}_down")).alias(f"{c}_ba")
    return both.select("link_id", F.when(turned, F.col("high")).otherwise(F.col("low")).alias("a_node"), F.when(turned, F.col("low")).otherwise(F.col("high")).alias("b_node"), F.when((F.col("u") == 1) & (F.col("v") == 1), 0).otherwise(1).alias("direction"), "modes", "distance", *[f(c) for c in ("lanes", "capacity", "speed") for f in (ab, ba)])


def to_gmns(links: DataFrame) -> DataFrame:
    """One GMNS row a way; metres become kilometres; reverse ways get ids beyond all others."""
    from wayfare.operators.graph import directed_edges

    top = links.agg(F.max("link_id").alias("top"))
    rows = directed_edges(links).crossJoin(F.broadcast(top))  # one row
    return rows.select(F.when(F.col("direction") == 1, F.col("link_id")).otherwise(F.col("link_id") + F.col("top")).alias("link_id"), F.col("a_node").alias("from_node_id"), F.col("b_node").alias("to_node_id"), F.lit(True).alias("directed"), (F.col("distance") / 1000).alias("length"), F.col("link_type").alias("facility_type"), F.col("modes").alias("allowed_uses"))


def resolve_groups(groups: DataFrame, max_rounds: int = 50) -> DataFrame:
    """use_group, use: groups (use_group, uses separated by commas) with groups inside groups followed; a cycle is an error."""
    parts = groups.select("use_group", F.explode(F.split("uses", r"\s*,\s*")).alias("use"))
    names = groups.select(F.col("use_group").alias("inner_group"))
    for _ in range(max_rounds):
        nested = parts.join(names, F.col("use") == F.col("inner_group"), "left_semi")
        if not nested.limit(1).count():
            return parts.distinct()
        inner = groups.select(F.col("use_group").alias("use"), F.explode(F.split("uses", r"\s*,\s*")).alias("deeper"))
        parts = parts.join(names, F.col("use") == F.col("inner_group"), "left_anti").unionByName(nested.join(inner, "use").select("use_group", F.col("deeper").alias("use"))).distinct()
        if parts.filter("use = use_group").limit(1).count():
            raise ValueError("a use group contains itself")
    raise ValueError("use groups are nested too deeply")


def osm_links(ways: DataFrame) -> DataFrame:
    """way_id, part, a_node, b_node, nodes: ways (way_id, nodes array) split at every node that two ways, or one way twice, use."""
    used = ways.select("way_id", F.posexplode("nodes").alias("at", "node"))
    n = F.count("*").over(Window.partitionBy("node"))
    used = used.withColumn("shared", n > 1)
    size = ways.select("way_id", F.size("nodes").alias("size"))
    cuts = used.join(size, "way_id").filter((F.col("at") == 0) | (F.col("at") == F.col("size") - 1) | F.col("shared"))
    w = Window.partitionBy("way_id").orderBy("at")
    legs = cuts.withColumn("to", F.lead("at").over(w)).withColumn("part", F.row_number().over(w) - 1).filter("to IS NOT NULL")
    joined = legs.join(ways.select("way_id", "nodes"), "way_id")
    piece = F.slice("nodes", F.col("at") + 1, F.col("to") - F.col("at") + 1)
    return joined.select("way_id", F.col("part").cast("long").alias("part"), F.col("node").alias("a_node"), F.element_at(piece, -1).alias("b_node"), piece.alias("nodes"))


def osm_attributes(ways: DataFrame) -> DataFrame:
    """way_id, link_type, direction, lanes_ab, lanes_ba, speed_ab, speed_ba from tags (a JSON string): lanes are divided
    over two ways, given to one way only on one-way links, and speeds copied."""
    tag = lambda k: F.get_json_object("tags", f"$['{k}']")
    oneway = F.lower(F.coalesce(tag("oneway"), F.lit("no")))
    direction = F.when(oneway.isin("yes", "true", "1"), 1).when(oneway == "-1", -1).otherwise(0)
    kind = F.substring(F.regexp_replace(F.lower(F.coalesce(tag("highway"), F.lit("default"))), "[^a-z_]", "_"), 1, 50)
    lanes = F.regexp_extract(F.coalesce(tag("lanes"), F.lit("")), r"(\d+)", 1)
    lanes = F.when(lanes != "", lanes.cast("double"))
    speed = F.regexp_extract(F.coalesce(tag("maxspeed"), F.lit("")), r"(\d+)", 1)
    speed = F.when(speed != "", speed.cast("double"))
    rows = ways.select("way_id", kind.alias("link_type"), direction.alias("direction"), lanes.alias("l"), speed.alias("s"))
    share = F.when(F.col("direction") == 0, F.col("l") / 2).otherwise(F.col("l"))
    on = lambda c, sign: F.when(F.col("direction") != -sign, c)
    return rows.select("way_id", "link_type", "direction", on(share, 1).alias("lanes_ab"), on(share, -1).alias("lanes_ba"), on(F.col("s"), 1).alias("speed_ab"), on(F.col("s"), -1).alias("speed_ba"))
