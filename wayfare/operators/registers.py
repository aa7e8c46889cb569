"""Registers of a network: modes, link types and periods, kept as tables, and what protects their rows.

An edit returns the new table and raises where a rule forbids it; rows that links use, and those that a network is made
with, stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows that every network has.
DEFAULT_LINK_TYPES = ("centroid_connector", "default")
DEFAULT_PERIOD = 1


def _has(df: DataFrame, condition) -> bool:
    return bool(df.filter(condition).limit(1).count())


def _row(df: DataFrame, values: dict) -> DataFrame:
    """One row in the columns of df; what is not given is null."""
    unknown = set(values) - set(df.columns)
    if unknown:
        raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")
    return df.sparkSession.createDataFrame([tuple(values.get(c) for c in df.columns)], df.schema)


def add_mode(modes: DataFrame, mode_id: str, mode_name: str, **fields) -> DataFrame:
    """modes with a new one: its id is one letter that is not taken, its name letters and underscores."""
    if len(mode_id) != 1 or not mode_id.isascii() or not mode_id.isalpha():
        raise ValueError("a mode's id is one letter")
    if not mode_name or not all(c.isalpha() or c == "_" for c in mode_name):
        raise ValueError("a mode's name holds letters and underscores only")
    if _has(modes, (F.col("mode_id") == mode_id) | (F.col("mode_name") == mode_name)):
        raise ValueError(f"mode {mode_id} or {mode_name} is there already")
    return modes.unionByName(_row(modes, {"mode_id": mode_id, "mode_name": mode_name, **fields}))


def drop_mode(modes: DataFrame, links: DataFrame, mode_id: str) -> DataFrame:
    if not _has(modes, F.col("mode_id") == mode_id):
        raise ValueError(f"there is no mode {mode_id}")
    if _has(links, F.instr("modes", mode_id) > 0):
        raise ValueError(f"links use mode {mode_id}")
    return modes.filter(F.col("mode_id") != mode_id)


def add_link_type(types: DataFrame, link_type_id: str, link_type: str, **fields) -> DataFrame:
    if len(link_type_id) != 1 or not link_type_id.isascii() or not link_type_id.isalpha():
        raise ValueError("a link type's id is one letter")
    if not link_type or not all(c.isalpha() or c == "_" for c in link_type):
        raise ValueError("a link type's name holds letters and underscores only")
    if _has(types, (F.col("link_type_id") == link_type_id) | (F.col("link_type") == link_type)):
        raise ValueError(f"link type {link_type_id} or {link_type} is there already")
    return types.unionByName(_row(types, {"link_type_id": link_type_id, "link_type": link_type, **fields}))


def drop_link_type(types: DataFrame, links: DataFrame, link_type: str) -> DataFrame:
    if link_type in DEFAULT_LINK_TYPES:
        raise ValueError(f"link type {link_type} is part of every network")
    if not _has(types, F.col("link_type") == link_type):
        raise ValueError(f"there is no link type {link_type}")
    if _has(links, F.col("link_type") == link_type):
        raise ValueError(f"links are of type {link_type}")
    return types.filter(F.col("link_type") != link_type)


def add_period(periods: DataFrame, period_id: int, start: int, end: int, description: str = "") -> DataFrame:
    """periods with a new one, from start to end in seconds of the day."""
    if not 0 <= start < end <= 86_400:
        raise ValueError("a period starts before it ends, within a day")
    if _has(periods, F.col("period_id") == period_id):
        raise ValueError(f"period {period_id} is there already")
    return periods.unionByName(_row(periods, {"period_id": period_id, "period_start": start, "period_end": end, "period_description": description}))


def renumber_period(periods: DataFrame, period_id: int, new_id: int) -> DataFrame:
    if DEFAULT_PERIOD in (period_id, new_id):
        raise ValueError("the default period does not change")
    if _has(periods, F.col("period_id") == new_id):
        raise ValueError(f"period {new_id} is there already")
    return periods.withColumn("period_id", F.when(F.col("period_id") == period_id, F.lit(new_id)).otherwise(F.col("period_id")))


def drop_period(periods: DataFrame, period_id: int) -> DataFrame:
    if period_id == DEFAULT_PERIOD:
        raise ValueError("the default period does not change")
    return periods.filter(F.col("period_id") != period_id)


def modes_in_use(modes: DataFrame, links: DataFrame) -> DataFrame:
    """mode_id, n_links of the modes that links use, which cannot go."""
    used = links.select(F.explode(F.filter(F.split("modes", ""), lambda c: c != "")).alias("mode_id"))
    return used.groupBy("mode_id").agg(F.count("*").alias("n_links")).join(modes.select("mode_id"), "mode_id", "left_semi")


def node_types(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node_id, node_type: centroid, or by the ways that meet there: dead_end, passing or junction; isolated without any."""
    ends = links.select(F.explode(F.array("a_node", "b_node")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("n"))
    kind = F.when(F.col("is_centroid"), "centroid").when(F.col("n").isNull(), "isolated").when(F.col("n") == 1, "dead_end").when(F.col("n") == 2, "passing").otherwise("junction")
    return nodes.join(ends, "node_id", "left").select("node_id", kind.alias("node_type"))
