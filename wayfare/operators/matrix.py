"""OD matrices in long form: (origin, destination, one column a core). A missing row or null is no value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.plans.ranking import numbered

KEYS = ["origin", "destination"]
CORE_NAME_MOST, INDEX_NAME_MOST = 50, 20


def cores(matrix: DataFrame) -> list[str]:
    return [c for c in matrix.columns if c not in KEYS]


def create_empty(zones: DataFrame, names: list[str]) -> DataFrame:
    """Every pair of zones with null cores; zones are a table of one id each, and the result is their square by definition."""
    too_long = [n for n in names if len(n) > CORE_NAME_MOST]
    if too_long:
        raise ValueError(f"core names of more than {CORE_NAME_MOST} characters: {', '.join(too_long)}")
    ids = zones.select("zone_id").distinct()
    square = ids.select(F.col("zone_id").alias("origin")).crossJoin(ids.select(F.col("zone_id").alias("destination")))
    return square.select("*", *[F.lit(None).cast("double").alias(n) for n in names])


def from_trip_list(trips: DataFrame, origin: str, destination: str, values: list[str]) -> DataFrame:
    """Sums of a trip list by pair; trips without one end are left out."""
    named = trips.filter(F.col(origin).isNotNull() & F.col(destination).isNotNull())
    return named.groupBy(F.col(origin).alias("origin"), F.col(destination).alias("destination")).agg(*[F.sum(v).alias(v) for v in values])


def zone_index(matrix: DataFrame) -> DataFrame:
    """zone_id, index: the sorted zones that occur at either end."""
    return numbered(matrix.select(F.explode(F.array(*KEYS)).alias("zone_id")).distinct(), ["zone_id"], "index")


def view(matrix: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in matrix.columns]
    if missing:
        raise ValueError(f"no such cores: {', '.join(missing)}")
    return matrix.select(*KEYS, *names)


def set_index(matrix: DataFrame, mapping: DataFrame) -> DataFrame:
    """Renumber both ends by (zone_id, new_id); pairs with an end outside the mapping are left out."""
    m = mapping.select("zone_id", "new_id")
    a, b = m.toDF("origin", "new_origin"), m.toDF("destination", "new_destination")
    return matrix.join(a, "origin").join(b, "destination").select(F.col("new_origin").alias("origin"), F.col("new_destination").alias("destination"), *cores(matrix))


def row_totals(matrix: DataFrame, core: str) -> DataFrame:
    return matrix.groupBy("origin").agg(F.sum(F.nanvl(F.col(core), F.lit(None))).alias("total"))


def column_totals(matrix: DataFrame, core: str) -> DataFrame:
    return matrix.groupBy("destination").agg(F.sum(F.nanvl(F.col(core), F.lit(None))).alias("total"))


def nan_to_num(matrix: DataFrame, value: float = 0.0) -> DataFrame:
    return matrix.select(*KEYS, *[F.coalesce(F.nanvl(F.col(c), F.lit(None)), F.lit(value)).alias(c) for c in cores(matrix)])


def combine(matrices: list[DataFrame], fill: float | None = 0.0) -> DataFrame:
    """Cores of several matrices side by side, by full outer joins on the pair; names must differ."""
    names = [c for m in matrices for c in cores(m)]
    if len(set(names)) < len(names):
        raise ValueError("a core name occurs twice")
    joined = reduce(lambda a, b: a.join(b, KEYS, "full"), matrices)
    return joined if fill is None else joined.fillna(fill, names)


def add_matrix(matrix: DataFrame) -> DataFrame:
    """Demand in coordinates: cores that sum to zero are dropped, and so are pairs without any value."""
    totals = matrix.agg(*[F.sum(c).alias(c) for c in cores(matrix)]).first()
    kept = [c for c in cores(matrix) if totals[c]]
    return matrix.select(*KEYS, *kept).na.drop("all", subset=kept) if kept else matrix.select(*KEYS).limit(0)


def intrazonal(matrix: DataFrame) -> DataFrame:
    return matrix.filter("origin = destination")
