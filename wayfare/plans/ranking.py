"""Numbering rows of a whole table by an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.plans.staging import cut

#: Rows that one task numbers by itself; more are sorted by ranges.
ONE_TASK_ROWS = 1_000_000


def numbered(df: DataFrame, order: list[str | Column], into: str, first: int = 0, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """df with a long number from ``first`` by the order. Beyond ``one_task_rows`` the table is range-sorted and stored,
    rows are counted per range, and each row's place in its range is moved by the ranges before: no task sees all rows."""
    if df.limit(one_task_rows + 1).count() <= one_task_rows:
        return df.withColumn(into, (F.row_number().over(Window.orderBy(*order)) - 1 + first).cast("long"))
    held = cut(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = held.groupBy(part.alias("__part")).agg(F.count("*").alias("n")).orderBy("__part").collect()  # a row a range
    rows, before = [], first
    for c in counts:
        rows.append((c["__part"], before))
        before += c.n
    offsets = F.broadcast(df.sparkSession.createDataFrame(rows, "__part long, __before long"))
    return held.withColumn("__part", part).join(offsets, "__part").withColumn(into, (F.col("__before") + place).cast("long")).drop("__part", "__before", "__at")
