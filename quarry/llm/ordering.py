"""Positions of rows within ordered groups, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import written


def numbered(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """rows with `at` (long, from 0: the place in the group) and `of` (long: the group's rows), written.

    Rows are dealt by ranges of (group, order, row), so a large group lies in many tasks in order; each range's first
    row and count in a group, at most ranges + groups rows, give the places. Rows that are equal in group and order
    come in the order of the input's partitions. Columns at, of and __row of the input are replaced.
    """
    rows = rows.drop("at", "of", "__row").withColumn("__row", F.monotonically_increasing_id())
    keys = [F.col(group), *order, F.col("__row")]
    # The row's number after sorting is (range << 33) + its place in the range.
    placed = written(
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__row", F.monotonically_increasing_id()), name
    )
    part = F.shiftright("__row", 33)
    edges = placed.groupBy(group, part.alias("__part")).agg(F.min("__row").alias("__first"), F.count("*").alias("__rows"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(
        group, "__part", "__first",
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"), F.sum("__rows").over(whole).alias("of"),
    )
    return (
        placed.withColumn("__part", part).join(edges, [group, "__part"])
        .withColumn("at", F.col("__before") + F.col("__row") - F.col("__first"))
        .drop("__part", "__row", "__first", "__before")
    )
