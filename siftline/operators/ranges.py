"""Ranges of a table, joined where they touch or overlap: gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(ranges: DataFrame, *keys: str, start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end): the joined ranges of every key, without holding a key's ranges in one row."""
    along = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(along.rowsBetween(Window.unboundedPreceding, -1))
    rows = ranges.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("_before", before)
    opens = F.when(F.col("_before").isNull() | (F.col(start) > F.col("_before")), 1).otherwise(0)
    islands = rows.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(along))
    return islands.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")
