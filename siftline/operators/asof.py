"""Backward as-of joins without a range join: both sides in one order by ranges, the last row of the right carried along."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.session import cut, parallelism


def asof(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str], strict: bool = True) -> DataFrame:
    """left with the values of the last right row of the same key whose time lies before (not strictly: at) its own.

    Rows of both sides lie in ranges of key and time, so a key with a third of all rows takes many tasks. Within a range
    the last right row is carried along; what a range starts with comes from the key's earlier ranges, of which each
    hands on one row. Right rows of equal time count in the order of their values, the greatest last. Left rows without a
    right row, or with a null time, get nulls.
    """
    own = [c for c in left.columns]
    a = left.select(*by, F.col(at).alias("_at"), F.lit(1 if not strict else 0).alias("_side"), F.struct(*own).alias("_row"), F.lit(None).alias("_v"))
    b = right.where(F.col(at).isNotNull()).select(
        *by, F.col(at).alias("_at"), F.lit(0 if not strict else 1).alias("_side"), F.lit(None).alias("_row"), F.struct(*values).alias("_v")
    )
    both = a.unionByName(b).repartitionByRange(parallelism(left.sparkSession), *by, "_at", "_side").withColumn("_part", F.spark_partition_id())
    both = cut(both)
    along = Window.partitionBy("_part", *by).orderBy("_at", "_side", F.col("_v")).rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_last", F.last("_v", ignorenulls=True).over(along)).where(F.col("_row").isNotNull())
    ends = both.where(F.col("_v").isNotNull()).groupBy("_part", *by).agg(F.max(F.struct("_at", "_side", "_v"))["_v"].alias("_end"))
    ranges = both.select("_part", *by).distinct().join(ends, ["_part", *by], "left")
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("_part", *by, F.last("_end", ignorenulls=True).over(earlier).alias("_start")).where(F.col("_start").isNotNull())
    done = carried.join(starts, ["_part", *by], "left").withColumn("_last", F.coalesce("_last", "_start"))
    return done.select("_row.*", *[F.col(f"_last.{v}").alias(v) for v in values])
