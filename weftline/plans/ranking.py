"""Positions over a whole table without a window in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.shared import cut


def range_offsets(df: DataFrame, by: list[str], order: list[Column], weight: str | None = None) -> DataFrame:
    """``df`` with ``_before``: the summed ``weight`` (or number) of the rows of its ``by`` group that come before it.

    Rows are range partitioned by (by, order), written once so that the
    partitions stand, numbered inside each partition, and shifted by the totals
    of earlier partitions: a table of at most partitions x groups touched rows,
    as every partition holds a range. ``order`` must be total inside a group.
    """
    placed = cut(df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_part", F.spark_partition_id()), "ranges")
    w = F.col(weight) if weight else F.lit(1)
    totals = placed.groupBy(*by, "_part").agg(F.sum(w).alias("_total"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(earlier), F.lit(0))).drop("_total")
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("_inside", F.coalesce(F.sum(w).over(inside), F.lit(0)))
    return numbered.join(F.broadcast(offsets), [*by, "_part"]).withColumn("_before", (F.col("_inside") + F.col("_offset")).cast("long")).drop("_inside", "_offset", "_part")


def global_positions(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``df`` with its 1-based position by ``order``, which must be total."""
    return range_offsets(df.withColumn("_all", F.lit(0)), ["_all"], order).withColumn(name, F.col("_before") + 1).drop("_before", "_all")
