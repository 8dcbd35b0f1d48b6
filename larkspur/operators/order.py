"""Orders that other engines can check: rows with their place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.session import Scratch, saved


def numbered(rows: DataFrame, *order: Column, out: str = "place", scratch: Scratch | None = None) -> DataFrame:
    """rows with their place in an order, from 1.

    Rows are sorted by ranges, one range a task, and written, so that ranges stay as they are; a range's first place follows from
    the sizes of those before it, of which there are as many as shuffle partitions. With a scratch, what is written goes with it.
    """
    ranged = (scratch.save if scratch else saved)(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_part", before.alias("_before")))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(offsets, "_part").withColumn(out, (F.col("_before") + within).cast("long")).drop("_part", "_before")


def first_places(rows: DataFrame, n: int, *order: Column, out: str = "place") -> DataFrame:
    """The first n rows of an order with their places; only those n are numbered."""
    return rows.orderBy(*order).limit(n).withColumn(out, F.row_number().over(Window.orderBy(*order)).cast("long"))
