"""Ranks over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


def in_parts(rows: DataFrame, order: list) -> DataFrame:
    """Rows with _part and _row: the part of a range partitioning by the whole order, and the number within it from 0."""
    # what a range sort numbers: the partition in the upper bits, the row within it in the lower 33
    numbered = rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    numbered = numbered.select("*", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_row")).drop("_id")
    return Scratch(rows.sparkSession).save(numbered, "ranked")


def global_rank(rows: DataFrame, order: list, out: str) -> DataFrame:
    """Row numbers over a total order, without one task for all rows, however many scores tie.

    Rows are range-partitioned by the whole order and written in it; a row's rank is its number within its part
    plus the sizes of the parts before, a table of one row a partition. Writing fixes the parts: a lost
    executor's rows are not dealt anew between the two uses. Rows that tie in all of `order` are interchangeable.
    """
    numbered = in_parts(rows, order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return numbered.join(F.broadcast(sizes), "_part").withColumn(out, F.col("_row") + F.col("_base") + 1).drop("_part", "_row", "_base")  # a row a partition
