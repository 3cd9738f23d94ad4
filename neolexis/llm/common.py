"""What the training-data operators share: scratch tables (from the library), word splitting, prefix sums over sorted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch, remove, scratch_path, shared_dir

__all__ = ["SPACE", "Scratch", "remove", "running_before", "scratch_path", "shared_dir", "word_count"]

#: The white space that separates words, as a Java/RE2/Python character class body.
SPACE = r"\x20\x09-\x0D"


def word_count(text: Column) -> Column:
    """Number of maximal runs of other characters than SPACE; null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+", -1)
    ends = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return F.greatest(F.size(parts) - ends, F.lit(0)).cast("long")


def running_before(df: DataFrame, key: str, order: list[str], amount: str, out: str, buckets: int = 4096) -> DataFrame:
    """Add `out`: the sum of `amount` over the rows of the same key that come earlier in order.

    order[0] is a 64-bit hash column. Its high bits cut every key into `buckets` slices, so a key that holds
    a third of all rows is dealt over as many tasks as any other rows; the slices' sums are one row each.
    Nulls in key form a key of their own. Rows that tie in all of `order` are interchangeable.
    """
    shift = 64 - (buckets - 1).bit_length()
    sliced = df.withColumn("_slice", F.shiftrightunsigned(F.col(order[0]).bitwiseXOR(F.lit(-(2**63))), shift))
    within = Window.partitionBy(key, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = sliced.groupBy(key, "_slice").agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(key).alias("_key"), F.col("_slice").alias("_slice2"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    rows = sliced.withColumn("_inner", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    joined = rows.join(sums, rows[key].eqNullSafe(sums["_key"]) & (rows["_slice"] == sums["_slice2"]), "left")
    return joined.withColumn(out, F.col("_base") + F.col("_inner")).drop("_slice", "_slice2", "_key", "_base", "_inner")
