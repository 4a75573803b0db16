"""Exact distinct counts from mergeable bitmaps.

Keys of any type get dense numbers once (``numbered``). A summary row then holds the
keys of its cell as a bitmap of 32,768 numbers (``key_bitmap``, one row per cell and
bucket), and the distinct keys of any union of cells are the bits of the OR of their bitmaps
(``distinct_keys``): a count over few rows instead of another pass over the facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "bucket"


def numbered(keys: DataFrame, order: list[str]) -> DataFrame:
    """``keys`` with a column ``number``, 1 .. n without gaps, rising along ``order``.

    The rows are range-partitioned and written with their place in the partition; the
    numbers before a partition are a running sum over one row per partition, so no task
    sees more than its share and nothing is collected."""
    from callwise.session import new_output_path
    spark = keys.sparkSession
    path = new_output_path(spark, "numbered")
    ranged = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    before = (placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .select("_part", "_before"))
    return (placed.join(F.broadcast(before), "_part")      # one row per partition
            .select(*keys.columns, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).alias("number")))


def bucket_of(number: str) -> Column:
    return F.bitmap_bucket_number(number)


def key_bitmap(number: str) -> Column:
    """Aggregate: bitmap of the numbers of a group that holds one bucket; nulls have no bit."""
    return F.bitmap_construct_agg(F.bitmap_bit_position(number))


def distinct_keys(summary: DataFrame, bitmap: str, group: list[str], count: str, sums: list[str]) -> DataFrame:
    """(group, distinct keys, sums) over rows of ``summary`` (group, bucket, bitmap, sums)."""
    merged = summary.groupBy(*group, BUCKET).agg(F.bitmap_or_agg(bitmap).alias(bitmap), *[F.sum(c).alias(c) for c in sums])
    return merged.groupBy(*group).agg(F.sum(F.bitmap_count(bitmap)).alias(count), *[F.sum(c).alias(c) for c in sums])
