"""Primary-key and foreign-key checks (what the database enforced on load)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pk_report(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """One row: rows, distinct keys, keys seen more than once, rows with a NULL key part."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    null_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return per_key.agg(
        F.lit(table).alias("table_name"),
        F.lit(",".join(keys)).alias("key_columns"),
        F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.col("c") > 1).alias("n_duplicated_keys"),
        F.coalesce(F.sum(F.when(null_key, F.col("c")).otherwise(0)), F.lit(0)).cast("bigint")
        .alias("n_null_key_rows"))


DENSE = 64      # a range of keys is dense if it has at most so many numbers for each key
WHOLE_NUMBERS = ("tinyint", "smallint", "int", "bigint")


def _bits(df: DataFrame, key: str) -> DataFrame:
    """(bucket, bits): the keys of each 32,768 numbers as a bitmap, combined map-side."""
    return df.groupBy(F.bitmap_bucket_number(key).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bits"))


def possible_orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame | None:
    """The rows of ``child`` whose key may lack a parent, all orphans among them; None where
    the keys are not whole numbers in a dense range.

    Children and parents are compared as bitmaps: what crosses the shuffle is 4 KB for 32,768
    keys, whatever the number of rows. A bucket in which the children add bits to the parents'
    has orphans, and its rows are kept, as are rows outside the parents' range. (A Bloom
    filter of the parents could not replace this: it proves that a key is an orphan, never that it is
    not, so the exact join would still need nearly every child.)"""
    from callwise.operators.joins import rows_at_most
    from callwise.session import new_output_path
    if dict(child.dtypes)[fk] not in WHOLE_NUMBERS or dict(parent.dtypes)[pk] not in WHOLE_NUMBERS:
        return None
    spark = child.sparkSession
    low, high, n = parent.agg(F.min(pk), F.max(pk), F.count(pk)).first()
    if not n or high - low + 1 > DENSE * max(n, 32768):
        return None
    key = F.col(fk).cast("bigint")
    present = child.where(F.col(fk).isNotNull())
    inside = present.where(key.between(low, high)).select(key.alias("k"))
    parents = _bits(parent.where(F.col(pk).isNotNull()).select(F.col(pk).cast("bigint").alias("k")), "k").withColumn("side", F.lit(1))
    both = _bits(inside, "k").withColumn("side", F.lit(0)).union(parents)
    known = F.when(F.col("side") == 1, F.col("bits"))
    per = both.groupBy("bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"), F.max(F.coalesce(F.bitmap_count(known), F.lit(0))).alias("n_known"))
    path = new_output_path(spark, "suspects")
    per.where("n > n_known").select("bucket").write.parquet(path)
    suspects = spark.read.schema("bucket bigint").parquet(path)
    outside = ~key.between(low, high)
    if suspects.isEmpty():
        return present.where(outside)
    if rows_at_most(suspects, 250_000):
        suspects = F.broadcast(suspects)
    kept = present.join(suspects, F.bitmap_bucket_number(key) == F.col("bucket"), "left_semi")
    return kept.where(~outside).unionByName(present.where(outside))


def fk_report(child: DataFrame, child_name: str, fk: str, parent: DataFrame, parent_name: str,
              pk: str) -> DataFrame:
    """One row per edge: child rows and distinct keys with no parent (NULL keys are not
    orphans, as with SQL REFERENCES). Only possible orphans reach the exact anti join, reduced
    to (key, count), so each key crosses the shuffle once however many rows carry it."""
    possible = possible_orphans(child, fk, parent, pk)
    keys = (child.filter(F.col(fk).isNotNull()) if possible is None else possible).groupBy(fk).agg(F.count(F.lit(1)).alias("c"))
    parents = parent.select(F.col(pk).alias(fk)).dropDuplicates()
    orphans = keys.join(parents, fk, "left_anti")
    return orphans.agg(
        F.lit(child_name).alias("child_table"), F.lit(fk).alias("fk_column"),
        F.lit(parent_name).alias("parent_table"),
        F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("orphan_rows"),
        F.count(F.lit(1)).alias("orphan_keys"))


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)
