"""Key checks over arriving data.

Each micro-batch of visits is held against the keys of its parents and against the visit ids
that came before, and its report is kept per batch, so a bad delivery is seen when it
arrives and not in the next full check. A repeated batch writes its report again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callwise.operators.quality import fk_report, union_all

REPORT = "check string, column_name string, bad_rows bigint, bad_keys bigint"


def batch_report(batch: DataFrame, parents: list[tuple[str, DataFrame, str]], key: str, seen: DataFrame | None) -> DataFrame:
    """(check, column_name, bad_rows, bad_keys) of one batch: an ``orphan`` row for each of
    ``parents`` (column of the batch, parent table, its key), and a ``repeated key`` row,
    repeats inside the batch and of the keys in ``seen``."""
    out = [fk_report(batch, "batch", c, table, "parent", pk).select(
        F.lit("orphan").alias("check"), F.col("fk_column").alias("column_name"), F.col("orphan_rows").alias("bad_rows"),
        F.col("orphan_keys").alias("bad_keys")) for c, table, pk in parents]
    per = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    if seen is not None:
        # the batch is the smaller side: earlier keys are reduced to those that it has
        old = seen.join(per.select(key), key, "left_semi").select(key, F.lit(True).alias("old")).distinct()
        per = per.join(old, key, "left")
    else:
        per = per.withColumn("old", F.lit(None).cast("boolean"))
    bad = per.where((F.col("n") > 1) | F.col("old"))
    out.append(bad.agg(F.lit("repeated key").alias("check"), F.lit(key).alias("column_name"),
                       F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("bad_rows"), F.count(F.lit(1)).alias("bad_keys")))
    return union_all(out)


def start_checks(spark: SparkSession, source: str, schema, parents: list[tuple[str, DataFrame, str]], key: str, out: str,
                 checkpoint: str, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Checks the Parquet files that arrive at ``source``. Reports go to ``out/report``, the
    keys seen to ``out/keys``, both in one folder for each batch."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def check(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            kind = batch.schema[key].dataType.simpleString()
            seen = spark.read.schema(f"`{key}` {kind}, batch long").parquet(f"{out}/keys").where(F.col("batch") < epoch).select(key) if epoch else None
            batch_report(batch, parents, key, seen).write.mode("overwrite").parquet(f"{out}/report/batch={epoch}")
            batch.select(key).where(F.col(key).isNotNull()).distinct().write.mode("overwrite").parquet(f"{out}/keys/batch={epoch}")
        finally:
            batch.unpersist()

    return (reader.parquet(source).writeStream.foreachBatch(check).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def reports(spark: SparkSession, out: str) -> DataFrame:
    """Reports of all batches so far."""
    return spark.read.schema(f"{REPORT}, batch long").parquet(f"{out}/report")
