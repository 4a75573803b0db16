"""Outputs published at once.

A table is a folder of versions and a list of pointers. A version is written to a folder of
its own; when that has succeeded, one pointer row is appended. Readers follow the newest
pointer, so they see the last whole version while the next one is written, after a
failed write, and while older versions are removed. Only Spark's writers and Hadoop's file
system are used, so any shared storage will do.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTERS = "_pointers"
POINTER = "published double, sequence long, version string"


class NotPublished(LookupError):
    """No version of the table has been published yet."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def history(spark: SparkSession, root: str) -> list[tuple[int, float, str]]:
    """(sequence, time, version) of all that was published, newest first: a row per version."""
    fs, p = _fs(spark, f"{root}/{POINTERS}")
    if not fs.exists(p):
        return []
    rows = spark.read.schema(POINTER).parquet(f"{root}/{POINTERS}").collect()
    return sorted(((r.sequence, r.published, r.version) for r in rows), reverse=True)


def new_version(spark: SparkSession, root: str) -> str:
    """Name of a version to be written to ``root/<name>`` and then announced."""
    return f"v-{uuid.uuid4().hex}"


def announce(spark: SparkSession, root: str, version: str) -> str:
    """Makes a wholly written version the current one; returns its folder."""
    past = history(spark, root)
    row = (time.time(), past[0][0] + 1 if past else 1, version)
    spark.createDataFrame([row], POINTER).coalesce(1).write.mode("append").parquet(f"{root}/{POINTERS}")
    return f"{root}/{version}"


def publish(df: DataFrame, root: str, version: str | None = None) -> str:
    """Writes ``df`` as a new version of the table at ``root`` and makes it current. A
    ``version`` named by the caller is written over, so a repeated batch publishes once."""
    spark = df.sparkSession
    version = version or new_version(spark, root)
    df.write.mode("overwrite").parquet(f"{root}/{version}")
    return announce(spark, root, version)


def current_path(spark: SparkSession, root: str) -> str:
    past = history(spark, root)
    if not past:
        raise NotPublished(root)
    return f"{root}/{past[0][2]}"


def current(spark: SparkSession, root: str) -> DataFrame:
    """The table as last published."""
    return spark.read.parquet(current_path(spark, root))


def expire(spark: SparkSession, root: str, older_than: float, now: float | None = None) -> list[str]:
    """Removes versions that are not current and were replaced over ``older_than`` seconds
    ago, and leftovers of failed writes of that age; returns their names."""
    now = time.time() if now is None else now
    past = history(spark, root)
    # a version was replaced when the next one was published; a name may be used again
    replaced: dict[str, float] = {}
    for (_, _, v), (_, at, _) in zip(past[1:], past):
        replaced.setdefault(v, at)
    keep = {past[0][2]} if past else set()
    gone = []
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return gone
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        if name == POINTERS or name in keep:
            continue
        since = replaced.get(name, status.getModificationTime() / 1000)
        if now - since > older_than:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def expire_work(spark: SparkSession, older_than: float, now: float | None = None) -> list[str]:
    """Removes what jobs wrote to cut their lineage and left in the shared folder, if it was
    last changed over ``older_than`` seconds ago; returns the names. To be run with an
    age beyond any running job's length."""
    from callwise.session import shared_dir
    now = time.time() if now is None else now
    fs, p = _fs(spark, f"{shared_dir(spark).rstrip('/')}/callwise")
    gone = []
    if fs.exists(p):
        for status in fs.listStatus(p):
            if now - status.getModificationTime() / 1000 > older_than:
                fs.delete(status.getPath(), True)
                gone.append(status.getPath().getName())
    return sorted(gone)
