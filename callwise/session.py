"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings a job needs regardless of cluster size. Partition counts are left to
# AQE: it coalesces small shuffles and splits skewed join partitions at run time.
_BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # No broadcast from compile-time size *estimates* (file sizes can understate the
    # in-memory size many times over). AQE still turns a join into a broadcast join
    # at run time when the *measured* shuffle output of one side is below its own
    # threshold, so every broadcast rests on a real size.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    # tables bucketed by doctor_id join on (doctor_id, product, month) as they lie
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def scale_conf(input_bytes: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Shuffle and scan sizing for a cluster run over ``input_bytes`` of parquet.

    The initial shuffle partition count gives about ``partition_bytes`` of input per
    reducer. AQE then coalesces small partitions toward the advisory size and splits
    skewed ones, so tasks fit executor memory without spilling at any input size."""
    n = max(200, min(200_000, input_bytes // partition_bytes))
    mb = f"{partition_bytes >> 20}m"
    return {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": mb,
        "spark.sql.files.maxPartitionBytes": mb,
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": f"{4 * (partition_bytes >> 20)}m",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    }


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "callwise", input_bytes: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _BASE_CONF.items():
        builder = builder.config(k, v)
    if input_bytes:
        for k, v in scale_conf(input_bytes).items():
            builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def session_key(spark: SparkSession) -> str:
    """Identity of the running application, for per-session caches."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # Spark Connect sessions expose no SparkContext
        return spark.conf.get("spark.app.id", None) or str(id(spark))


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors, taken from ``spark.checkpoint.dir``.

    On a cluster that setting names durable shared storage, and it must be set.
    Only in local mode, when it is unset (tests), do we create one and register it
    as the session's checkpoint dir so that ``DataFrame.checkpoint`` uses it.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server owns the checkpoint dir
        sc = None
    d = sc.getCheckpointDir() if sc is not None else None
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
        if d and sc is not None:
            sc.setCheckpointDir(d)
    if not d:
        master = sc.master if sc is not None else (spark.conf.get("spark.master", "") or "")
        if not master.startswith("local"):
            # a machine-local folder would not be visible to other executors
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        d = tempfile.mkdtemp(prefix="callwise-ckpt-")
        if sc is not None:
            sc.setCheckpointDir(d)
            d = sc.getCheckpointDir() or d
    return d


def new_output_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused location under the shared folder."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/callwise/{name}-{uuid.uuid4().hex}"


def local_path(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


def ensure_parent(path: str) -> None:
    p = local_path(path)
    if "://" not in p:
        os.makedirs(os.path.dirname(p), exist_ok=True)
