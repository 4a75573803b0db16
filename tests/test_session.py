"""Shared folder handling and input-size based settings."""
from callwise.session import new_output_path, scale_conf, shared_dir


def test_shared_dir_is_the_sessions_checkpoint_dir(spark):
    d = shared_dir(spark)
    assert d and spark.sparkContext.getCheckpointDir() == d


def test_output_paths_are_never_reused(spark):
    a, b = new_output_path(spark, "x"), new_output_path(spark, "x")
    assert a != b and a.startswith(shared_dir(spark).rstrip("/"))


def test_scale_conf_sizes_partitions_by_input():
    small, big = scale_conf(1 << 30), scale_conf(100 << 40)
    assert int(small["spark.sql.shuffle.partitions"]) == 200
    assert int(big["spark.sql.shuffle.partitions"]) == 200_000
    assert big["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == "256m"
