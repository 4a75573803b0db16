"""Outputs appear whole: between publishes, after a failed one, and while old ones go."""
import os
import time

import pytest
from pyspark.sql import functions as F

from callwise.session import new_output_path
from callwise.sources import publish as P


def values(df):
    return sorted(r[0] for r in df.collect())


def test_readers_see_whole_versions_only(spark, tmp_path):
    root = f"file:{tmp_path}/table"
    with pytest.raises(P.NotPublished):
        P.current(spark, root)
    P.publish(spark.range(5), root)
    held = P.current(spark, root)
    assert values(held) == list(range(5))
    spark.range(100).write.parquet(f"{root}/v-unfinished")          # written, not announced
    assert values(P.current(spark, root)) == list(range(5))
    P.publish(spark.range(7), root)
    assert values(held) == list(range(5))                           # a reader that started earlier goes on
    assert values(P.current(spark, root)) == list(range(7))


def test_a_failed_write_leaves_the_last_version(spark, tmp_path):
    root = f"{tmp_path}/table"
    P.publish(spark.range(3), root)
    broken = spark.range(1000).select(F.when(F.col("id") == 999, F.raise_error(F.lit("disk full"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception, match="disk full"):
        P.publish(broken, root)
    assert values(P.current(spark, root)) == [0, 1, 2] and len(P.history(spark, root)) == 1
    now = time.time()
    assert P.expire(spark, root, 3600, now=now + 60) == []
    gone = P.expire(spark, root, 3600, now=now + 7200)
    assert values(P.current(spark, root)) == [0, 1, 2] and len(gone) <= 1


def test_replaced_versions_go_by_age(spark, tmp_path):
    root = f"{tmp_path}/table"
    paths = [P.publish(spark.range(n), root) for n in (1, 2, 3)]
    replaced = [at for _, at, _ in P.history(spark, root)][::-1][1:]       # when 1 and 2 were replaced
    assert P.expire(spark, root, 100, now=replaced[0] + 99) == []
    assert P.expire(spark, root, 100, now=replaced[1] + 101) == sorted(os.path.basename(p) for p in paths[:2])
    assert values(P.current(spark, root)) == [0, 1, 2]
    assert [os.path.exists(p) for p in paths] == [False, False, True]


def test_a_repeated_batch_publishes_once(spark, tmp_path):
    root = f"{tmp_path}/table"
    for n in (4, 6):
        P.publish(spark.range(n), root, "epoch-0")
    assert values(P.current(spark, root)) == list(range(6))
    assert sorted(x for x in os.listdir(root) if x != P.POINTERS) == ["epoch-0"]


def test_leftovers_of_jobs_go_by_age(spark):
    path = new_output_path(spark, "leftover")
    spark.range(3).write.parquet(path)
    name = path.rsplit("/", 1)[1]
    assert name not in P.expire_work(spark, 10 ** 9)
    local = path[len("file:"):] if path.startswith("file:") else path
    assert os.path.exists(local)
