"""Small operators: size-checked broadcast, fan-out products, keyed hash keys."""
from pyspark.sql import functions as F

from callwise.functions.hashing import MODULUS, hash_uniform_int
from callwise.operators.fanout import fan
from callwise.operators.joins import bounded_broadcast, rows_at_most


def test_rows_at_most_and_broadcast_hint(spark):
    small = spark.range(10)
    assert rows_at_most(small, 10) and not rows_at_most(small, 9)
    hinted = bounded_broadcast(small, 100)
    big = spark.range(1000)
    assert "broadcast" in hinted._jdf.queryExecution().analyzed().toString().lower()
    assert bounded_broadcast(big, 100) is big


def test_fan_multiplies_by_at_least_one(spark):
    df = spark.createDataFrame([(3, 0), (3, 2), (None, 4), (2, None)], "a long, b long")
    assert [r.x for r in df.select(fan(F.col("a"), F.col("b")).alias("x")).collect()] == [3, 6, 0, 2]


def test_draws_take_text_and_wide_integer_keys(spark):
    df = spark.createDataFrame([("R001", 2 ** 40), ("R001", 2 ** 40 + 2 ** 31 - 1)], "s string, i long")
    rows = df.select(hash_uniform_int(["s"], 3).alias("s"), hash_uniform_int(["i"], 3).alias("i")).collect()
    assert rows[0].s == rows[1].s and rows[0].i != rows[1].i
    assert all(0 <= x < MODULUS for r in rows for x in r)


def test_hash_is_uniform_enough(spark):
    h = spark.range(20000).select(hash_uniform_int(["id"], 5).alias("h"))
    buckets = {r.b: r["count"] for r in
               h.groupBy((F.col("h") * 10 / MODULUS).cast("int").alias("b")).count().collect()}
    assert len(buckets) == 10 and all(1700 < n < 2300 for n in buckets.values())
