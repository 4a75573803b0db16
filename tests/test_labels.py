"""Label helpers at their boundaries."""
from pyspark.sql import functions as F

from callwise.functions import labels as L


def test_score_band_boundaries(spark):
    df = spark.createDataFrame([(180,), (179,), (140,), (139,)], "s int")
    got = [r.b for r in df.select(L.score_band(F.col("s")).alias("b")).collect()]
    assert got == ["Green", "Yellow", "Yellow", "Red"]


def test_coverage_flag_thresholds(spark):
    rows = [("High", 7), ("High", 8), ("Low", 7), ("Low", 6), ("Medium", 6), ("Medium", 5)]
    df = spark.createDataFrame(rows, "p string, v long")
    got = [r.f for r in df.select(L.coverage_flag(F.col("p"), F.col("v")).alias("f")).collect()]
    assert got == ["Under-called High Value", "Standard Coverage", "Over-called Low Value",
                   "Standard Coverage", "Well Covered", "Standard Coverage"]


def test_segment_action_and_tokens(spark):
    labels = list(L.SEGMENT_LABELS.values())
    df = spark.createDataFrame([(s,) for s in labels], "s string")
    out = df.select(L.drop_first_token(F.col("s")).alias("n"),
                    L.segment_action(F.col("s")).alias("a")).collect()
    assert [r.n for r in out] == [s.split(" ", 1)[1] for s in labels]
    assert [r.a for r in out] == [L.SEGMENT_ACTIONS[s.split(" ", 1)[1]] for s in labels]


def test_short_name_and_price(spark):
    df = spark.createDataFrame([("Zone GERMANY", "NeuroCalm"), ("North Zone", "CardioMax")],
                               "t string, p string")
    out = df.select(L.short_territory_name(F.col("t")).alias("s"), L.price_of("p").alias("x")).collect()
    assert [(r.s, r.x) for r in out] == [("Zone GERMANY", 1100), ("North", 850)]


def test_integer_forms_follow_fixed_values():
    assert L.SCORE_WEIGHTS_X2 == {"High": 6, "Medium": 3, "Low": 1}
    assert L.POTENTIAL_CUMULATIVE_X10 == [("High", 2), ("Medium", 7), ("Low", 10)]
    assert L.SCORE_BANDS_X100 == {"Green": 180, "Yellow": 140}
