"""Orphans by bitmaps, checks of arriving batches, and medians by counting."""
import random
import statistics

import pytest
from pyspark.sql import functions as F

from callwise.operators.quality import fk_report, possible_orphans
from callwise.operators.ranking import exact_median
from callwise.plans import quality, segments
from callwise.sources.roles import load_roles
from callwise.streaming.checks import batch_report, reports, start_checks


def edge(spark, children, parents, kind="long"):
    c = spark.createDataFrame([(k, i) for i, k in enumerate(children)], f"fk {kind}, v long")
    p = spark.createDataFrame([(k,) for k in parents], f"pk {kind}")
    possible = possible_orphans(c, "fk", p, "pk")
    got = fk_report(c, "c", "fk", p, "p", "pk").first()
    bad = [k for k in children if k is not None and k not in set(parents)]
    assert (got.orphan_rows, got.orphan_keys) == (len(bad), len(set(bad)))
    return None if possible is None else possible.count()


def test_orphans_of_whole_numbers(spark):
    rng = random.Random(1)
    parents = list(range(1, 100_001))
    children = [rng.randint(1, 100_000) for _ in range(5000)] + [None] * 10
    assert edge(spark, children, parents) == 0                     # nothing is left for the anti join
    one = edge(spark, children + [100_005, 0, -3], parents)
    assert one == 3                                                # outside the range: no bucket is suspicious
    gap = [p for p in parents if p != 40_000]
    some = edge(spark, [c for c in children if c != 40_000] + [40_000] * 4, gap)
    assert 4 <= some < len(children) / 2                           # the rows of one bucket
    assert edge(spark, [None, None], parents) == 0
    assert edge(spark, [], parents) == 0


def test_orphans_of_other_keys_are_exact_too(spark):
    assert edge(spark, ["a", "b", None, "z", "z"], ["a", "b", "c"], "string") is None
    assert edge(spark, [1, 2, 10 ** 15, 10 ** 15], [1, 10 ** 17], "long") is None      # a sparse range
    assert edge(spark, [1, 1], [], "long") is None
    assert edge(spark, [-40_000, -1, 0, 5, 7], [-40_000, -1, 0, 5], "long") == 1


def test_a_planted_orphan_of_the_segment_table_is_reported(spark, smoke_dir):
    r = load_roles(spark, smoke_dir)
    seg = segments.load_segments(spark, smoke_dir)
    edge_of = lambda t: quality.fk_orphans(r, segments=t).where("child_table = 'doctor_segments'").first()
    assert (edge_of(seg).orphan_rows, edge_of(seg).orphan_keys) == (0, 0)
    planted = seg.union(seg.limit(2).withColumn("doctor_id", F.lit(10 ** 8).cast("bigint")))
    assert (edge_of(planted).orphan_rows, edge_of(planted).orphan_keys) == (2, 1)


def test_batches_are_checked_as_they_arrive(spark, tmp_path):
    src, out, ckpt = (f"{tmp_path}/{n}" for n in ("src", "out", "ckpt"))
    reps = spark.createDataFrame([(1,), (2,)], "rep_id long")
    schema = "visit_id string, rep_id long"

    def arrive(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/part={name}")
        start_checks(spark, f"{src}/*", spark.createDataFrame([], schema).schema, [("rep_id", reps, "rep_id")], "visit_id", out, ckpt).awaitTermination()
        return {(r.batch, r.check): (r.bad_rows, r.bad_keys) for r in reports(spark, out).collect()}

    assert arrive("a", [("V1", 1), ("V2", 2), ("V3", None)]) == {(0, "orphan"): (0, 0), (0, "repeated key"): (0, 0)}
    got = arrive("b", [("V4", 9), ("V5", 9), ("V6", 1), ("V6", 1), ("V1", 2)])      # an orphan rep, a repeat, and an old key
    assert got[1, "orphan"] == (2, 1) and got[1, "repeated key"] == (3, 2) and got[0, "orphan"] == (0, 0)
    again = batch_report(spark.createDataFrame([("V9", 1)], schema), [("rep_id", reps, "rep_id")], "visit_id", None)
    assert {r.check: r.bad_rows for r in again.collect()} == {"orphan": 0, "repeated key": 0}


@pytest.mark.parametrize("kind,values", [
    ("long", [3]), ("long", [3, 4]), ("long", [5] * 9), ("long", [5] * 5 + [6] * 5), ("int", [None, 1, 2, 3, None, 10]), ("long", [-2 ** 63, 2 ** 63 - 1]),
    ("long", [-2 ** 63, 2 ** 63 - 2, 2 ** 63 - 1]), ("long", [2 ** 62, 2 ** 62 + 1, 2 ** 62 + 3, 0, 2 ** 62 + 2]), ("double", [0.1, 0.2, 1e300, -1e300, 5e-324]),
    ("double", [1.0, 1.0 + 2 ** -52, 1.0 + 2 ** -51]), ("long", []), ("long", [None])])
def test_median_of_any_domain(spark, kind, values):
    got = exact_median(spark.createDataFrame([(v,) for v in values], f"x {kind}"), "x")
    known = sorted(v for v in values if v is not None)
    if not known:
        assert got is None
    else:
        assert got == (float(known[(len(known) - 1) // 2]) + float(known[len(known) // 2])) / 2


@pytest.mark.parametrize("n", [999, 1000])
def test_median_equals_the_built_in_one(spark, n):
    rng = random.Random(n)
    df = spark.createDataFrame([(rng.randint(0, 10 ** 12), round(rng.lognormvariate(0, 3), 4)) for _ in range(n)], "a long, b double")
    for c in "ab":
        assert exact_median(df, c) == df.agg(F.median(c)).first()[0]


def test_median_of_doctor_revenue_takes_few_counts_a_round(spark, smoke_dir):
    from callwise.plans.doctors import load_features
    feats = load_features(spark, smoke_dir)
    assert exact_median(feats, "total_revenue") == statistics.median(r[0] for r in feats.select("total_revenue").collect())
