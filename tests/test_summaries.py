"""Summary tables: dense numbers, bitmaps against distinct counts, every slicer against the facts."""
import itertools
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from callwise.operators.bitmaps import BUCKET, bucket_of, distinct_keys, key_bitmap, numbered
from callwise.plans import bi, reps, summaries
from callwise.sources import roles as R


@pytest.fixture(scope="module")
def roles(spark, smoke_dir):
    return R.load_roles(spark, smoke_dir)


@pytest.fixture(scope="module")
def tables(spark, smoke_dir):
    return summaries.load_summaries(spark, smoke_dir)


@pytest.mark.parametrize("n,parts", [(0, 3), (1, 3), (5000, 7)])
def test_numbers_are_dense_and_follow_the_order(spark, n, parts):
    rng = random.Random(n)
    rows = [(f"D{i}", rng.randint(0, 5)) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doctor_id string, territory int").repartition(parts)
    got = numbered(df, ["territory", "doctor_id"]).orderBy("number").collect()
    assert [r.number for r in got] == list(range(1, n + 1))
    assert [(r.territory, r.doctor_id) for r in got] == sorted((t, d) for d, t in rows)


def test_bitmaps_equal_distinct_counts(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), rng.choice("xyz"), rng.choice([None, rng.randint(1, 200_000), 32768, 32769])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "g string, cell string, number long")
    cells = df.groupBy("g", "cell", bucket_of("number").alias(BUCKET)).agg(key_bitmap("number").alias("m"), F.count(F.lit(1)).alias("n"))
    for group in ([], ["g"], ["cell"], ["g", "cell"]):
        got = {tuple(r[c] for c in group): (r.k, r.n) for r in distinct_keys(cells, "m", group, "k", ["n"]).collect()}
        want = {tuple(r[c] for c in group): (r.k, r.n) for r in df.groupBy(*group).agg(F.countDistinct("number").alias("k"), F.count(F.lit(1)).alias("n")).collect()}
        assert got == want


def regions(roles):
    return [None] + sorted(r.region for r in roles.territories.select("region").distinct().collect())


def test_unique_doctors_under_every_region(spark, smoke_dir, roles, tables):
    perf = reps.load_rep_performance(spark, smoke_dir)
    place = roles.reps.join(roles.territories.select("territory_id", "region"), "territory_id").select("rep_id", "region")
    visits = roles.visits.join(place, "rep_id", "left")
    for region in regions(roles):
        own = visits if region is None else visits.where(F.col("region") == region)
        want = own.agg(F.countDistinct("doctor_id"), F.count(F.lit(1))).first()
        got = bi.measures(roles, region=region, perf=perf, tables=tables).first()
        assert (got.unique_doctors_visited, got.total_visits) == tuple(want)


def test_every_visual_under_every_slicer(roles, tables):
    cube = summaries.sales_cube(roles, tables.sales).cache()
    facts = roles.prescriptions.join(roles.territories.select("territory_id", "region"), "territory_id", "left")
    rows = [r.asDict() for r in facts.select("region", "product", "quarter", "month", "revenue", "units_prescribed").collect()]
    got = {}
    for r in cube.collect():
        got.setdefault(r.gid, []).append(r.asDict())
    columns = [*summaries.SLICERS, "month"]
    for region, product, quarter in itertools.product([None, "ASIA", "EUROPE"], [None, "NeuroCalm"], [None, 1, 4]):
        kept = [r for r in rows if region in (None, r["region"]) and product in (None, r["product"]) and quarter in (None, r["quarter"])]
        for name, by in summaries.VISUALS.items():
            want = {}
            for r in kept:
                k = tuple(r[c] for c in by)
                a, b, n = want.get(k, (0, 0, 0))
                want[k] = (a + r["revenue"], b + r["units_prescribed"], n + 1)
            grouped = {c for c, v in zip(summaries.SLICERS, (region, product, quarter)) if v is not None} | set(by)
            gid = sum(0 if c in grouped else 8 >> i for i, c in enumerate(columns))
            mine = {tuple(r[c] for c in by): (r["total_revenue"], r["total_units"], r["n_prescriptions"]) for r in got.get(gid, [])
                    if region in (None, r["region"]) and product in (None, r["product"]) and quarter in (None, r["quarter"])}
            assert mine == want, (name, region, product, quarter)
    one = {r.month: r.total_revenue for r in summaries.visual(cube, "line", region="ASIA").collect()}
    assert one == {r.month: r.total_revenue for r in summaries.monthly_revenue(roles, region="ASIA", summary=tables.sales).collect()}
    cube.unpersist()


@pytest.mark.parametrize("name", ["bi_measures", "bi_measures_sliced", "bi_measures_by_region"])
def test_measures_read_no_facts_and_count_without_expand(spark, smoke_dir, name):
    df = entry.queries()[name](spark, smoke_dir)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    base = R.fact_path(spark, smoke_dir, "visits").rsplit("/", 1)[0]
    assert "Expand" not in plan and base not in plan and "visit_id" not in plan and "rep_id,doctor_id" not in plan


def test_the_reach_summary_does_not_grow_with_the_visits(spark, smoke_dir, roles, tables):
    more = R.Roles(roles.territories, roles.reps, roles.doctors, roles.visits.union(roles.visits).union(roles.visits), roles.prescriptions)
    assert summaries.reach(more).count() == tables.reach.count()


def test_visits_to_unknown_doctors_and_by_unknown_reps(spark, smoke_dir, roles):
    extra = roles.visits.limit(3).withColumn("doctor_id", F.lit(10 ** 9).cast("bigint"))
    lost = roles.visits.limit(2).withColumn("rep_id", F.lit(10 ** 9).cast("bigint"))
    none = roles.visits.limit(2).withColumn("doctor_id", F.lit(None).cast("bigint"))
    r = R.Roles(roles.territories, roles.reps, roles.doctors, roles.visits.union(extra).union(lost).union(none), roles.prescriptions)
    got = bi.measures(r).first()
    assert got.total_visits == r.visits.count()
    assert got.unique_doctors_visited == r.visits.agg(F.countDistinct("doctor_id")).first()[0]
