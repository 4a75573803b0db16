"""Plan properties that must hold at any input size."""
import pytest

import __spark_entry__ as entry
from callwise.sources import roles as R

QUERIES = entry.queries()
SKIP = {"kmeans_model_selection", "csv_round_trip", "rep_efficiency_streamed"}


def executed_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SKIP))
def test_no_nested_loop_or_cartesian_join(spark, smoke_dir, name):
    plan = executed_plan(QUERIES[name](spark, smoke_dir))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_fact_build_pushes_filters_and_prunes(spark, smoke_dir):
    v = R.visits_from_tpch(spark, smoke_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in v
    assert "o_totalprice" not in v and "l_extendedprice" not in v
    c = R.prescription_cells_from_tpch(spark, smoke_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,R)" in c


def test_scaler_and_assignment_are_projections(spark, smoke_dir):
    from callwise.plans import doctors
    r = R.load_roles(spark, smoke_dir)
    feats = doctors.load_features(spark, smoke_dir)
    for df in (doctors.doctor_features_scaled(r, feats), doctors.nearest_level_centroid(r, feats)):
        plan = executed_plan(df)
        assert "Exchange" not in plan and "Join" not in plan


def test_segment_labels_do_not_join_on_cluster(spark, smoke_dir):
    from callwise.plans import segments
    sel = segments.select_model(R.load_roles(spark, smoke_dir), k_range=range(2, 4), n_init=2)
    plan = segments.doctor_segments(sel)._jdf.queryExecution().optimizedPlan().toString()
    assert all("cluster" not in line for line in plan.splitlines() if "Join" in line)


def test_quarter_slicer_prunes_fact_partitions(spark, smoke_dir):
    plan = executed_plan(QUERIES["bi_measures_sliced"](spark, smoke_dir))
    assert "PartitionFilters: [isnotnull(quarter" in plan and "= 4)]" in plan


@pytest.mark.parametrize("name", ["rep_scorecard", "rep_revenue", "doctor_coverage", "rep_scorecard_dedup", "doctor_coverage_dedup"])
def test_no_exchange_between_the_facts_and_their_doctor_joins(spark, smoke_dir, name):
    """Facts laid out by doctor are joined and grouped by doctor where they lie: none of their
    rows is exchanged by doctor_id."""
    df = QUERIES[name](spark, smoke_dir)
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [next(i for i, c in enumerate(line) if c.isalnum()) if any(c.isalnum() for c in line) else 0 for line in lines]
    scans = [i for i, line in enumerate(lines) if "FileScan" in line and "callwise_" in line]
    assert len(scans) >= 2
    for i in scans:
        assert "Bucketed: true" in lines[i], lines[i]
        at = depth[i]
        for j in range(i, -1, -1):          # the operators above the scan
            if depth[j] < at:
                at = depth[j]
                assert "Exchange hashpartitioning(doctor_id" not in lines[j], lines[j]


def test_buckets_follow_the_input(spark):
    from types import SimpleNamespace
    counts = [R.bucket_count(SimpleNamespace(count=lambda n=n: n)) for n in (0, 10 ** 6, 10 ** 8, 10 ** 13)]
    assert counts == [8, 8, 100, R.MAX_BUCKETS]


def test_bucketed_tables_keep_every_row_and_prune_quarters(spark, smoke_dir):
    r = R.load_roles(spark, smoke_dir)
    lazy = R.roles_from_tpch(spark, smoke_dir)
    for a, b in ((r.prescriptions, lazy.prescriptions),):
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    plan = executed_plan(r.prescriptions.where("quarter = 4"))
    assert "PartitionFilters: [isnotnull(quarter" in plan
