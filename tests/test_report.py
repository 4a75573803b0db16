"""The report job writes every role-based table and returns the console summary."""
import os
import tempfile

from callwise import report
from callwise.plans.registry import role_plans
from callwise.sources.roles import load_roles


def test_report_writes_all_tables(spark, smoke_dir):
    out = tempfile.mkdtemp(prefix="report-")
    summary = report.run(spark, load_roles(spark, smoke_dir), out, with_segments=False)
    assert set(role_plans()) <= set(os.listdir(out))
    assert summary["kpi"]["total_doctors"] > 0 and len(summary["top5"]) == 5
    assert [q["quarter"] for q in summary["quarters"]] == [1, 2, 3, 4]


def test_report_on_csv_input(spark, smoke_dir):
    from callwise.sources.files import read_csv_roles, write_roles
    from callwise.sources.roles import materialize
    src = tempfile.mkdtemp(prefix="report-csv-")
    write_roles(load_roles(spark, smoke_dir), src, fmt="csv")
    roles = materialize(spark, read_csv_roles(spark, src))
    assert roles.cells is not None and dict(roles.visits.dtypes)["rep_id"] == "string"
    out = tempfile.mkdtemp(prefix="report-out-")
    summary = report.run(spark, roles, out, with_segments=False)
    assert summary["kpi"]["total_visits"] == load_roles(spark, smoke_dir).visits.count()
