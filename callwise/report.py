"""Run the whole analysis and write every table, like the original analysis script.

    python -m callwise.report --tables /root/testdata/sf0.1 --out /shared/field-report
    python -m callwise.report --csv /data/field-csv --out /shared/field-report --format csv

``--tables`` reads the TPC-H style driver tables through the role mapping;
``--csv`` reads reference-shaped ``territories.csv`` .. ``prescriptions.csv``. Each
result is written by the executors to ``<out>/<name>/``; only the short console
summary (one row, top 5 lists, one row per segment and per quarter) reaches the
driver.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from callwise.plans import reps, segments
from callwise.plans.registry import SEGMENT_PLANS, role_plans
from callwise.sources.intake import intake
from callwise.sources.roles import Roles, load_roles, materialize


def _write(df: DataFrame, path: str, fmt: str) -> None:
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def run(spark: SparkSession, roles: Roles, out: str, fmt: str = "parquet",
        with_segments: bool = True) -> dict:
    out = out.rstrip("/")
    for name, (fn, kw) in role_plans().items():
        _write(fn(roles, **kw), f"{out}/{name}", fmt)
    summary = {"kpi": reps.kpi_summary(roles).first().asDict(),
               "top5": [r.asDict() for r in reps.top_reps_by_efficiency(roles).collect()],
               "bottom5": [r.asDict() for r in reps.bottom_reps_by_low_pct(roles).collect()],
               "quarters": [r.asDict() for r in reps.quarterly_revenue(roles).collect()]}
    if with_segments:
        sel = segments.select_model(roles)
        for name, fn in SEGMENT_PLANS.items():
            _write(fn(sel), f"{out}/{name}", fmt)
        summary["best_k"] = sel.best_k
        summary["segments"] = [r.asDict() for r in segments.segment_summary(sel).collect()]
    return summary


def from_csv(spark: SparkSession, folder: str, out: str) -> Roles:
    """Roles of CSV files; lines that cannot be read go to ``out/quarantine``."""
    got = intake(spark, folder)
    got.quarantine.write.mode("overwrite").parquet(f"{out.rstrip('/')}/quarantine")
    return materialize(spark, got.roles())


def _print(summary: dict) -> None:
    k = summary["kpi"]
    print(f"Total revenue       : {k['total_revenue']:,}")
    print(f"Field visits        : {k['total_visits']:,}")
    print(f"Doctors reached     : {k['doctors_reached']} / {k['total_doctors']}")
    print(f"Avg visit frequency : {k['avg_visit_frequency']:.1f}")
    print(f"Top product         : {k['top_product']}")
    for title, rows, col in (("Top 5 by efficiency", summary["top5"], "efficiency_score"),
                             ("Top 5 by Low-potential share", summary["bottom5"], "low_pct")):
        print(title)
        for r in rows:
            print(f"  {r['rep_name']:<24} {col}={r[col]}  revenue={r['total_revenue']:,}")
    for q in summary["quarters"]:
        print(f"Q{q['quarter']}: {q['revenue']:,}")
    if "segments" in summary:
        print(f"Segments (K={summary['best_k']})")
        for s in summary["segments"]:
            print(f"  {s['segment']:<32} n={s['n_doctors']}  avg revenue={s['avg_revenue']:,.0f}"
                  f"  avg visits={s['avg_visits']:.1f}")


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--tables", help="folder with the TPC-H style parquet tables")
    src.add_argument("--csv", help="folder with territories.csv .. prescriptions.csv")
    ap.add_argument("--out", required=True, help="output folder (shared storage on a cluster)")
    ap.add_argument("--format", choices=["parquet", "csv"], default="parquet")
    ap.add_argument("--no-segments", action="store_true", help="skip the k-means model selection")
    a = ap.parse_args(argv)
    from callwise.session import get_spark
    spark = get_spark(app_name="callwise-report")
    # CSV input is parsed once and kept as columnar parquet for all the queries
    roles = load_roles(spark, a.tables) if a.tables else from_csv(spark, a.csv, a.out)
    _print(run(spark, roles, a.out, a.format, with_segments=not a.no_segments))


if __name__ == "__main__":
    main()
