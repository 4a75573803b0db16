"""Name -> query callable (spark, sf_dir) -> DataFrame, one per analysis."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from callwise.plans import bi, callplan, doctors, intake, kpi, medians, quality, reps, sampling, segments, summaries
from callwise.sources.roles import load_roles

Query = Callable[[SparkSession, str], DataFrame]

# slicer values used by the *_sliced entries
SLICE = {"region": "ASIA", "product": "NeuroCalm", "quarter": 4}


def _q(fn, **kw) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(load_roles(spark, sf_dir), **kw)
    q.__name__ = getattr(fn, "__name__", "query")
    return q


def _seg(fn) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(segments.cached_selection(spark, sf_dir))
    q.__name__ = getattr(fn, "__name__", "query")
    return q


PERF_READERS = {"top_reps_by_efficiency", "bottom_reps_by_low_pct", "rep_efficiency_chart",
                "efficiency_by_rep", "rep_scorecard_banded", "efficiency_vs_revenue"}


def _perf_q(fn, **kw) -> Query:
    """Plans that read the written rep scorecard table."""
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(load_roles(spark, sf_dir), perf=reps.load_rep_performance(spark, sf_dir), **kw)
    q.__name__ = getattr(fn, "__name__", "query")
    return q


def _measures_q(fn, **kw) -> Query:
    """Measures over the written summaries and the written rep scorecard."""
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(load_roles(spark, sf_dir), perf=reps.load_rep_performance(spark, sf_dir),
                  tables=summaries.load_summaries(spark, sf_dir), **kw)
    q.__name__ = getattr(fn, "__name__", "query")
    return q


def _sales_q(fn, **kw) -> Query:
    """Plans over the written sales summary."""
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(load_roles(spark, sf_dir), summary=summaries.load_summaries(spark, sf_dir).sales, **kw)
    q.__name__ = getattr(fn, "__name__", "query")
    return q


def _feat(fn) -> Query:
    """Plans over the doctor feature table, read from its written copy."""
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(load_roles(spark, sf_dir), doctors.load_features(spark, sf_dir))
    q.__name__ = getattr(fn, "__name__", "query")
    return q


def _fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key edges over the written scorecard and segment tables."""
    return quality.fk_orphans(load_roles(spark, sf_dir), perf=reps.load_rep_performance(spark, sf_dir),
                              segments=segments.load_segments(spark, sf_dir))


def _csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callwise.sources.files import round_trip_csv
    perf = reps.load_rep_performance(spark, sf_dir).select(*reps.PERF_COLUMNS)
    return round_trip_csv(perf, "rep_performance")


def role_plans() -> dict[str, tuple]:
    """name -> (plan function over Roles, keyword arguments)."""
    s = SLICE
    return {
        "rep_scorecard": (kpi.rep_scorecard, dict()),
        "rep_scorecard_dedup": (kpi.rep_scorecard, dict(dedup=True)),
        "call_efficiency": (kpi.call_efficiency, dict()),
        "overcall_flag": (kpi.overcall_flag, dict()),
        "overcall_flag_35": (kpi.overcall_flag, dict(threshold_pct=35)),
        "reach_frequency": (kpi.reach_frequency, dict()),
        "reach_frequency_dedup": (kpi.reach_frequency, dict(dedup=True)),
        "product_by_territory": (kpi.product_by_territory, dict()),
        "monthly_product_trend": (kpi.monthly_product_trend, dict()),
        "doctor_coverage": (kpi.doctor_coverage, dict()),
        "doctor_coverage_dedup": (kpi.doctor_coverage, dict(dedup=True)),
        "territory_roi": (kpi.territory_roi, dict()),
        "territory_roi_dedup": (kpi.territory_roi, dict(dedup=True)),
        "wasted_calls": (kpi.wasted_calls, dict()),
        "wasted_calls_dedup": (kpi.wasted_calls, dict(dedup=True)),
        "untapped_doctors": (kpi.untapped_doctors, dict()),
        "kpi_summary": (reps.kpi_summary, dict()),
        "rep_efficiency": (reps.rep_efficiency, dict()),
        "rep_revenue": (reps.rep_revenue, dict()),
        "rep_performance": (reps.rep_performance, dict()),
        "top_reps_by_efficiency": (reps.top_reps_by_efficiency, dict()),
        "bottom_reps_by_low_pct": (reps.bottom_reps_by_low_pct, dict()),
        "rep_efficiency_chart": (reps.rep_efficiency_chart, dict()),
        "efficiency_by_rep": (reps.rep_efficiency_chart, dict(n=None)),
        "call_mix_pct": (reps.call_mix_pct, dict()),
        "monthly_revenue_pivot": (reps.monthly_revenue_pivot, dict()),
        "quarterly_revenue": (reps.quarterly_revenue, dict()),
        "territory_capture": (reps.territory_capture, dict()),
        "product_mix_by_territory": (reps.product_mix_by_territory, dict()),
        "doctor_features": (doctors.doctor_features, dict()),
        "doctor_features_scaled": (doctors.doctor_features_scaled, dict()),
        "nearest_centroid": (doctors.nearest_level_centroid, dict()),
        "cluster_profile": (doctors.cluster_profile_levels, dict()),
        "bi_measures": (bi.measures, dict()),
        "bi_measures_sliced": (bi.measures, dict(**s)),
        "bi_measures_by_region": (bi.measures, dict(by_region=True)),
        "qoq_growth": (bi.qoq_growth, dict()),
        "qoq_growth_sliced": (bi.qoq_growth, dict(region=s["region"], product=s["product"])),
        "revenue_by_product": (bi.revenue_by_product, dict()),
        "quarterly_revenue_by_product": (bi.quarterly_revenue_by_product, dict()),
        "revenue_by_product_sliced": (bi.revenue_by_product, dict(region=s["region"], quarter=s["quarter"])),
        "quarterly_revenue_by_product_sliced": (bi.quarterly_revenue_by_product, dict(region=s["region"])),
        "sales_cube": (summaries.sales_cube, dict()),
        "monthly_revenue_sliced": (summaries.monthly_revenue, dict(region=s["region"], product=s["product"])),
        "rep_scorecard_banded": (bi.rep_scorecard_banded, dict()),
        "call_distribution": (bi.call_distribution, dict()),
        "efficiency_vs_revenue": (bi.efficiency_vs_revenue, dict()),
        "territory_scorecard": (bi.territory_scorecard, dict()),
        "visits_month_name": (bi.visits_month_name, dict()),
        "rx_quarter_label": (bi.rx_quarter_label, dict()),
        "calendar_fields": (bi.calendar_fields, dict()),
        "formatted_ids": (bi.formatted_ids, dict()),
        "pk_violations": (quality.pk_violations, dict()),
        "fk_orphans": (quality.fk_orphans, dict()),
        "expected_rx_probability": (sampling.expected_rx_probability, dict()),
        "call_plan_sample": (callplan.call_plan_sample, dict()),
    }


FEATURE_PLANS = {
    "doctor_features_scaled": doctors.doctor_features_scaled,
    "nearest_centroid": doctors.nearest_level_centroid,
    "cluster_profile": doctors.cluster_profile_levels,
    "feature_medians": medians.feature_medians,
    "kmeans_seeding": segments.kmeans_seeding,
    "kmeans_relocation": segments.kmeans_relocation,
}

SEGMENT_PLANS = {
    "kmeans_model_selection": segments.model_selection_table,
    "doctor_segments": segments.doctor_segments,
    "cluster_profile_kmeans": segments.cluster_profile_kmeans,
    "segment_summary": segments.segment_summary,
    "segment_scatter": segments.segment_scatter,
}


def _streamed_rep_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rep_efficiency maintained by the streaming refresh, fed by the written visit
    files themselves (a quarter-partitioned folder) in about four micro-batches."""
    from callwise.session import new_output_path
    from callwise.sources.roles import fact_path
    from callwise.streaming.refresh import refresh_rep_efficiency
    r = load_roles(spark, sf_dir)
    src = fact_path(spark, sf_dir, "visits")
    files = spark.read.parquet(src)
    per_trigger = max(1, -(-len(files.inputFiles()) // 4))
    return refresh_rep_efficiency(spark, src, files.schema, r.doctors, new_output_path(spark, "rep-eff"),
                                  new_output_path(spark, "rep-eff-ckpt"),
                                  max_files_per_trigger=per_trigger)


def queries() -> dict[str, Query]:
    made = {bi.measures: _measures_q, summaries.sales_cube: _sales_q, summaries.monthly_revenue: _sales_q}
    out: dict[str, Query] = {name: made.get(fn, _perf_q if name in PERF_READERS else _q)(fn, **kw)
                             for name, (fn, kw) in role_plans().items()}
    for name, fn in FEATURE_PLANS.items():
        out[name] = _feat(fn)
    out.update({name: _seg(fn) for name, fn in SEGMENT_PLANS.items()})
    out["csv_round_trip"] = _csv_round_trip
    out["fk_orphans"] = _fk_orphans
    out["csv_intake"] = _q(intake.csv_intake)
    out["rep_efficiency_streamed"] = _streamed_rep_efficiency
    return out
