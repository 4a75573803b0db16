"""Dashboard measures and visual tables, with region / product / quarter slicers.

Filter scope follows the relationships of the model: ``product`` and ``quarter``
sit on prescriptions and filter only prescriptions; ``region`` sits on
territories and reaches prescriptions through their territory, visits and the rep
scorecard through the rep's territory, and market potential directly.

All measures of one evaluation come from a single aggregation over a union of
per-table contributions (one row shape, NULLs where a table does not contribute),
so no measure needs a join against another measure's result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callwise.functions.exact import divide_or_zero, ratio_round
from callwise.functions.labels import score_band
from callwise.operators.bitmaps import distinct_keys
from callwise.operators.fanout import pairs_of
from callwise.plans.reps import rep_performance_full
from callwise.plans.summaries import Summaries, reach, sales, sliced
from callwise.sources.roles import Roles


def _filtered_rx(r: Roles, region=None, product=None, quarter=None) -> DataFrame:
    rx = r.prescriptions
    if product is not None:
        rx = rx.filter(F.col("product") == product)
    if quarter is not None:
        rx = rx.filter(F.col("quarter") == quarter)
    if region is not None:
        t = r.territories.filter(F.col("region") == region).select("territory_id")
        rx = rx.join(t, "territory_id", "left_semi")
    return rx


def measures(r: Roles, region: str | None = None, product: str | None = None,
             quarter: int | None = None, by_region: bool = False,
             perf: DataFrame | None = None, tables: Summaries | None = None) -> DataFrame:
    """Total Revenue, Total Units, Total Visits, Unique Doctors Visited, Avg Efficiency
    Score, Market Capture %, Revenue per Visit, High Potential Call %, Wasted Calls.

    Visits come from the reach summary: its rows do not grow with the visits, and unique
    doctors are the bits of merged bitmaps instead of a distinct count."""
    tables = tables if tables is not None else Summaries(reach(r), sales(r))
    keys = ["region"] if by_region else []
    place = r.territories.select("territory_id", "region")
    rx = sliced(tables.sales, region, product, quarter).groupBy(*keys).agg(F.sum("revenue").alias("revenue"), F.sum("units").alias("units"))
    seen = distinct_keys(sliced(tables.reach, region), "doctors", keys, "n_doctors", ["n_v", "n_high", "n_low"])
    perf = (perf if perf is not None else rep_performance_full(r)).select("rep_id", "score_x100")
    perf = sliced(perf.join(r.reps.select("rep_id", "territory_id"), "rep_id", "left").join(place, "territory_id", "left"), region)
    terr = sliced(r.territories.select("region", "market_potential"), region)
    columns = ["revenue", "units", "n_doctors", "n_v", "n_high", "n_low", "score_x100", "market_potential"]

    def shape(df: DataFrame) -> DataFrame:
        """One row shape for every table's part, empty where it has none."""
        return df.select(*keys, *[F.col(c) if c in df.columns else F.lit(None).cast("bigint").alias(c) for c in columns])

    parts = shape(rx).unionByName(shape(seen)).unionByName(shape(perf)).unionByName(shape(terr))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    g = parts.groupBy(*keys).agg(
        total("revenue").alias("total_revenue"), total("units").alias("total_units"),
        total("n_v").alias("total_visits"), total("n_doctors").alias("unique_doctors_visited"),
        F.sum("score_x100").alias("score_sum"), F.count("score_x100").alias("score_n"),
        F.sum("market_potential").alias("market_potential"),
        total("n_high").alias("high_calls"), total("n_low").alias("wasted_calls"))
    return g.select(
        *keys, "total_revenue", "total_units", "total_visits", "unique_doctors_visited",
        F.try_divide(F.col("score_sum").cast("double"), (F.col("score_n") * 100).cast("double"))
        .alias("avg_efficiency_score"),
        (divide_or_zero("total_revenue", "market_potential") * 100).alias("market_capture_pct"),
        divide_or_zero("total_revenue", "total_visits").alias("revenue_per_visit"),
        (divide_or_zero("high_calls", "total_visits") * 100).alias("high_potential_call_pct"),
        "wasted_calls")


def qoq_growth(r: Roles, region=None, product=None) -> DataFrame:
    """Revenue per quarter, the revenue of quarter - 1 (NULL when that quarter has none)
    and the growth in percent (0 when there is no previous revenue).

    The window runs over at most four aggregated rows (one per quarter)."""
    q = (_filtered_rx(r, region, product).groupBy("quarter")
         .agg(F.sum("revenue").cast("bigint").alias("revenue")))
    prev = F.sum("revenue").over(Window.orderBy("quarter").rangeBetween(-1, -1))
    q = q.withColumn("prev_revenue", prev.cast("bigint"))
    return q.select("quarter", "revenue", "prev_revenue",
                    (divide_or_zero(F.col("revenue") - F.coalesce("prev_revenue", F.lit(0)),
                                    F.col("prev_revenue")) * 100).alias("growth_pct"))


def revenue_by_product(r: Roles, region=None, product=None, quarter=None) -> DataFrame:
    """Revenue per product and its share of the (sliced) total; the total is a scalar subquery."""
    rx = _filtered_rx(r, region, product, quarter)
    g = rx.groupBy("product").agg(F.sum("revenue").cast("bigint").alias("total_revenue"))
    return (g.withColumn("grand_total", rx.agg(F.sum("revenue")).scalar())
            .select("product", "total_revenue",
                    ratio_round("total_revenue", "grand_total", 100, 1).alias("revenue_share_pct")))


def quarterly_revenue_by_product(r: Roles, region=None, product=None, quarter=None) -> DataFrame:
    return (_filtered_rx(r, region, product, quarter).groupBy("quarter", "product")
            .agg(F.sum("revenue").cast("bigint").alias("total_revenue")))


def rep_scorecard_banded(r: Roles, perf: DataFrame | None = None) -> DataFrame:
    p = perf if perf is not None else rep_performance_full(r)
    return p.select("rep_id", "rep_name", "efficiency_score", "high_pct", "low_pct", "total_calls",
                    "call_achievement_pct", "total_revenue",
                    score_band(F.col("score_x100")).alias("score_band"))


def call_distribution(r: Roles) -> DataFrame:
    """Visits by rep name and doctor potential (the stacked-bar table)."""
    pot = r.doctors.select("doctor_id", "prescribing_potential")
    per = (pairs_of(r).join(pot, "doctor_id")
           .groupBy("rep_id", "prescribing_potential").agg(F.sum("n_v").alias("n")))
    return (per.join(r.reps.select("rep_id", "rep_name"), "rep_id")
            .groupBy("rep_name", "prescribing_potential")
            .agg(F.sum("n").cast("bigint").alias("call_count")))


def efficiency_vs_revenue(r: Roles, perf: DataFrame | None = None) -> DataFrame:
    p = perf if perf is not None else rep_performance_full(r)
    return (p.select("rep_id", "rep_name", "efficiency_score", "total_revenue", "total_calls")
            .orderBy(F.col("efficiency_score").desc_nulls_last(), "rep_id"))


def territory_scorecard(r: Roles, product=None, quarter=None) -> DataFrame:
    """Every territory with its revenue (0 when none) and market capture (DIVIDE .., 0)."""
    rx = _filtered_rx(r, None, product, quarter)
    per = rx.groupBy("territory_id").agg(F.sum("revenue").alias("rev"))
    t = r.territories.join(per, "territory_id", "left")
    return t.select("territory_id", "territory_name", "region", "market_potential",
                    F.coalesce("rev", F.lit(0)).cast("bigint").alias("total_revenue"),
                    (divide_or_zero(F.coalesce("rev", F.lit(0)), F.col("market_potential")) * 100)
                    .alias("market_capture_pct")
                    ).orderBy(F.col("market_capture_pct").desc(), "territory_id")


def visits_month_name(r: Roles) -> DataFrame:
    return r.visits.select("visit_id", F.date_format("visit_date", "MMMM").alias("visit_month_name"))


def rx_quarter_label(r: Roles) -> DataFrame:
    return r.prescriptions.select("prescription_id",
                                  F.concat(F.lit("Q"), F.col("quarter").cast("string"))
                                  .alias("quarter_label"))


def calendar_fields(r: Roles) -> DataFrame:
    return r.visits.select("visit_id", "visit_date",
                           F.month("visit_date").cast("int").alias("month"),
                           F.quarter("visit_date").cast("int").alias("quarter"))


def formatted_ids(r: Roles) -> DataFrame:
    """Zero-padded display codes: T01, R001, D0001 (wider ids keep all their digits).
    Ids that are already text (reference-shaped input) are their own codes."""
    def codes(df: DataFrame, entity: str, col: str, fmt: str) -> DataFrame:
        numeric = dict(df.dtypes)[col] in ("int", "bigint", "smallint", "tinyint")
        code = F.format_string(fmt, F.col(col)) if numeric else F.col(col).cast("string")
        return df.select(F.lit(entity).alias("entity"),
                         (F.col(col).cast("bigint") if numeric else F.col(col)).alias("id"),
                         code.alias("code"))
    return (codes(r.territories, "territory", "territory_id", "T%02d")
            .unionByName(codes(r.reps, "rep", "rep_id", "R%03d"))
            .unionByName(codes(r.doctors, "doctor", "doctor_id", "D%04d")))
