"""Portfolio summary, rep efficiency scoring and the chart tables of the analysis script."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwise.functions.exact import ratio_round, score_x100
from callwise.functions.labels import PRODUCTS, short_territory_name
from callwise.operators.fanout import cell_revenue, pairs_of
from callwise.operators.ranking import global_median, top_k
from callwise.sources.roles import Roles


def kpi_summary(r: Roles) -> DataFrame:
    """One row: revenue, visits, doctors reached / total, visits per reached doctor, top product.

    Four independent global aggregates joined as scalar subqueries (each is a
    one-row result; Catalyst merges those over the same relation)."""
    by_product = r.prescriptions.groupBy("product").agg(F.sum("revenue").alias("rev"))
    # idxmax: highest revenue, first product name on ties; the total comes from the
    # same per-product aggregate (Catalyst merges the two scalar subqueries)
    top_product = by_product.agg(
        F.min_by("product", F.struct(-F.col("rev"), F.col("product")))).scalar()
    total_revenue = by_product.agg(F.sum("rev")).scalar()
    per_doc = r.visits.groupBy("doctor_id").agg(F.count(F.lit(1)).alias("n"))
    visits = per_doc.agg(F.sum("n").alias("total_visits"),
                         F.count("doctor_id").alias("doctors_reached"))
    return visits.select(
        total_revenue.cast("bigint").alias("total_revenue"),
        F.col("total_visits").cast("bigint").alias("total_visits"),
        F.col("doctors_reached").cast("bigint").alias("doctors_reached"),
        r.doctors.agg(F.count(F.lit(1))).scalar().alias("total_doctors"),
        F.try_divide(F.col("total_visits").cast("double"), F.col("doctors_reached").cast("double"))
        .alias("avg_visit_frequency"),
        top_product.alias("top_product"))


def rep_calls(r: Roles) -> DataFrame:
    """Calls per rep by doctor potential (zero filled), total, score and shares.

    Visits are first reduced to (rep, doctor) counts, so the join with doctors moves
    one row per pair instead of one per visit."""
    pot = r.doctors.select("doctor_id", "prescribing_potential")
    j = pairs_of(r).join(pot, "doctor_id")
    # pivot on the fixed level list: missing levels become 0-filled columns
    g = (j.groupBy("rep_id").pivot("prescribing_potential", ["High", "Low", "Medium"])
         .agg(F.sum("n_v")).na.fill(0))
    g = g.select("rep_id", *[F.col(p).cast("bigint").alias(p) for p in ("High", "Low", "Medium")])
    return (g.withColumn("total_calls", F.col("High") + F.col("Medium") + F.col("Low"))
            .withColumn("score_x100", score_x100("High", "Medium", "Low"))
            .withColumn("efficiency_score", F.col("score_x100").cast("double") / 100.0)
            .withColumn("high_pct", ratio_round("High", "total_calls", 100, 1))
            .withColumn("low_pct", ratio_round("Low", "total_calls", 100, 1)))


def rep_efficiency(r: Roles) -> DataFrame:
    return rep_calls(r).select("rep_id", "High", "Medium", "Low", "total_calls",
                               "efficiency_score", "high_pct", "low_pct")


def rep_revenue(r: Roles) -> DataFrame:
    """Revenue attributed to reps: each prescription counted once per visit of the rep in
    the same (doctor, product, month) cell."""
    # the script de-duplicates the visit rows it attributes: nothing to do where visit_id is a
    # key, so the written cells are read; else the visits are compared
    if r.unique_visits and r.cells is not None:
        cells = cell_revenue(r.visits, r.prescriptions, r.cells)
    else:
        cells = cell_revenue(r.visits.dropDuplicates(["visit_id", "rep_id", "doctor_id", "month", "product"]), r.prescriptions)
    cells = cells.filter(F.col("revenue").isNotNull())
    return (cells.groupBy("rep_id")
            .agg(F.sum(F.col("n_v") * F.col("revenue")).cast("bigint").alias("total_revenue")))


PERF_COLUMNS = ["rep_id", "High", "Low", "Medium", "total_calls", "efficiency_score", "high_pct",
                "low_pct", "rep_name", "target_calls", "experience_yrs", "total_revenue",
                "call_achievement_pct", "revenue_per_call"]


def rep_performance_full(r: Roles) -> DataFrame:
    """rep_performance plus the integer score (score_x100) used for medians and bands."""
    reps = r.reps.select("rep_id", "rep_name", "target_calls", "experience_yrs")
    p = (rep_calls(r).join(reps, "rep_id").join(rep_revenue(r), "rep_id", "left")
         .withColumn("total_revenue", F.coalesce("total_revenue", F.lit(0)).cast("bigint")))
    return (p.withColumn("call_achievement_pct", ratio_round("total_calls", "target_calls", 100, 1))
            .withColumn("revenue_per_call", ratio_round("total_revenue", "total_calls", 1, 0))
            .select(*PERF_COLUMNS, "score_x100"))


def rep_performance(r: Roles) -> DataFrame:
    return rep_performance_full(r).select(*PERF_COLUMNS)


# The scorecard is a derived table in its own right (the dashboards import it):
# written once per session and input to the shared folder, then read by the
# top / bottom lists, the chart table and the BI measures.
_PERF_CACHE: dict[tuple[str, str], DataFrame] = {}


def load_rep_performance(spark, sf_dir: str) -> DataFrame:
    from callwise.session import new_output_path, session_key
    from callwise.sources.roles import load_roles
    key = (session_key(spark), sf_dir)
    if key not in _PERF_CACHE:
        path = new_output_path(spark, "rep-performance")
        df = rep_performance_full(load_roles(spark, sf_dir))
        df.write.mode("overwrite").parquet(path)
        _PERF_CACHE[key] = spark.read.parquet(path).select(*df.columns)
    return _PERF_CACHE[key]


def top_reps_by_efficiency(r: Roles, n: int = 5, perf: DataFrame | None = None) -> DataFrame:
    p = perf if perf is not None else rep_performance_full(r)
    return top_k(p, n, [F.col("efficiency_score").desc_nulls_last(), F.col("rep_id")]).select(
        "rep_id", "rep_name", "efficiency_score", "high_pct", "low_pct", "total_revenue")


def bottom_reps_by_low_pct(r: Roles, n: int = 5, perf: DataFrame | None = None) -> DataFrame:
    p = perf if perf is not None else rep_performance_full(r)
    return top_k(p, n, [F.col("low_pct").desc_nulls_last(), F.col("rep_id")]).select(
        "rep_id", "rep_name", "low_pct", "high_pct", "efficiency_score", "total_revenue")


def rep_efficiency_chart(r: Roles, n: int | None = 12, perf: DataFrame | None = None) -> DataFrame:
    """Top ``n`` reps by score (all reps, sorted, when ``n`` is None) with the median
    score of all reps and an above/below band.

    The median is taken over the integer score (bounded domain), so it is exact."""
    p = perf if perf is not None else rep_performance_full(r)
    med = global_median(p, "score_x100")
    order = [F.col("efficiency_score").desc_nulls_last(), F.col("rep_id")]
    top = top_k(p, n, order) if n is not None else p.orderBy(*order)
    return top.select(
        "rep_id", "rep_name", "efficiency_score",
        (med / 100.0).alias("median_score"),
        F.when(F.col("score_x100") < med, F.lit("below")).otherwise(F.lit("above")).alias("band"))


def call_mix_pct(r: Roles) -> DataFrame:
    """Share of each rep's calls by doctor potential, in percent (rows sum to 100)."""
    c = rep_calls(r)
    return c.select("rep_id", *[(F.try_divide(F.col(p).cast("double"), F.col("total_calls").cast("double"))
                                 * 100).alias(p) for p in ("High", "Medium", "Low")])


def monthly_revenue_pivot(r: Roles) -> DataFrame:
    """Revenue per month with one column per product (zero filled), one for products that
    are not listed, the total of all, and the same in millions."""
    g = r.prescriptions.groupBy("month").agg(*_revenue_columns("revenue"))
    cols = [*PRODUCTS, "other", "total_revenue"]
    return g.select("month", *cols, *[(F.col(c) / F.lit(1e6)).alias(f"{c}_m") for c in cols])


def _revenue_columns(revenue: str) -> list:
    """Sums per listed product, of all other products, and of everything."""
    def total(condition=None):
        c = F.col(revenue) if condition is None else F.when(condition, F.col(revenue))
        return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    listed = F.coalesce(F.col("product").isin(PRODUCTS), F.lit(False))
    return [*[total(F.col("product") == p).alias(p) for p in PRODUCTS], total(~listed).alias("other"),
            total().alias("total_revenue")]


def quarterly_revenue(r: Roles) -> DataFrame:
    """Revenue in each calendar quarter 1..4 by month ranges, zero filled.

    One pass of conditional sums gives a one-row result, unpivoted to four rows, so
    an empty quarter still appears with 0."""
    sums = r.prescriptions.agg(*[
        F.coalesce(F.sum(F.when(F.col("month").isin(list(range((q - 1) * 3 + 1, q * 3 + 1))),
                                F.col("revenue")).otherwise(0)), F.lit(0)).cast("bigint").alias(f"q{q}")
        for q in range(1, 5)])
    return sums.select(F.expr("stack(4, 1, q1, 2, q2, 3, q3, 4, q4) AS (quarter, revenue)"))


def territory_capture(r: Roles) -> DataFrame:
    """Revenue against market potential per territory (only territories with prescriptions),
    with a band against the median capture."""
    t = r.territories.select("territory_id", "territory_name", "market_potential")
    per_t = r.prescriptions.groupBy("territory_id").agg(F.sum("revenue").alias("revenue"))
    g = (per_t.join(t, "territory_id").groupBy("territory_name", "market_potential")
         .agg(F.sum("revenue").cast("bigint").alias("revenue"))
         .withColumn("capture_pct", F.try_divide(F.col("revenue").cast("double"),
                                                  F.col("market_potential").cast("double")) * 100))
    med = global_median(g, "capture_pct")
    return g.select(short_territory_name(F.col("territory_name")).alias("short_name"),
                    "territory_name", "market_potential", "revenue", "capture_pct",
                    med.alias("median_capture_pct"),
                    F.when(F.col("capture_pct") >= med, F.lit("above")).otherwise(F.lit("below"))
                    .alias("band"))


def product_mix_by_territory(r: Roles) -> DataFrame:
    """Share of each product, and of the unlisted ones, in a territory's revenue, in
    percent of all revenue."""
    t = r.territories.select("territory_id", "territory_name")
    per_t = (r.prescriptions.groupBy("territory_id", "product").agg(F.sum("revenue").alias("rev"))
             .join(t, "territory_id"))
    g = per_t.groupBy("territory_name").agg(*_revenue_columns("rev"))
    return g.select("territory_name", *[
        (F.try_divide(F.col(p).cast("double"), F.col("total_revenue").cast("double")) * 100).alias(p)
        for p in [*PRODUCTS, "other"]])
