"""Summary tables behind the dashboard: written once, read by every slicer.

``reach``: visits per territory of the rep, with the doctors seen as bitmaps. Its size goes
with territories and doctors, not with visits, and unique doctors under any region are an OR.

``sales``: prescriptions per territory, product and month, partitioned by quarter. Every
visual of the first page is a grouping of it (``sales_cube``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwise.operators.bitmaps import BUCKET, bucket_of, key_bitmap, numbered
from callwise.operators.fanout import pairs_of
from callwise.sources.roles import Roles, load_roles

SLICERS = ["region", "product", "quarter"]
# visuals of the page: what each groups by besides the slicers that are set
VISUALS = {"card": [], "line": ["month"], "donut": ["product"], "bar": ["quarter", "product"]}


@dataclass
class Summaries:
    reach: DataFrame
    sales: DataFrame


def doctor_numbers(r: Roles) -> DataFrame:
    """(doctor_id, prescribing_potential, number) of every doctor that is known or visited.
    Doctors of one territory have numbers side by side, so a rep's doctors fill few buckets."""
    known = r.doctors.select("doctor_id", "territory_id", "prescribing_potential")
    seen = pairs_of(r).select("doctor_id").where("doctor_id IS NOT NULL").distinct()
    both = seen.join(known, "doctor_id", "left")
    return numbered(both, ["territory_id", "doctor_id"]).select("doctor_id", "prescribing_potential", "number")


def reach(r: Roles) -> DataFrame:
    """(territory_id, region, bucket, doctors, n_v, n_high, n_low): visits by reps of a territory."""
    place = r.reps.select("rep_id", "territory_id").join(r.territories.select("territory_id", "region"), "territory_id", "left")
    potential = F.col("prescribing_potential")
    cells = pairs_of(r).join(doctor_numbers(r), "doctor_id", "left").join(place, "rep_id", "left")
    return (cells.groupBy("territory_id", "region", bucket_of("number").alias(BUCKET))
            .agg(key_bitmap("number").alias("doctors"), F.sum("n_v").alias("n_v"),
                 F.sum(F.when(potential == "High", F.col("n_v")).otherwise(0)).alias("n_high"),
                 F.sum(F.when(potential == "Low", F.col("n_v")).otherwise(0)).alias("n_low")))


def sales(r: Roles) -> DataFrame:
    """(territory_id, region, product, quarter, month, revenue, units, n_rx)."""
    per = (r.prescriptions.groupBy("territory_id", "product", "quarter", "month")
           .agg(F.sum("revenue").alias("revenue"), F.sum("units_prescribed").alias("units"), F.count(F.lit(1)).alias("n_rx")))
    return (per.join(r.territories.select("territory_id", "region"), "territory_id", "left")
            .select("territory_id", "region", "product", "quarter", "month", "revenue", "units", "n_rx"))


def sliced(s: DataFrame, region=None, product=None, quarter=None) -> DataFrame:
    for column, value in (("region", region), ("product", product), ("quarter", quarter)):
        if value is not None:
            s = s.where(F.col(column) == value)
    return s


def sales_cube(r: Roles, summary: DataFrame | None = None) -> DataFrame:
    """All visuals of the first page under all slicers, in one pass: every grouping of
    region, product, quarter and month, told apart by ``gid`` (a bit is set where the
    column stands for all its values)."""
    summary = summary if summary is not None else sales(r)
    columns = [*SLICERS, "month"]
    # territories go first: their number does not multiply into the groupings
    base = summary.groupBy(*columns).agg(F.sum("revenue").alias("revenue"), F.sum("units").alias("units"), F.sum("n_rx").alias("n_rx"))
    keys = [F.col(c) for c in columns]
    sets = [[k for i, k in enumerate(keys) if bits >> i & 1] for bits in range(1 << len(keys))]
    return (base.groupingSets(sets, *keys)
            .agg(F.grouping_id().cast("int").alias("gid"), F.sum("revenue").cast("bigint").alias("total_revenue"),
                 F.sum("units").cast("bigint").alias("total_units"), F.sum("n_rx").cast("bigint").alias("n_prescriptions"))
            .select("gid", *columns, "total_revenue", "total_units", "n_prescriptions"))


def visual(cube: DataFrame, name: str, region=None, product=None, quarter=None) -> DataFrame:
    """One visual under slicers, picked from the cube: no aggregation is left to do."""
    values = {"region": region, "product": product, "quarter": quarter}
    columns = [*SLICERS, "month"]
    grouped = {c for c in columns if values.get(c) is not None} | set(VISUALS[name])
    gid = sum(0 if c in grouped else 1 << (len(columns) - 1 - i) for i, c in enumerate(columns))
    out = cube.where(F.col("gid") == gid)
    for c, v in values.items():
        if v is not None:
            out = out.where(F.col(c) == v)
    return out.select(*VISUALS[name], "total_revenue", "total_units", "n_prescriptions")


def monthly_revenue(r: Roles, region=None, product=None, quarter=None, summary: DataFrame | None = None) -> DataFrame:
    """The monthly line under slicers."""
    return visual(sales_cube(r, summary), "line", region, product, quarter).select("month", "total_revenue").orderBy("month")


_CACHE: dict[tuple[str, str], Summaries] = {}


def load_summaries(spark: SparkSession, sf_dir: str) -> Summaries:
    """Both summaries of an input folder, written once per session to the shared folder."""
    from callwise.session import new_output_path, session_key
    key = (session_key(spark), sf_dir)
    if key not in _CACHE:
        r = load_roles(spark, sf_dir)
        base = new_output_path(spark, "summaries")
        made = {"reach": reach(r), "sales": sales(r)}
        made["reach"].write.parquet(f"{base}/reach")
        made["sales"].write.partitionBy("quarter").parquet(f"{base}/sales")
        _CACHE[key] = Summaries(**{n: spark.read.parquet(f"{base}/{n}").select(*df.columns) for n, df in made.items()})
    return _CACHE[key]
