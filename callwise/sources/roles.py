"""Role loaders: the five tables of the field-force model.

The analyses read five roles (territories, reps, doctors, visits,
prescriptions). They come either from reference-shaped CSV/parquet files
(``sources.files``) or, for the driver's TPC-H style tables, from the mapping
below. Every loader reads only the columns it needs, so the parquet scans carry
a pruned ``ReadSchema`` and the status / returnflag predicates reach the scan
as ``PushedFilters``.

Mapping onto the driver tables
------------------------------
territories   nation JOIN region, one per nation
reps          supplier
doctors       customer (c_mktsegment as specialty, c_acctbal bands as potential)
visits        orders JOIN lineitem with o_orderstatus = 'F', one per (order, supplier)
prescriptions orders JOIN lineitem with l_returnflag = 'R', one per
              (customer, product, month), kept where the cell also has visits
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwise.functions.labels import price_of, product_of_mod3

# fixed parameters of the role mapping
HIGH_ACCTBAL = 7800
LOW_ACCTBAL = 2300


@dataclass
class Roles:
    territories: DataFrame
    reps: DataFrame
    doctors: DataFrame
    visits: DataFrame
    prescriptions: DataFrame
    # optional summary table: visits per (rep, doctor, product, month), written once
    # with the facts; plans fall back to aggregating ``visits`` when it is absent
    cells: DataFrame | None = None
    # whether visit_id is known to be a key, so that no visit row can be a repeat
    unique_visits: bool = False

    def as_dict(self) -> dict[str, DataFrame]:
        return {"territories": self.territories, "reps": self.reps, "doctors": self.doctors,
                "visits": self.visits, "prescriptions": self.prescriptions}


def _read(spark: SparkSession, sf_dir: str, name: str, cols: list[str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*cols)


def territories_from_tpch(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _read(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    region = _read(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    from callwise.operators.joins import bounded_broadcast
    region = bounded_broadcast(region, 100_000)
    return (nation.join(region, nation.n_regionkey == region.r_regionkey)
            .select(F.col("n_nationkey").alias("territory_id"),
                    F.concat(F.lit("Zone "), F.col("n_name")).alias("territory_name"),
                    F.col("n_name").alias("state"),
                    F.col("r_name").alias("region"),
                    (F.lit(500000) + F.col("n_nationkey") * 60000).cast("bigint")
                    .alias("market_potential")))


def reps_from_tpch(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier", ["s_suppkey", "s_name", "s_nationkey"])
    return s.select(F.col("s_suppkey").alias("rep_id"),
                    F.col("s_name").alias("rep_name"),
                    F.col("s_nationkey").alias("territory_id"),
                    (F.lit(1) + F.col("s_suppkey") % 11).cast("int").alias("experience_yrs"),
                    (F.lit(200) + F.col("s_suppkey") % 120).cast("int").alias("target_calls"))


def doctors_from_tpch(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer",
              ["c_custkey", "c_name", "c_mktsegment", "c_nationkey", "c_acctbal"])
    high = F.col("c_acctbal") >= HIGH_ACCTBAL
    low = F.col("c_acctbal") < LOW_ACCTBAL
    key = F.col("c_custkey")
    return c.select(
        key.alias("doctor_id"),
        F.col("c_name").alias("doctor_name"),
        F.col("c_mktsegment").alias("specialty"),
        F.col("c_nationkey").alias("territory_id"),
        F.when(high, "High").when(low, "Low").otherwise("Medium").alias("prescribing_potential"),
        F.when(high, 80 + key % 20).when(low, 10 + key % 29).otherwise(40 + key % 39)
        .cast("int").alias("potential_score"),
        (F.lit(2) + key % 28).cast("int").alias("years_in_practice"))


def visits_from_tpch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One visit per (order, supplier) of a finished order.

    The join and the grouping share the key ``o_orderkey``: the aggregate reuses
    the join's hash partitioning, so lineitem is shuffled once.
    """
    o = (_read(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"])
         .filter(F.col("o_orderstatus") == "F").drop("o_orderstatus"))
    li = _read(spark, sf_dir, "lineitem",
               ["l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_quantity"])
    g = (o.join(li, o.o_orderkey == li.l_orderkey)
         .groupBy("o_orderkey", "l_suppkey", "o_custkey", "o_orderdate")
         .agg(F.min("l_partkey").alias("min_part"),
              F.sum("l_quantity").alias("qty"),
              F.min("l_linenumber").alias("min_line")))
    return g.select(
        F.concat(F.lit("V"), F.col("o_orderkey").cast("string"), F.lit("-"),
                 F.col("l_suppkey").cast("string")).alias("visit_id"),
        F.col("l_suppkey").alias("rep_id"),
        F.col("o_custkey").alias("doctor_id"),
        F.col("o_orderdate").cast("date").alias("visit_date"),
        F.month("o_orderdate").cast("int").alias("month"),
        F.quarter("o_orderdate").cast("int").alias("quarter"),
        product_of_mod3("min_part").alias("product"),
        (F.lit(5) + F.col("qty").cast("bigint") % 20).cast("int").alias("duration_min"),
        (F.col("min_line") % 5).cast("int").alias("samples_left"))


def prescription_cells_from_tpch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned units per (customer, product, month): the candidate prescription cells."""
    o = _read(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    li = (_read(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_quantity", "l_returnflag"])
          .filter(F.col("l_returnflag") == "R").drop("l_returnflag"))
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .select(F.col("o_custkey").alias("doctor_id"),
                    product_of_mod3("l_partkey").alias("product"),
                    F.month("o_orderdate").cast("int").alias("month"),
                    "l_quantity")
            .groupBy("doctor_id", "product", "month")
            .agg(F.sum("l_quantity").cast("int").alias("units")))


def prescriptions_from_cells(cells: DataFrame, visits: DataFrame, doctors: DataFrame) -> DataFrame:
    vc = (visits.groupBy("doctor_id", "product", "month")
          .agg(F.count(F.lit(1)).cast("int").alias("visit_count")))
    d = doctors.select("doctor_id", "territory_id")
    rx = cells.join(vc, ["doctor_id", "product", "month"]).join(d, "doctor_id")
    price = price_of("product")
    return rx.select(
        F.concat(F.lit("P"), F.col("doctor_id").cast("string"), F.lit("-"), F.col("product"),
                 F.lit("-"), F.col("month").cast("string")).alias("prescription_id"),
        "doctor_id", "territory_id", "product", "month",
        F.expr("CAST((month + 2 - (month + 2) % 3) / 3 AS INT)").alias("quarter"),
        F.col("units").alias("units_prescribed"),
        (F.col("units").cast("bigint") * price).cast("bigint").alias("revenue"),
        "visit_count")


def roles_from_tpch(spark: SparkSession, sf_dir: str) -> Roles:
    territories = territories_from_tpch(spark, sf_dir)
    reps = reps_from_tpch(spark, sf_dir)
    doctors = doctors_from_tpch(spark, sf_dir)
    visits = visits_from_tpch(spark, sf_dir)
    rx = prescriptions_from_cells(prescription_cells_from_tpch(spark, sf_dir), visits, doctors)
    return Roles(territories, reps, doctors, visits, rx)


# ---------------------------------------------------------------------------
# Materialisation: build the two fact roles once per session and input folder,
# write them as parquet to the shared folder and read them back. The written
# copy cuts lineage (a lost executor re-reads files instead of re-running the
# lineitem joins) and keeps column pruning and filter pushdown for every KPI.
# Facts are partitioned by quarter so quarter slicers prune files.
# ---------------------------------------------------------------------------
_CACHE: dict[tuple[str, str], Roles] = {}
_PATHS: dict[tuple[str, str], str] = {}


def _session_key(spark: SparkSession) -> str:
    from callwise.session import session_key
    return session_key(spark)


# A dimension is broadcast to its joins only when its row count is checked below this.
DIMENSION_BROADCAST_ROWS = 250_000  # about 25 MB for the widest dimension


def sized_dimension(df: DataFrame, max_rows: int = DIMENSION_BROADCAST_ROWS) -> DataFrame:
    """Attach a broadcast hint to a dimension whose measured row count is at most
    ``max_rows`` (one small counting job, stopped after max_rows + 1 rows). Larger
    dimensions stay unhinted and join by shuffle; AQE may still broadcast them from
    measured shuffle sizes."""
    from callwise.operators.joins import bounded_broadcast
    return bounded_broadcast(df, max_rows)


ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 100_000       # Spark's own limit


def bucket_count(visits: DataFrame) -> int:
    """Buckets of the tables laid out by doctor: from the number of visits, which bounds the
    rows of both (read from the file footers)."""
    return max(8, min(MAX_BUCKETS, visits.count() // ROWS_PER_BUCKET))


@contextmanager
def sized_shuffles(spark: SparkSession, rows: int, per_partition: int = ROWS_PER_BUCKET):
    """Inside, shuffles have at least a partition for so many of ``rows``, so that what a task
    sorts and groups does not grow with the input; AQE still joins the small ones."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(int(before), min(MAX_BUCKETS, -(-rows // per_partition)))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_bucketed(df: DataFrame, path: str, buckets: int, partition_by: str | None = None) -> DataFrame:
    """``df`` as a table bucketed by doctor_id at ``path`` of the shared folder. Every task
    writes one bucket, and joins and groupings that hold doctor_id need no exchange.

    Only pre-aggregated tables are laid out like this: one doctor has at most a row per rep,
    product and month in them. Visits stay as they are, as a bucket is read by one task and a
    doctor with a third of all visits would fill one."""
    import uuid
    spark = df.sparkSession
    name = f"callwise_{uuid.uuid4().hex}"
    w = df.repartition(buckets, "doctor_id").write.bucketBy(buckets, "doctor_id").option("path", path).format("parquet")
    (w.partitionBy(partition_by) if partition_by else w).saveAsTable(name)
    return spark.table(name).select(*df.columns)


def load_roles(spark: SparkSession, sf_dir: str, materialize: bool = True) -> Roles:
    key = (_session_key(spark), sf_dir)
    if key in _CACHE:
        return _CACHE[key]
    lazy = roles_from_tpch(spark, sf_dir)
    if not materialize:
        return lazy
    from callwise.session import new_output_path
    base = new_output_path(spark, "roles")

    # counted in the file footers; the facts are made of these rows
    with sized_shuffles(spark, _read(spark, sf_dir, "lineitem", []).count()):
        lazy.visits.write.mode("overwrite").partitionBy("quarter").parquet(f"{base}/visits")
        visits = spark.read.parquet(f"{base}/visits").select(*lazy.visits.columns)
        buckets = bucket_count(visits)
        cells = prescription_cells_from_tpch(spark, sf_dir)
        rx = write_bucketed(prescriptions_from_cells(cells, visits, lazy.doctors), f"{base}/prescriptions", buckets, "quarter")
        from callwise.operators.fanout import visit_cells
        cells = write_bucketed(visit_cells(visits), f"{base}/visit_cells", buckets)
    # visit ids are made of the grouping key of the build, so they are unique
    roles = Roles(*[sized_dimension(d) for d in (lazy.territories, lazy.reps, lazy.doctors)],
                  visits, rx, cells, unique_visits=True)
    _CACHE[key] = roles
    _PATHS[key] = base
    return roles


def fact_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Folder of a written fact role (``visits`` or ``prescriptions``)."""
    load_roles(spark, sf_dir)
    return f"{_PATHS[(_session_key(spark), sf_dir)]}/{name}"


def clear_role_cache() -> None:
    _CACHE.clear()


def materialize(spark: SparkSession, roles: Roles) -> Roles:
    """Write any role tables (e.g. parsed from CSV) once as parquet to the shared
    folder, facts partitioned by quarter, plus the visit-cell summary, and read them
    back: every later query then scans columnar files with pruning and pushdown."""
    from callwise.operators.fanout import visit_cells
    from callwise.session import new_output_path
    base = new_output_path(spark, "roles-in")
    out = {}
    for name, df in roles.as_dict().items():
        if name == "prescriptions":
            by = "quarter" if "quarter" in df.columns else None
            out[name] = write_bucketed(df, f"{base}/{name}", bucket_count(out["visits"]), by)
            continue
        w = df.write.mode("overwrite")
        if name == "visits" and "quarter" in df.columns:
            w = w.partitionBy("quarter")
        w.parquet(f"{base}/{name}")
        out[name] = spark.read.parquet(f"{base}/{name}").select(*df.columns)
    cells = write_bucketed(visit_cells(out["visits"]), f"{base}/visit_cells", bucket_count(out["visits"]))
    dims = [sized_dimension(out[n]) for n in ("territories", "reps", "doctors")]
    return Roles(*dims, out["visits"], out["prescriptions"], cells)
