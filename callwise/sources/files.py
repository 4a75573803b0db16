"""Typed schemas, CSV / parquet role loaders and sinks.

The reference model is five CSV files plus two derived ones. Reading them with
an explicit ``StructType`` (never ``inferSchema``, which costs a full extra pass
over every file) gives stable types on any input size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from callwise.sources.roles import Roles

_S, _I, _L, _D, _DT = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.DateType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SCHEMAS: dict[str, T.StructType] = {
    "territories": _schema(("territory_id", _S), ("territory_name", _S), ("state", _S),
                           ("region", _S), ("market_potential", _L)),
    "reps": _schema(("rep_id", _S), ("rep_name", _S), ("territory_id", _S),
                    ("experience_yrs", _I), ("target_calls", _I)),
    "doctors": _schema(("doctor_id", _S), ("doctor_name", _S), ("specialty", _S),
                       ("territory_id", _S), ("prescribing_potential", _S),
                       ("potential_score", _I), ("years_in_practice", _I)),
    "visits": _schema(("visit_id", _S), ("rep_id", _S), ("doctor_id", _S), ("visit_date", _DT),
                      ("month", _I), ("quarter", _I), ("product", _S), ("duration_min", _I),
                      ("samples_left", _I)),
    "prescriptions": _schema(("prescription_id", _S), ("doctor_id", _S), ("territory_id", _S),
                             ("product", _S), ("month", _I), ("quarter", _I),
                             ("units_prescribed", _I), ("revenue", _L), ("visit_count", _I)),
    "rep_performance": _schema(("rep_id", _S), ("High", _L), ("Low", _L), ("Medium", _L),
                               ("total_calls", _L), ("efficiency_score", _D), ("high_pct", _D),
                               ("low_pct", _D), ("rep_name", _S), ("target_calls", _I),
                               ("experience_yrs", _I), ("total_revenue", _L),
                               ("call_achievement_pct", _D), ("revenue_per_call", _D)),
    "doctor_segments": _schema(("doctor_id", _S), ("potential_score", _I), ("years_in_practice", _I),
                               ("total_visits", _L), ("unique_products", _L), ("avg_duration", _D),
                               ("samples_received", _L), ("total_revenue", _L), ("total_units", _L),
                               ("months_active", _L), ("cluster", _I), ("segment", _S)),
}


def read_csv_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the seven model files (five roles + rep_performance + doctor_segments).
    Columns are taken by the names in the header, in any order; others are left out and a
    missing one is an error, as is a value that its type cannot hold."""
    raw = (spark.read.option("header", True).option("mode", "FAILFAST")
           .csv(f"{folder.rstrip('/')}/{name}.csv"))
    schema = SCHEMAS[name]
    missing = [f.name for f in schema if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{name}.csv has no column {', '.join(missing)}")
    return raw.select(*[raw[f"`{f.name}`"].cast(f.dataType).alias(f.name) for f in schema])


def read_csv_roles(spark: SparkSession, folder: str) -> Roles:
    """Load ``territories.csv`` .. ``prescriptions.csv`` (header row, typed)."""
    def rd(name: str) -> DataFrame:
        return read_csv_table(spark, folder, name)
    return Roles(rd("territories"), rd("reps"), rd("doctors"), rd("visits"), rd("prescriptions"))


def write_roles(roles: Roles, folder: str, fmt: str = "parquet") -> None:
    """Write the five roles; facts partitioned by quarter so quarter filters prune files."""
    for name, df in roles.as_dict().items():
        w = df.write.mode("overwrite")
        if name in ("visits", "prescriptions") and "quarter" in df.columns and fmt == "parquet":
            w = w.partitionBy("quarter")
        if fmt == "csv":
            w.option("header", True).csv(f"{folder.rstrip('/')}/{name}.csv")
        else:
            w.parquet(f"{folder.rstrip('/')}/{name}")


def round_trip_csv(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as CSV (header) to a fresh folder under the shared folder and read it
    back with the same schema: the sink / source pair of the derived outputs."""
    from callwise.session import new_output_path
    spark = df.sparkSession
    path = new_output_path(spark, f"csv-{name}")
    df.write.mode("overwrite").option("header", True).csv(path)
    return spark.read.option("header", True).option("mode", "FAILFAST").schema(df.schema).csv(path)
