"""Intake of the role tables from CSV files, some of whose lines are broken on purpose."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwise.sources.files import write_roles
from callwise.sources.intake import ROLE_FILES, intake
from callwise.sources.roles import Roles

# what is added up of each table's good rows
AMOUNT = {"territories": "market_potential", "reps": "target_calls", "doctors": "potential_score",
          "visits": "duration_min", "prescriptions": "revenue"}
BROKEN_EVERY, BROKEN_AT = 50, 7     # visits to these doctors arrive in files of their own


def write_sources(r: Roles, folder: str) -> None:
    """The five tables as CSV. Visits to every fiftieth doctor come in files with the columns
    the other way round: those of even duration with a date that does not exist, and of the
    others, those without samples with a comma too many."""
    apart = F.col("doctor_id") % BROKEN_EVERY == BROKEN_AT
    even = F.col("duration_min") % 2 == 0
    write_roles(Roles(r.territories, r.reps, r.doctors, r.visits.where(~apart), r.prescriptions), folder, fmt="csv")
    columns = r.visits.columns[::-1]
    some = r.visits.where(apart).withColumn("visit_date", F.col("visit_date").cast("string"))
    comma = some.where(~even & (F.col("samples_left") == 0)).withColumn("product", F.concat("product", F.lit(",")))
    rest = (some.where(even | (F.col("samples_left") != 0))
            .withColumn("visit_date", F.when(even, "2024-13-40").otherwise(F.col("visit_date"))))
    for part, quote in ((rest, '"'), (comma, "")):
        part.select(*columns).write.mode("append").option("header", True).option("quote", quote).csv(f"{folder}/visits.csv")


def csv_intake(r: Roles) -> DataFrame:
    """Rows of each table by what became of them: ``good`` with a sum over their amounts, or
    the reason of the quarantine."""
    from callwise.session import new_output_path
    spark = r.visits.sparkSession
    folder = new_output_path(spark, "intake-sources")
    write_sources(r, folder)
    got = intake(spark, folder)
    good = [df.agg(F.lit(name).alias("table_name"), F.lit("good").alias("outcome"), F.count(F.lit(1)).alias("n_rows"),
                   F.sum(AMOUNT[name]).cast("bigint").alias("amount")) for name, df in ((n, got.tables[n]) for n in ROLE_FILES)]
    bad = (got.quarantine.groupBy("table_name", F.col("reason").alias("outcome"))
           .agg(F.count(F.lit(1)).alias("n_rows"), F.lit(None).cast("bigint").alias("amount")))
    return reduce(DataFrame.unionByName, [*good, bad])
