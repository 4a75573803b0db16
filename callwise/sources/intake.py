"""CSV intake with a quarantine: a bad line costs that line, not the job.

Every file is bound by the names in its own header, in any order. A line is good if it has as
many fields as its header, a value in every key column, and values that the column types can
hold; any other goes to the quarantine with its file, its text and the reason. A file whose
header lacks a column goes there line by line. The files are parsed once: good and
bad lines are written next to each other to the shared folder and read from there.

Defined cases: an empty field is null; whole numbers may end in ``.0``; a header alone is an
empty table; a table without files is an error; fields over several lines are not supported
(they are too many or too few fields, and quarantined); columns not in the model are left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callwise.sources.files import SCHEMAS
from callwise.sources.roles import Roles

ROLE_FILES = ["territories", "reps", "doctors", "visits", "prescriptions"]
KEYS = {"territories": ["territory_id"], "reps": ["rep_id"], "doctors": ["doctor_id"], "visits": ["visit_id"],
        "prescriptions": ["prescription_id"], "rep_performance": ["rep_id"], "doctor_segments": ["doctor_id"]}
QUARANTINE = "table_name string, file string, reason string, record string"
_RAW, _WHY, _FILE = "_raw", "_reason", "_file"
MOST_HEADERS = 1000      # different headers of one table


@dataclass
class Intake:
    tables: dict[str, DataFrame]     # typed, good rows
    quarantine: DataFrame            # table_name, file, reason, record

    def roles(self) -> Roles:
        return Roles(*[self.tables[n] for n in ROLE_FILES])


def headers(spark: SparkSession, path: str, key: str) -> list[tuple[list[str], list[str]]]:
    """(column names, files) for each header in use at ``path``.

    One file is asked for its first line. Of several, the first lines that hold the key's
    name are gathered in one pass over the text; what comes back is a row for each file."""
    files = sorted(spark.read.text(path).inputFiles())
    if not files:
        raise FileNotFoundError(path)
    if len(files) == 1:
        return [(spark.read.option("header", True).csv(path).columns, files)]
    lines = (spark.read.text(path).where("_metadata.file_block_start = 0")
             .select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("at")))
    first = lines.groupBy("f").agg(F.min_by("value", F.when(F.col("value").contains(key), F.col("at"))).alias("h"))
    used = first.groupBy("h").agg(F.sort_array(F.collect_list("f")).alias("fs")).limit(MOST_HEADERS + 1).collect()
    if len(used) > MOST_HEADERS:
        raise ValueError(f"over {MOST_HEADERS} different headers at {path}")
    # files in which the key is nowhere are quarantined as a whole
    return [([] if r.h is None else spark.read.option("header", True).csv(r.fs[0]).columns, r.fs) for r in used]


def _typed(value: Column, kind: T.DataType) -> Column:
    text = F.trim(value)
    if isinstance(kind, (T.IntegerType, T.LongType)):
        text = F.regexp_replace(text, r"\.0+$", "")
    return value if isinstance(kind, T.StringType) else text.try_cast(kind)


def _parsed(spark: SparkSession, name: str, names: list[str], files: list[str]) -> DataFrame:
    """Lines of files with one header: the model's columns, and file, text and reason."""
    schema = SCHEMAS[name]
    missing = [f.name for f in schema if f.name not in names]
    if missing:
        lines = spark.read.text(files).select(F.col("value").alias(_RAW), F.col("_metadata.file_path").alias(_FILE))
        why = "no column " + ", ".join(missing)
        return lines.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema], _FILE, _RAW, F.lit(why).alias(_WHY))
    as_text = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))] + [T.StructField(_RAW, T.StringType())])
    raw = (spark.read.schema(as_text).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _RAW)
           .csv(files).withColumn(_FILE, F.col("_metadata.file_path")))
    column = {n: F.col(f"c{i}") for i, n in enumerate(names)}
    reasons = [F.when(F.col(_RAW).isNotNull(), F.lit("wrong number of fields"))]
    reasons += [F.when(column[k].isNull() | (F.trim(column[k]) == ""), F.lit(f"no {k}")) for k in KEYS[name]]
    reasons += [F.when(column[f.name].isNotNull() & _typed(column[f.name], f.dataType).isNull(), F.lit(f"bad {f.name}"))
                for f in schema if not isinstance(f.dataType, T.StringType)]
    text = F.coalesce(F.col(_RAW), F.to_csv(F.struct(*[column[n].alias(f"c{i}") for i, n in enumerate(names)])))
    why = F.coalesce(*reasons)
    return raw.select(*[_typed(column[f.name], f.dataType).alias(f.name) for f in schema], _FILE,
                      F.when(why.isNotNull(), text).alias(_RAW), why.alias(_WHY))


def intake(spark: SparkSession, folder: str, names: list[str] | None = None) -> Intake:
    """The tables ``names`` (the five roles) of ``folder``, from ``<name>.csv`` files or
    folders of files."""
    from callwise.session import new_output_path
    base, tables, bad = new_output_path(spark, "intake"), {}, []
    for name in names or ROLE_FILES:
        used = headers(spark, f"{folder.rstrip('/')}/{name}.csv", KEYS[name][0])
        parsed = reduce(DataFrame.unionByName, [_parsed(spark, name, columns, files) for columns, files in used])
        parsed.withColumn("bad", F.col(_WHY).isNotNull()).write.partitionBy("bad").parquet(f"{base}/{name}")
        stored = spark.read.schema(parsed.schema.add("bad", "boolean")).parquet(f"{base}/{name}")
        tables[name] = stored.where(~F.col("bad")).select(*SCHEMAS[name].names)
        bad.append(stored.where("bad").select(F.lit(name).alias("table_name"), F.col(_FILE).alias("file"), F.col(_WHY).alias("reason"), F.col(_RAW).alias("record")))
    return Intake(tables, reduce(DataFrame.unionByName, bad))
