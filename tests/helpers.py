"""Exact comparison of Spark results with DuckDB results, and hand-made role tables."""
from __future__ import annotations

import math
from datetime import date

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan") if math.isnan(v) else (2, repr(v))
    if hasattr(v, "isoformat"):
        return (3, v.isoformat())
    return (4, str(v))


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return df.columns, [tuple(r) for r in df.collect()]


def roles_from_rows(spark, territories, reps, doctors, visits, prescriptions):
    """Roles from lists of tuples in the reference column order."""
    from callwise.sources.files import SCHEMAS
    from callwise.sources.roles import Roles

    def mk(name, rows):
        return spark.createDataFrame(rows, SCHEMAS[name])
    return Roles(mk("territories", territories), mk("reps", reps), mk("doctors", doctors),
                 mk("visits", visits), mk("prescriptions", prescriptions))


def visit(i, rep, doc, month, product, duration=10, samples=1):
    d = date(2024, month, 1)
    return (f"V{i:06d}", rep, doc, d, month, (month - 1) // 3 + 1, product, duration, samples)


def rx(doc, terr, product, month, units, price, visit_count=1):
    return (f"P-{doc}-{product}-{month}", doc, terr, product, month, (month - 1) // 3 + 1, units,
            units * price, visit_count)
