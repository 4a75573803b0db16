"""Every query with an oracle matches DuckDB exactly (rows, names, values) at sf0.001."""
import pytest

import __spark_entry__ as entry
from helpers import canon, duck, spark_rows

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(smoke_dir):
    return duck(smoke_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, smoke_dir, con, name):
    cols, rows = spark_rows(QUERIES[name](spark, smoke_dir))
    cur = con.execute(SQL[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(dcols)
    assert canon(cols, rows) == canon(dcols, cur.fetchall())


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "rep_id" in df.columns
