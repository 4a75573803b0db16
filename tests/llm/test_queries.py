"""The registered queries against SQL, and the pipeline's stages."""
import duckdb
import pytest

import corpus_pipeline
from callwise.llm import registry

SMOKE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    want = con.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, SMOKE).toPandas()[list(want.columns)]
    key = list(want.columns)
    assert len(want) and got.sort_values(key).reset_index(drop=True).equals(want.astype(got.dtypes.to_dict()).sort_values(key).reset_index(drop=True))


def test_stages_keep_the_columns_and_the_clean_documents(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMOKE)
        assert after.columns == docs.columns, name
        assert 0 < after.count() <= docs.count(), name
