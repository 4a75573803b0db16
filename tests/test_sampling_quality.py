"""Expected probabilities and key checks."""
from pyspark.sql import functions as F

from callwise.operators.quality import fk_report, pk_report
from callwise.plans import sampling
from callwise.sources.roles import load_roles


def test_expected_probabilities(spark, smoke_dir):
    e = sampling.expected_rx_probability(load_roles(spark, smoke_dir))
    assert e.filter((F.col("probability") <= 0) | (F.col("probability") > 1)).count() == 0


def test_pk_and_fk_reports(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    r = pk_report(df, "t", ["k"]).first()
    assert (r.n_rows, r.n_keys, r.n_duplicated_keys, r.n_null_key_rows) == (4, 3, 1, 1)
    parent = spark.createDataFrame([(1,)], "k int")
    f = fk_report(df, "t", "k", parent, "p", "k").first()
    assert (f.orphan_rows, f.orphan_keys) == (1, 1)  # k=2; NULL is not an orphan
