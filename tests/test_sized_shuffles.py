"""Shuffles of the role build follow the number of line items."""
import pytest

from callwise.sources import roles

KEY = "spark.sql.shuffle.partitions"


def test_partitions_follow_the_rows_inside_only(spark):
    before = int(spark.conf.get(KEY))
    for rows, want in ((0, before), (before * 10, before), (before * 10 + 1, before + 1), (before * 50, before * 5)):
        with roles.sized_shuffles(spark, rows, 10):
            assert int(spark.conf.get(KEY)) == want
        assert int(spark.conf.get(KEY)) == before
    with pytest.raises(ValueError), roles.sized_shuffles(spark, before * 50, 10):
        raise ValueError
    assert int(spark.conf.get(KEY)) == before


def test_roles_are_built_with_them(spark, smoke_dir, monkeypatch):
    seen = []
    real = roles.sized_shuffles
    monkeypatch.setattr(roles, "_CACHE", {})
    monkeypatch.setattr(roles, "sized_shuffles", lambda s, rows: seen.append(rows) or real(s, rows))
    roles.load_roles(spark, smoke_dir)
    assert seen == [spark.read.parquet(f"{smoke_dir}/lineitem.parquet").count()]
