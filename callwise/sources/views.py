"""Expose the role tables to ``spark.sql`` under their model names.

With the views registered, analysts' own SQL over territories / reps / doctors /
visits / prescriptions runs on Spark unchanged (Catalyst plans it like the
DataFrame versions; the written facts keep their pruning and pushdown).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from callwise.sources.roles import Roles


def register_role_views(spark: SparkSession, roles: Roles, prefix: str = "") -> list[str]:
    names = []
    for name, df in roles.as_dict().items():
        df.createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names
