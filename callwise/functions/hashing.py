"""Reproducible per-row uniform draws from keys of any type.

``rand()`` depends on partitioning and task order; a draw used in a published
number must repeat, and must be checkable by another engine. The draw here is the
first 52 bits of the MD5 digest of the stream number and the row's keys as text, so
draws of different keys or streams are independent for all practical purposes, and
a draw divided by ``MODULUS`` is exact in a double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 13
MODULUS = 16 ** HEX_DIGITS


def hash_sql(keys: list[str], stream: int) -> str:
    """Spark SQL for an integer uniform on [0, MODULUS)."""
    parts = "".join(f", CAST({k} AS STRING)" for k in keys)
    return f"CAST(conv(substr(md5(concat_ws('|', '{stream}'{parts})), 1, {HEX_DIGITS}), 16, 10) AS BIGINT)"


def hash_uniform_int(keys: list[str], stream: int) -> Column:
    return F.expr(hash_sql(keys, stream))
