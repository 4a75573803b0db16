"""Top-k, medians and shares of a group total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """First k rows by ``order``; callers end ``order`` with a unique key so ties at the cut
    are decided the same way on every run. Plans as TakeOrderedAndProject: each task keeps
    its own k best rows, so only k rows per task reach the final merge."""
    return df.orderBy(*order).limit(k)


def global_median(df: DataFrame, col: str) -> Column:
    """Exact interpolated median of ``col`` over all of ``df`` as a scalar-subquery column.

    The percentile buffer holds one entry per *distinct* value, so use it on bounded
    domains (integer scores, one value per territory or cluster)."""
    return df.agg(F.median(col)).scalar()


def share_of_group(value: str, group: list[str]) -> Column:
    """SUM(value) OVER (PARTITION BY group): the group total next to each (aggregated) row."""
    return F.sum(value).over(Window.partitionBy(*group))


SPLITS = 4096       # counts that the driver gets a round


def exact_median(df: DataFrame, col: str) -> float | None:
    """Median of a numeric column of any domain (nulls are passed over), as the mean of the
    two middle values; None without values.

    Selection by counting: the range that holds the middle is cut into ``SPLITS`` pieces, the
    rows of each are counted, and the piece with the middle is cut again until both
    middle values are known. A round is one aggregate that returns ``SPLITS`` rows at
    most, so no task and not the driver ever holds the distinct values, as a percentile
    buffer does. Numbers must be finite."""
    kind = dict(df.dtypes)[col]
    # distances within a range are exact, and rounding them keeps their order
    exact = "double" if kind in ("double", "float") else "decimal(38,0)" if kind in ("tinyint", "smallint", "int", "bigint") else kind
    values = df.select(F.col(col).cast(exact).alias("x")).where("x IS NOT NULL")
    n, low, high = values.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if not n:
        return None
    wanted = [(n - 1) // 2, n // 2]          # places of the middle values, from 0
    before = 0                               # values below the range
    while low != high:
        x, lo, span = F.col("x"), F.lit(low).cast(exact), F.lit(float(high - low))
        piece = F.least(F.floor((x - lo).cast("double") / span * SPLITS), F.lit(SPLITS - 1)).cast("int")
        rows = (values.where((x >= lo) & (x <= F.lit(high).cast(exact))).groupBy(piece.alias("p"))
                .agg(F.count("x").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).collect())
        rows.sort(key=lambda r: r.p)
        ends = []
        at = before
        for r in rows:
            if any(at <= w < at + r.n for w in wanted):
                ends.append((at, r))
            at += r.n
        if len(ends) == 2:                   # the middle lies between two pieces
            return (float(ends[0][1].b) + float(ends[1][1].a)) / 2
        before, r = ends[0]
        low, high = r.a, r.b
    return float(low)
