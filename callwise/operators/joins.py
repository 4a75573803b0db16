"""Join helpers: size-checked broadcast and explicit anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A broadcast side is copied to every executor; keep it far below executor memory.
DEFAULT_BROADCAST_ROWS = 1_000_000


def rows_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows (stops reading after max_rows + 1)."""
    return df.limit(max_rows + 1).count() <= max_rows


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only behind a measured row bound; otherwise leave the choice to AQE,
    which converts to a broadcast at run time from real shuffle sizes when that is safe."""
    return F.broadcast(df) if rows_at_most(df, max_rows) else df


def anti_join(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Rows of ``left`` with no partner in ``right``: the LEFT JOIN .. IS NULL idiom,
    written as a LeftAnti join (Catalyst does not rewrite the former). The right side is
    reduced to its distinct keys first, so duplicates never cross the shuffle."""
    keys = [on] if isinstance(on, str) else list(on)
    return left.join(right.select(*keys).dropDuplicates(), keys, "left_anti")
