"""Exact rounding and division for integer counts and money.

Float ``round`` on ratios is engine dependent near ties (2.175 is stored as
2.17499...). Every rounded ratio here is computed in integer arithmetic, so the
result is the exact decimal half-away-from-zero value, identical on any engine:

    round(scale * n / d, p) = sign * ((2 * scale * 10^p * |n| + |d|) div (2 * |d|)) / 10^p

The intermediate is carried as DECIMAL(38, 0) so that revenue-sized numerators
cannot overflow a BIGINT on large inputs; ``div`` truncates, which is floor for
the non-negative operands used. ``d = 0`` or NULL gives NULL (SQL ``NULLIF``
semantics); wrap in ``coalesce(.., 0)`` for the DAX ``DIVIDE(a, b, 0)`` form.

Arguments are SQL expressions over column names (a bare column name is the
common case), so the same helpers serve the DataFrame API and ``spark.sql``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up_units_sql(num: str, den: str, scale: int = 1, digits: int = 0) -> str:
    """SQL for the integer k with k / 10^digits = round_half_up(scale * num / den, digits)."""
    n = f"CAST(({num}) AS DECIMAL(38,0))"
    d = f"CAST(({den}) AS DECIMAL(38,0))"
    factor = 2 * scale * 10 ** digits
    mag = f"(CAST({factor} AS DECIMAL(38,0)) * abs({n}) + abs({d}))"
    k = f"CAST(({mag} div (2 * abs({d}))) AS BIGINT)"
    sign = f"(CASE WHEN ({n} < 0) <> ({d} < 0) THEN -1 ELSE 1 END)"
    return f"(CASE WHEN {d} = 0 THEN CAST(NULL AS BIGINT) ELSE {k} * {sign} END)"


def half_up_units(num: str, den: str, scale: int = 1, digits: int = 0) -> Column:
    return F.expr(half_up_units_sql(num, den, scale, digits))


def ratio_round_sql(num: str, den: str, scale: int = 1, digits: int = 1) -> str:
    return f"(CAST({half_up_units_sql(num, den, scale, digits)} AS DOUBLE) / {float(10 ** digits)!r})"


def ratio_round(num: str, den: str, scale: int = 1, digits: int = 1) -> Column:
    """round_half_up(scale * num / den, digits) as DOUBLE; NULL when den is 0."""
    return F.expr(ratio_round_sql(num, den, scale, digits))


def safe_ratio(num, den) -> Column:
    """num / den as DOUBLE, NULL when den is 0 (SQL NULLIF form)."""
    n = num if isinstance(num, Column) else F.col(num)
    d = den if isinstance(den, Column) else F.col(den)
    return F.try_divide(n.cast("double"), d.cast("double"))


def divide_or_zero(num, den) -> Column:
    """DAX DIVIDE(num, den, 0): the alternate result 0 replaces a zero or blank denominator."""
    return F.coalesce(safe_ratio(num, den), F.lit(0.0))


def score_x100_sql(high: str = "High", medium: str = "Medium", low: str = "Low") -> str:
    """Weighted call score (wH H + wM M + wL L) / T, half-up to 2 dp, times 100.

    With the weights doubled to integers (3, 1.5, 0.5 -> 6, 3, 1) this is
    ((100 * (6H + 3M + L) + T) div (2T)); NULL when T = 0.
    """
    from callwise.functions.labels import SCORE_WEIGHTS_X2 as w
    return half_up_units_sql(f"{w['High']} * {high} + {w['Medium']} * {medium} + {w['Low']} * {low}",
                             f"2 * ({high} + {medium} + {low})", 1, 2)


def score_x100(high: str = "High", medium: str = "Medium", low: str = "Low") -> Column:
    return F.expr(score_x100_sql(high, medium, low))
