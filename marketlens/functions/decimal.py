"""Exact decimal arithmetic as Column expressions.

PostgreSQL ``ROUND(numeric, n)`` is exact and rounds half away from zero. A
plain Spark ``round(a / b, n)`` first rounds the quotient to the division's
result scale (6..22 digits depending on operand precision) and then to ``n``
digits; with large divisors (millions of orders in one group) that double
rounding can move a tie. ``round_div`` rounds the exact rational value with
integer arithmetic on DECIMAL(38,0) instead: ``(2|P| + |Q|) div (2|Q|)``, sign
applied afterwards. Everything stays JVM-side and inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

_INT38 = DecimalType(38, 0)


def _whole(c: Column, scale: int, shift: int) -> Column:
    """``c * 10^shift`` as DECIMAL(38,0); exact when c has scale <= ``scale``."""
    return (c.cast(DecimalType(38, scale)) * F.lit(10 ** shift)
            .cast(DecimalType(len(str(10 ** shift)), 0))).cast(_INT38)


def _floor_div38(a: Column, b: Column) -> Column:
    """floor(a / b) for whole, non-negative DECIMAL(38,0) values, exactly.

    ``a - a % b`` is a multiple of ``b``, so the decimal division is exact
    (``div`` would be, but it returns LONG and wraps beyond 2^63).
    """
    a38, b38 = a.cast(_INT38), b.cast(_INT38)
    return ((a38 - a38 % b38) / b38).cast(_INT38)


def int_div(a: Column, b: Column) -> Column:
    """Spark's integral division ``a div b`` (truncates toward zero), LONG."""
    return F.call_function("div", a, b)


def _to_decimal(units: Column, digits: int, precision: int) -> Column:
    """Whole units of 10^-digits as DECIMAL(precision, digits)."""
    unit = F.lit(f"{10 ** -digits:.{digits}f}" if digits else "1").cast(
        DecimalType(digits + 1, digits))
    return (units.cast(_INT38) * unit).cast(DecimalType(precision, digits))


_LONG_SAFE = 2 ** 61  # 2|P| + |Q| stays below 2^63 when both are under this


def round_div(num: Column, den: Column, digits: int, scale: int = 2,
              precision: int = 38) -> Column:
    """Exact ``ROUND(num / NULLIF(den, 0), digits)``, half away from zero.

    ``scale`` must be at least the decimal scale of both operands (integers
    have scale 0) so that ``num * 10^scale`` and ``den * 10^scale`` are whole.
    Returns DECIMAL(precision, digits); NULL when ``den`` is 0 or NULL.

    Values that fit are rounded in LONG arithmetic (overflow-checked with
    ``try_*``); anything larger falls back to DECIMAL(38,0), so the result
    is exact either way and the common case avoids BigDecimal work per row.
    """
    p_long = F.try_multiply(num, F.lit(10 ** (digits + scale))).try_cast("long")
    q_long = F.try_multiply(den, F.lit(10 ** scale)).try_cast("long")
    fits = ((F.abs(p_long) < _LONG_SAFE) & (F.abs(q_long) < _LONG_SAFE))
    fast_mag = int_div(F.abs(p_long) * 2 + F.abs(q_long), F.abs(q_long) * 2)
    fast = F.when(fits, F.when((p_long < 0) != (q_long < 0), -fast_mag).otherwise(fast_mag))

    p = _whole(num, scale, digits + scale)
    q = F.nullif(_whole(den, scale, scale), F.lit(0).cast(_INT38))
    magnitude = _floor_div38(F.abs(p) * 2 + F.abs(q), F.abs(q) * 2)
    exact = F.when((p < 0) != (q < 0), -magnitude).otherwise(magnitude)

    units = F.coalesce(fast.cast(_INT38), exact.cast(_INT38))
    return F.when(den.isNull() | (den == 0), F.lit(None)).otherwise(
        _to_decimal(units, digits, precision))


def round_div_sql(num: str, den: str, digits: int, scale: int = 2) -> str:
    """The same exact rounding as DuckDB SQL text (DECIMAL(38, digits))."""
    p = f"CAST(CAST({num} AS DECIMAL(38,{scale})) * {10 ** (digits + scale)} AS HUGEINT)"
    q = f"NULLIF(CAST(CAST({den} AS DECIMAL(38,{scale})) * {10 ** scale} AS HUGEINT), 0)"
    mag = f"((2 * ABS({p}) + ABS({q})) // (2 * ABS({q})))"
    signed = f"(CASE WHEN ({p} < 0) <> ({q} < 0) THEN -{mag} ELSE {mag} END)"
    unit = f"CAST({10 ** -digits:.{digits}f} AS DECIMAL({digits + 1},{digits}))" if digits else "1"
    return f"(CAST({signed} AS DECIMAL(38,0)) * {unit})"


def round_half_even_2(x: Column) -> Column:
    """pandas/numpy ``.round(2)`` on a DOUBLE: half-to-even on ``x * 100``."""
    return F.rint(x * 100) / 100


def round_half_even_2_sql(x: str) -> str:
    return f"(round_even(({x}) * 100, 0) / 100)"
