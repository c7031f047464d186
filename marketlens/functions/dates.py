"""Calendar helpers as Column expressions (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(d: Column) -> Column:
    """``DATE_TRUNC('month', d)::date`` / ``toStartOfMonth``: a DATE, not a TIMESTAMP."""
    return F.trunc(d, "MM")


def month_index(d: Column) -> Column:
    """Months since year 0; differences give calendar-month offsets that
    ignore the day of month (``(y2-y1)*12 + (m2-m1)``)."""
    return F.year(d) * 12 + F.month(d)


def month_offset(later: Column, earlier: Column) -> Column:
    return (month_index(later) - month_index(earlier)).cast("int")


def yyyymm(d: Column) -> Column:
    """``toYYYYMM(d)``."""
    return (F.year(d) * 100 + F.month(d)).cast("int")


def days_between(later: Column, earlier: Column) -> Column:
    """``(later - earlier).days`` for DATE columns."""
    return F.datediff(later, earlier)
