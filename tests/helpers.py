"""Small builders of staging tables, shared by the test modules."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from marketlens.sources.staging import CUSTOMERS, MARKETING_SPEND, ORDERS


def d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def money(x) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.01"))


def make_customers(spark, rows):
    return spark.createDataFrame([(i, ch, d(sd)) for i, ch, sd in rows], CUSTOMERS)


def make_orders(spark, rows):
    return spark.createDataFrame([(oid, cid, d(od), money(amt)) for oid, cid, od, amt in rows], ORDERS)


def make_spend(spark, rows):
    return spark.createDataFrame([(ch, d(m), money(s), leads) for ch, m, s, leads in rows], MARKETING_SPEND)
