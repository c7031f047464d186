"""C1-C9 (FIXTURES.md A1, A2 and the churn edge rows)."""

from __future__ import annotations

import datetime as dt

import pytest
from helpers import make_customers, make_orders

from marketlens.operators import features


def test_silence_of_more_than_ninety_days_is_churn(spark):
    cutoff, silent = dt.date(2024, 6, 30), [0, 1, 45, 89, 90, 91, 92, 200]
    customers = make_customers(spark, [(k, "email", "2023-03-03") for k in silent])
    orders = make_orders(spark, [(900 + k, k, str(cutoff - dt.timedelta(days=k)), 8.4) for k in silent])
    rows = features.build_customer_features(customers, orders, cutoff=str(cutoff)).collect()
    assert len(rows) == len(silent)
    for r in rows:
        assert r.days_since_last_order == r.customer_id and r.churned == (r.customer_id > 90)


def test_one_row_per_buying_customer(spark):
    customers = make_customers(spark, [(c, "referral", "2024-03-10") for c in (31, 32, 33)])
    orders = make_orders(spark, [(1, 31, "2024-03-10", 20.5), (2, 31, "2024-04-09", 10.0), (3, 31, "2024-05-09", 29.5),
                                 (4, 33, "2024-05-19", 7.0)])
    rows = {r.customer_id: r for r in
            features.build_customer_features(customers, orders, cutoff="2024-06-18").collect()}
    assert set(rows) == {31, 33}                   # nobody without an order
    many, single = rows[31], rows[33]
    assert (many.total_orders, many.total_revenue, many.avg_order_value) == (3, 60.0, 20.0)
    assert (single.total_orders, single.total_revenue, single.avg_order_value) == (1, 7.0, 7.0)
    assert (many.first_order_gap_days, single.first_order_gap_days) == (0, 70)
    assert many.tenure_days == single.tenure_days == 100
    assert many.order_frequency == pytest.approx(0.03)
    assert set(many.asDict()) == set(features.FEATURE_COLUMNS)


def test_signup_on_cutoff_and_negative_gap(spark):
    customers = make_customers(spark, [(1, "seo", "2025-12-31")])
    orders = make_orders(spark, [(1, 1, "2025-12-01", 10.0), (2, 1, "2025-12-31", 10.005)])
    r = features.build_customer_features(customers, orders).collect()[0]
    assert r.tenure_days == 0 and r.order_frequency == 2.0
    assert r.first_order_gap_days == -30
    assert r.avg_order_value == 10.0               # mean 10.005 -> half-even on the double


def test_cutoff_defaults_to_latest_order_and_censoring(spark):
    customers = make_customers(spark, [(1, "seo", "2025-01-01"), (2, "seo", "2025-11-15")])
    orders = make_orders(spark, [(1, 1, "2025-12-01", 10.0), (2, 2, "2025-12-31", 10.0)])
    check = features.censoring_check(customers, orders).collect()[0]
    assert str(check.cutoff) == "2025-12-31" and check.min_tenure_days == 46 and check.is_censored
    summary = features.churn_summary(features.build_customer_features(customers, orders)).collect()[0]
    assert (summary.customers, summary.churned, summary.churn_rate) == (2, 0, 0.0)


def test_leakage_guard():
    with pytest.raises(ValueError):
        features.assert_no_leakage(["tenure_days", "days_since_last_order"])
    features.assert_no_leakage(["tenure_days"])
