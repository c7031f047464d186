"""M1-M3 and the insight operators on hand-made edge cases (FIXTURES.md §C)."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from helpers import d, make_customers, make_orders, make_spend, money
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.operators import insights, marts
from marketlens.sources.staging import ORDERS


def econ_rows(spark, customers, orders, spend):
    out = marts.channel_economics(make_customers(spark, customers), make_orders(spark, orders),
                                  make_spend(spark, spend))
    return {(r.channel, str(r.spend_month)): r for r in out.collect()}


def test_zero_leads_and_zero_spend_give_null_not_error(spark):
    rows = econ_rows(spark, [(1, "seo", "2025-01-10")], [],
                     [("seo", "2025-01-01", 100.00, 0), ("seo", "2025-02-01", 0.00, 5)])
    jan, feb = rows[("seo", "2025-01-01")], rows[("seo", "2025-02-01")]
    assert jan.cpl is None and jan.cac == Decimal("100.00")
    assert feb.romi is None and feb.cpl == Decimal("0.00")


def test_no_acquisition_gives_zero_customers_and_null_cac(spark):
    rows = econ_rows(spark, [(1, "seo", "2024-06-01")], [], [("seo", "2025-01-01", 50.00, 5)])
    r = rows[("seo", "2025-01-01")]
    assert r.customers_acquired == 0 and r.cac is None
    assert r.revenue_same_month == Decimal("0.00") and r.romi == Decimal("-1.000")


def test_revenue_month_without_spend_has_no_row(spark):
    rows = econ_rows(spark, [(1, "seo", "2025-01-05")], [(10, 1, "2025-03-03", 40)],
                     [("seo", "2025-01-01", 10.00, 1)])
    assert list(rows) == [("seo", "2025-01-01")]
    assert rows[("seo", "2025-01-01")].cumulative_revenue == Decimal("0.00")


def test_spend_not_on_first_of_month_matches_nothing(spark):
    rows = econ_rows(spark, [(1, "seo", "2025-01-15")], [(10, 1, "2025-01-15", 40)],
                     [("seo", "2025-01-15", 10.00, 1)])
    r = rows[("seo", "2025-01-15")]
    assert r.customers_acquired == 0 and r.revenue_same_month == Decimal("0.00")


def test_duplicate_spend_month_peers_share_running_total(spark):
    out = marts.channel_economics(
        make_customers(spark, [(1, "seo", "2025-01-01")]), make_orders(spark, []),
        make_spend(spark, [("seo", "2025-01-01", 10.00, 1), ("seo", "2025-01-01", 20.00, 1),
                           ("seo", "2025-02-01", 5.00, 1)])).collect()
    jan = sorted(r.cumulative_spend for r in out if str(r.spend_month) == "2025-01-01")
    feb = [r.cumulative_spend for r in out if str(r.spend_month) == "2025-02-01"]
    assert jan == [Decimal("30.00"), Decimal("30.00")] and feb == [Decimal("35.00")]


def test_rounding_ties_are_half_away_from_zero(spark):
    rows = econ_rows(spark, [(1, "seo", "2025-01-01")], [(10, 1, "2025-01-02", 79.96)],
                     [("seo", "2025-01-01", 0.05, 2), ("seo", "2025-02-01", 80.00, 1)])
    assert rows[("seo", "2025-01-01")].cpl == Decimal("0.03")
    feb = econ_rows(spark, [(1, "seo", "2025-02-01")], [(10, 1, "2025-02-02", 79.96)],
                    [("seo", "2025-02-01", 80.00, 1)])[("seo", "2025-02-01")]
    assert feb.romi == Decimal("-0.001")  # -0.0005 rounds away from zero


def test_ltv_same_day_orders_ordered_by_id_with_row_frame(spark):
    customers = make_customers(spark, [(1, "seo", "2025-01-01"), (2, "email", "2025-01-01")])
    orders = make_orders(spark, [(11, 1, "2025-02-01", 10), (10, 1, "2025-02-01", 20),
                                 (12, 1, "2025-01-15", 5), (20, 2, "2025-03-01", 1.00),
                                 (21, 2, "2025-03-02", 1.01),
                                 (99, 7, "2025-03-01", 3)])
    out = {r.order_id: r for r in marts.customer_ltv(customers, orders).collect()}
    assert set(out) == {10, 11, 12, 20, 21}      # orphan order 99 dropped
    assert [out[i].order_seq for i in (12, 10, 11)] == [1, 2, 3]
    assert [out[i].cumulative_revenue for i in (12, 10, 11)] == [
        Decimal("5.00"), Decimal("25.00"), Decimal("35.00")]
    assert out[10].avg_order_value == Decimal("11.67")
    assert out[20].avg_order_value == Decimal("1.01")   # 1.005 -> half away from zero


def test_ltv_of_a_customer_with_a_third_of_all_orders_and_null_amounts(spark):
    """Against one window per customer over the joined rows."""
    rng = random.Random(5)
    customers = make_customers(spark, [(i, ("seo", "email")[i % 2], "2024-01-01") for i in range(1, 40)])
    rows = [(n, 1 if n % 3 == 0 else rng.randint(2, 45), d(f"2025-{1 + n % 3:02d}-{1 + rng.randint(0, 27):02d}"),
             None if rng.random() < .2 else money(rng.randint(1, 9999) / 100)) for n in range(1, 1200)]
    rows += [(5000 + i, 39, d("2025-01-01"), None) for i in range(3)]  # amounts are never known
    orders = spark.createDataFrame(rows, ORDERS)
    joined = orders.join(customers, "customer_id")
    w = Window.partitionBy("customer_id").orderBy("order_date", "order_id")
    want = joined.select(
        "customer_id", "channel", "order_id", "order_date", "total_amount",
        F.row_number().over(w).cast("long").alias("order_seq"),
        F.sum("total_amount").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("decimal(22,2)").alias("cumulative_revenue"),
        F.round(F.avg(F.col("total_amount").cast("decimal(30,10)")).over(Window.partitionBy("customer_id")), 2)
        .cast("decimal(38,2)").alias("avg_order_value"))
    got = marts.customer_ltv(customers, orders)
    key = lambda r: tuple(r)[2]
    assert [tuple(r) for r in sorted(got.collect(), key=key)] == [tuple(r) for r in sorted(want.collect(), key=key)]
    assert got.where("customer_id = 1").count() == 399


def test_retention_counts_all_signups_drops_pre_signup_and_uses_calendar_months(spark):
    customers = make_customers(spark, [(1, "seo", "2025-01-31"), (2, "seo", "2025-01-05"),
                                       (3, "seo", "2025-01-20")])
    orders = make_orders(spark, [(10, 1, "2025-02-01", 5), (11, 2, "2024-12-30", 5),
                                 (12, 2, "2025-01-06", 5), (13, 2, "2025-01-07", 5)])
    out = {(str(r.cohort_month), r.month_number): r for r in
           marts.cohort_retention(customers, orders).collect()}
    assert set(out) == {("2025-01-01", 0), ("2025-01-01", 1)}
    assert out[("2025-01-01", 0)].cohort_size == 3
    assert out[("2025-01-01", 0)].active_customers == 1
    assert out[("2025-01-01", 1)].retention_rate == Decimal("0.333")


def test_summary_is_ratio_of_sums_and_ranking_orders_by_romi(spark):
    econ = marts.channel_economics(
        make_customers(spark, [(1, "seo", "2025-01-01"), (2, "email", "2025-01-01")]),
        make_orders(spark, [(10, 1, "2025-01-02", 150), (11, 2, "2025-02-02", 10)]),
        make_spend(spark, [("seo", "2025-01-01", 100.00, 4), ("seo", "2025-02-01", 100.00, 1),
                           ("email", "2025-02-01", 20.00, 2)]))
    summary = {r.channel: r for r in insights.channel_summary(econ).collect()}
    assert summary["seo"].avg_cpl == Decimal("40.00")
    assert summary["seo"].romi == Decimal("-0.250")
    ranking = insights.channel_romi_ranking(insights.channel_summary(econ)).orderBy("romi_rank").collect()
    assert [r.channel for r in ranking] == ["seo", "email"]
    assert [r.profitable for r in ranking] == [False, False]


def test_romi_ranking_best_first_and_ties_by_name(spark):
    df = spark.createDataFrame([("post", 0.0), ("radio", -0.75), ("fairs", 1.25), ("flyers", 0.0)],
                               "channel string, romi double")
    out = insights.channel_romi_ranking(df).orderBy("romi_rank").collect()
    assert [(r.channel, r.profitable) for r in out] == [("fairs", True), ("flyers", True), ("post", True), ("radio", False)]
    with pytest.raises(KeyError):
        insights.channel_romi_ranking(df.drop("romi"))


def test_retention_matrix_and_curve(spark):
    ret = spark.createDataFrame(
        [(d("2025-01-01"), 0, Decimal("0.500")), (d("2025-01-01"), 1, Decimal("0.250")),
         (d("2025-02-01"), 0, Decimal("0.700")), (d("2025-01-01"), 9, Decimal("0.100"))],
        "cohort_month date, month_number int, retention_rate decimal(23,3)")
    matrix = {str(r.cohort_month): r for r in insights.retention_matrix(ret).collect()}
    assert matrix["2025-01-01"].month_1 == Decimal("0.250") and matrix["2025-02-01"].month_1 is None
    curve = insights.mean_retention_curve(ret)
    drop = insights.steepest_retention_drop(curve).collect()
    assert len(drop) == 1 and (drop[0].from_month, drop[0].to_month) == (0, 1)
    assert drop[0].retention_drop == pytest.approx(0.35)


def test_presentation_order_and_named_views(spark):
    from marketlens.sources.io import register_views
    ret = spark.createDataFrame([(d("2025-02-01"), 0), (d("2025-01-01"), 1), (d("2025-01-01"), 0)],
                                "cohort_month date, month_number int")
    ordered = [(str(r.cohort_month), r.month_number) for r in insights.present(ret, "cohort_retention").collect()]
    assert ordered == [("2025-01-01", 0), ("2025-01-01", 1), ("2025-02-01", 0)]
    register_views({"mart_cohort_retention": ret})
    assert spark.sql("SELECT COUNT(*) AS n FROM mart_cohort_retention").first().n == 3
