"""Invariants on the driver's sf0.001 tables (SURVEY §5 strategy (c))."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from marketlens.operators import insights, marts
from marketlens.sources.staging import staged

SF = os.environ.get("MARKETLENS_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def tables(spark):
    return staged(spark, SF)


def test_ltv_last_cumulative_equals_customer_total(spark, tables):
    plain = marts.customer_ltv(tables["customers"], tables["orders"])
    last = plain.groupBy("customer_id").agg(
        F.max_by("cumulative_revenue", "order_seq").alias("last"),
        F.sum("total_amount").alias("total"), F.max("order_seq").alias("n"), F.count("*").alias("c"))
    assert last.where("last != total OR n != c").count() == 0
    assert plain.count() == tables["orders"].join(tables["customers"], "customer_id").count()


def test_channel_cumulative_spend_ends_at_total(tables):
    econ = marts.channel_economics(tables["customers"], tables["orders"], tables["spend"])
    ends = econ.groupBy("channel").agg(
        F.max_by("cumulative_spend", "spend_month").alias("end"), F.sum("spend").alias("total"))
    assert ends.where("end != total").count() == 0
    summary = {r.channel: r for r in insights.channel_summary(econ).collect()}
    share = insights.channel_spend_share(insights.channel_summary(econ)).agg(F.sum("spend_share")).first()[0]
    assert abs(float(share) - 1.0) < 0.001 * len(summary)


def test_retention_bounds(tables):
    ret = marts.cohort_retention(tables["customers"], tables["orders"])
    assert ret.where("active_customers > cohort_size OR month_number < 0").count() == 0
    sizes = marts.cohort_sizes(tables["customers"]).agg(F.sum("cohort_size")).first()[0]
    assert sizes == tables["customers"].count()
