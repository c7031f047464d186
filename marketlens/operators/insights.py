"""Summaries and published insights over the marts.

Inputs here are already aggregated (one row per channel-month, cohort-month
or order), so every operator is a further aggregation that combines
map-side. One-row totals are joined with a broadcast of exactly one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.decimal import round_div
from marketlens.operators.frames import attach_one_row


# Presentation orders, applied only at the output boundary (sorting is
# a global range shuffle; nothing upstream depends on row order).
PRESENTATION_ORDER = {
    "cohort_retention": [("cohort_month", "asc"), ("month_number", "asc")],
    "channel_summary": [("romi", "desc_nulls_first"), ("channel", "asc")],
    "ltv_curve": [("order_seq", "asc")],
    "importance": [("importance", "desc"), ("feature", "asc")],
}


def present(df: DataFrame, kind: str) -> DataFrame:
    """Sort a result for display (O1 cohort/month, O2 ROMI desc, O3 order
    depth, O4 importance desc)."""
    return df.orderBy(*[getattr(F.col(c), how)() for c, how in PRESENTATION_ORDER[kind]])


def positioned(df: DataFrame, kind: str) -> DataFrame:
    """O1-O4 as data: ``position`` counts a summary's rows from 1 in presentation order.

    Summaries have a row per channel, calendar month, order depth or model
    input, so one task numbers them.
    """
    order = [getattr(F.col(c), how)() for c, how in PRESENTATION_ORDER[kind]]
    every = Window.partitionBy(F.lit(0)).orderBy(*order)
    return df.withColumn("position", F.row_number().over(every).cast("long"))


def require_columns(df: DataFrame, *names: str) -> None:
    """Fail at plan time when a required column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"DataFrame must contain {', '.join(repr(n) for n in names)} columns; "
                       f"missing {missing}")


def _mean(col: str) -> F.Column:
    """Mean of a DECIMAL column's non-NULL values as DOUBLE: exact sum, one final division."""
    return F.try_divide(F.sum(col).cast("double"), F.count(col).cast("double"))


def channel_summary(econ: DataFrame) -> DataFrame:
    """M4: whole-period totals per channel; ratios are ratios of sums."""
    require_columns(econ, "channel", "spend", "leads", "customers_acquired", "revenue_same_month")
    sums = econ.groupBy("channel").agg(
        F.sum("spend").alias("total_spend"),
        F.sum("leads").alias("total_leads"),
        F.sum("customers_acquired").alias("total_customers"),
        F.sum("revenue_same_month").alias("_revenue"),
    )
    return sums.select(
        "channel", "total_spend", "total_leads", "total_customers",
        round_div(F.col("total_spend"), F.col("total_leads"), 2).alias("avg_cpl"),
        round_div(F.col("total_spend"), F.col("total_customers"), 2).alias("avg_cac"),
        round_div(F.col("_revenue") - F.col("total_spend"), F.col("total_spend"), 3).alias("romi"),
    )


def ltv_curve(ltv: DataFrame, max_seq: int = 8) -> DataFrame:
    """M5: mean cumulative revenue and customers reaching each order depth."""
    return (ltv.where(F.col("order_seq") <= max_seq)
            .groupBy("order_seq")
            .agg(_mean("cumulative_revenue").alias("avg_cumulative_revenue"),
                 F.count(F.lit(1)).alias("customers_reaching")))


def retention_matrix(retention: DataFrame, months: int = 7) -> DataFrame:
    """M6: cohorts x months 0..months-1 (missing cells stay NULL).

    (cohort_month, month_number) is the mart's unique key (checked by the
    snapshot key check), so each cell holds at most one value.
    """
    values = list(range(months))
    pivoted = (retention.where(F.col("month_number").between(0, months - 1))
               .groupBy("cohort_month")
               .pivot("month_number", values)
               .agg(F.first("retention_rate")))
    return pivoted.select("cohort_month", *[F.col(str(m)).alias(f"month_{m}") for m in values])


def channel_romi_ranking(summary: DataFrame) -> DataFrame:
    """M7: channels by ROMI descending (NULLs first) with a profitability flag.

    The input is one row per channel (already aggregated), so the ranking
    window covers a channel-sized table.
    """
    require_columns(summary, "channel", "romi")
    order = Window.orderBy(F.col("romi").desc_nulls_first(), F.col("channel"))
    return summary.select(
        "channel", "romi",
        F.row_number().over(order).cast("long").alias("romi_rank"),
        (F.col("romi") >= 0).alias("profitable"),
    )


def revenue_per_spend(econ: DataFrame) -> DataFrame:
    """Same-month revenue returned per unit of spend (= 1 + ROMI)."""
    sums = econ.groupBy("channel").agg(F.sum("revenue_same_month").alias("_rev"),
                                       F.sum("spend").alias("_spend"))
    return sums.select("channel", round_div(F.col("_rev"), F.col("_spend"), 3)
                       .alias("revenue_per_spend"))


def first_orders(orders: DataFrame) -> DataFrame:
    """Each customer's first order amount (earliest date, then lowest id).

    An aggregation (min_by), not a window: partial results combine map-side,
    so a customer with millions of orders never lands whole in one task.
    """
    return orders.groupBy("customer_id").agg(
        F.min_by("total_amount", F.struct("order_date", "order_id")).alias("first_amount"))


def first_order_payback(orders: DataFrame, customers: DataFrame, summary: DataFrame) -> DataFrame:
    """Mean first-order revenue (all customers) divided by channel CAC.

    First orders are reduced per customer before the semi join with the
    customer table, so the join sees one row per customer.
    """
    known = first_orders(orders).join(customers.select("customer_id"), "customer_id", "left_semi")
    mean_first = known.agg(_mean("first_amount").alias("mean_first_order"))
    return attach_one_row(summary.select("channel", "avg_cac"), mean_first).select(
        "channel", "avg_cac", "mean_first_order",
        (F.col("mean_first_order") / F.col("avg_cac").cast("double")).alias("payback_ratio"))


def mean_retention_curve(retention: DataFrame) -> DataFrame:
    """Unweighted mean of retention_rate over the cohorts present."""
    return retention.groupBy("month_number").agg(
        _mean("retention_rate").alias("mean_retention"),
        F.count(F.lit(1)).alias("cohorts"))


def steepest_retention_drop(curve: DataFrame) -> DataFrame:
    """I4: the largest fall between consecutive months of the mean curve.

    Consecutive months are paired by an equi-join on month_number + 1; the
    single steepest step is the report (a top-1, ties to the earlier month).
    """
    prev = curve.select(F.col("month_number").alias("from_month"),
                        F.col("mean_retention").alias("from_retention"))
    steps = curve.join(prev, F.col("month_number") == F.col("from_month") + 1).select(
        "from_month", F.col("month_number").alias("to_month"),
        (F.col("from_retention") - F.col("mean_retention")).alias("retention_drop"))
    return steps.orderBy(F.col("retention_drop").desc(), "from_month").limit(1)


def channel_spend_share(summary: DataFrame) -> DataFrame:
    """Each channel's share of the total marketing budget."""
    total = summary.agg(F.sum("total_spend").alias("_all"))
    return attach_one_row(summary, total).select(
        "channel", "total_spend",
        round_div(F.col("total_spend"), F.col("_all"), 4).alias("spend_share"))
