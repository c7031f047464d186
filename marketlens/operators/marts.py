"""M1-M3: channel economics, customer LTV and cohort retention.

Semantics kept from the SQL marts (see the README for the full list):
exact half-away-from-zero rounding on decimals, ``NULLIF`` instead of
division errors, the spend table driving the channel mart (left joins),
``cac`` divided by the un-coalesced acquisition count, RANGE running totals
where the order key may repeat, and a calendar-month offset that ignores the
day of month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from marketlens.functions.dates import month_offset, month_start
from marketlens.functions.decimal import round_div
from marketlens.operators.ranking import prefix_scan

REVENUE = DecimalType(22, 2)
CUMULATIVE = DecimalType(32, 2)


def channel_of_orders(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders ⋈ customers on customer_id, inner (orphans dropped).

    A customer owning a large share of the orders becomes one skewed
    sort-merge partition; AQE's skew-join split (enabled in the session
    defaults) divides it across tasks.
    """
    return orders.join(customers.select("customer_id", "channel"), "customer_id")


def channel_economics(customers: DataFrame, orders: DataFrame, spend: DataFrame) -> DataFrame:
    """M1: unit economics by (channel, spend_month).

    Both right-hand aggregates are at most one row per (channel, month), so
    AQE turns the two left joins into broadcasts from measured sizes, and the
    running-total windows run on that small joined table.
    """
    acquisitions = customers.groupBy(
        "channel", month_start(F.col("signup_date")).alias("spend_month")
    ).agg(F.count(F.lit(1)).alias("_acquired"))
    revenue = channel_of_orders(orders, customers).groupBy(
        "channel", month_start(F.col("order_date")).alias("spend_month")
    ).agg(F.sum("total_amount").cast(REVENUE).alias("_revenue"))

    base = (spend.join(acquisitions, ["channel", "spend_month"], "left")
            .join(revenue, ["channel", "spend_month"], "left")
            .withColumn("_rev0", F.coalesce(F.col("_revenue"), F.lit(0).cast(REVENUE))))
    # RANGE frame: peers (duplicate months) share the running value.
    running = (Window.partitionBy("channel").orderBy("spend_month")
               .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return base.select(
        "channel", "spend_month", "spend", "leads",
        round_div(F.col("spend"), F.col("leads"), 2).alias("cpl"),
        F.coalesce(F.col("_acquired"), F.lit(0)).cast("long").alias("customers_acquired"),
        round_div(F.col("spend"), F.col("_acquired"), 2).alias("cac"),
        F.col("_rev0").alias("revenue_same_month"),
        round_div(F.col("_rev0") - F.col("spend"), F.col("spend"), 3).alias("romi"),
        F.sum("spend").over(running).cast(CUMULATIVE).alias("cumulative_spend"),
        F.sum("_rev0").over(running).cast(CUMULATIVE).alias("cumulative_revenue"),
    )


def customer_ltv(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """M2: one row per order with order_seq, cumulative revenue, rounded AOV.

    Same-day orders of one customer are ordered by order_id (the SQL view
    leaves them ambiguous). A scan over segments of (customer, order date):
    the sums of a customer's days need no order's details and have at most a
    row per calendar day, the channel joins them there, and the orders are
    shuffled once, by customer and day, so that a customer with a third of all
    orders is spread over as many tasks as there are days.
    """
    valued = orders.select(
        "customer_id", "order_id", "order_date", "total_amount",
        F.col("total_amount").isNotNull().cast("long").alias("_valued"))
    scanned = prefix_scan(
        valued, ["customer_id"], {"_day": F.col("order_date")}, ["order_date", "order_id"],
        extra=customers.select("customer_id", "channel"),
        rank_col="order_seq", running={"_cum": "total_amount"},
        totals={"_sum": "total_amount", "_cnt": "_valued"})
    return scanned.select(
        "customer_id", "channel", "order_id", "order_date", "total_amount",
        F.col("order_seq").cast("long").alias("order_seq"),
        F.col("_cum").cast(REVENUE).alias("cumulative_revenue"),
        round_div(F.col("_sum"), F.col("_cnt"), 2, precision=16).alias("avg_order_value"),
    )


def cohort_sizes(customers: DataFrame) -> DataFrame:
    return customers.groupBy(month_start(F.col("signup_date")).alias("cohort_month")).agg(
        F.count(F.lit(1)).alias("cohort_size"))


def cohort_retention(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """M3: active customers per (cohort_month, month_number >= 0).

    Activity is made distinct on (customer_id, active_month) before joining
    the cohorts (pre-aggregation: a customer with millions of orders shrinks
    to one row per active month map-side, so neither the shuffle nor the join
    sees the hot key). Each (cohort, customer, month) is then unique, so the
    COUNT(DISTINCT customer) is a plain count. Sparse: months without
    activity have no row. Cohort sizes count every signup.
    """
    cohorts = customers.select(
        "customer_id", month_start(F.col("signup_date")).alias("cohort_month"))
    activity = orders.select(
        "customer_id", month_start(F.col("order_date")).alias("active_month")
    ).distinct()
    counted = (activity.join(cohorts, "customer_id")
               .withColumn("month_number", month_offset(F.col("active_month"), F.col("cohort_month")))
               .where(F.col("month_number") >= 0)
               .groupBy("cohort_month", "month_number")
               .agg(F.count(F.lit(1)).alias("active_customers")))
    # One row per signup month: a calendar-bounded table, broadcast is safe.
    sizes = cohort_sizes(customers)
    return counted.join(F.broadcast(sizes), "cohort_month").select(
        "cohort_month", "month_number", "cohort_size", "active_customers",
        round_div(F.col("active_customers"), F.col("cohort_size"), 3, precision=23)
        .alias("retention_rate"),
    )
