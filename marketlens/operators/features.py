"""One row of churn features per customer.

Per-customer aggregates are one ``groupBy`` (combined map-side, so a
customer with millions of orders is reduced before the shuffle); the cut-off
date is a one-row aggregate joined by broadcast, so the plan stays lazy.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.dates import days_between
from marketlens.functions.decimal import round_half_even_2
from marketlens.operators.frames import attach_one_row

CHURN_WINDOW_DAYS = 90
# The columns of the features data set.
FEATURE_COLUMNS = [
    "customer_id", "channel", "tenure_days", "total_orders", "total_revenue", "avg_order_value",
    "first_order_gap_days", "order_frequency", "days_since_last_order", "churned",
]
# days_since_last_order defines the label: it is kept in the data set but is
# never a model input (target leakage).
LEAKY_COLUMNS = ("days_since_last_order",)


def cutoff_frame(orders: DataFrame, cutoff: str | dt.date | None = None) -> DataFrame:
    """One row ``cutoff`` = the given date, else the latest order date."""
    if cutoff is None:
        return orders.agg(F.max("order_date").alias("cutoff"))
    spark = orders.sparkSession
    return spark.range(1).select(F.lit(str(cutoff)).cast("date").alias("cutoff"))


def build_customer_features(customers: DataFrame, orders: DataFrame,
                            cutoff: str | dt.date | None = None,
                            window_days: int = CHURN_WINDOW_DAYS) -> DataFrame:
    """Features and the churn label, inner join."""
    agg = orders.groupBy("customer_id").agg(
        F.count("order_date").alias("total_orders"),
        F.sum("total_amount").alias("_revenue"),
        F.count("total_amount").alias("_n_amount"),
        F.min("order_date").alias("_first"),
        F.max("order_date").alias("_last"),
    )
    cut: Column = F.col("cutoff")
    tenure = days_between(cut, F.col("signup_date"))
    since_last = days_between(cut, F.col("_last"))
    mean = F.col("_revenue").cast("double") / F.col("_n_amount")
    df = attach_one_row(customers.select("customer_id", "channel", "signup_date").join(agg, "customer_id"),
                        cutoff_frame(orders, cutoff))
    return df.select(
        "customer_id", "channel",
        tenure.cast("long").alias("tenure_days"),
        F.col("total_orders").cast("long").alias("total_orders"),
        F.col("_revenue").cast("double").alias("total_revenue"),
        round_half_even_2(mean).alias("avg_order_value"),
        days_between(F.col("_first"), F.col("signup_date")).cast("long").alias("first_order_gap_days"),
        (F.col("total_orders") / F.greatest(tenure, F.lit(1))).cast("double").alias("order_frequency"),
        since_last.cast("long").alias("days_since_last_order"),
        (since_last > window_days).cast("int").alias("churned"),
    )


def censoring_check(customers: DataFrame, orders: DataFrame,
                    cutoff: str | dt.date | None = None,
                    window_days: int = CHURN_WINDOW_DAYS) -> DataFrame:
    """Youngest tenure at the cut-off; censored when below the window."""
    youngest = attach_one_row(customers, cutoff_frame(orders, cutoff)).agg(
        F.first("cutoff").alias("cutoff"),
        F.min(days_between(F.col("cutoff"), F.col("signup_date"))).cast("long").alias("min_tenure_days"))
    return youngest.select("cutoff", "min_tenure_days",
                           (F.col("min_tenure_days") < window_days).alias("is_censored"))


def churn_summary(features: DataFrame) -> DataFrame:
    """Customers, churned count and churn rate."""
    return features.agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("churned").cast("long").alias("churned"),
        (F.sum("churned") / F.count(F.lit(1))).cast("double").alias("churn_rate"))


def assert_no_leakage(columns: list[str]) -> None:
    """Refuse model inputs that leak the label."""
    leaked = [c for c in columns if c in LEAKY_COLUMNS]
    if leaked:
        raise ValueError(f"target leakage: {leaked} must not be model inputs")
