"""Q1-Q5: the experiment table's constraints as one violations report.

The table's declared constraints (primary key, foreign key to customers,
variant domain, NOT NULL columns) become counts: zero violations means the
table would have been accepted. The null and domain checks share one pass;
the key check is one aggregation by customer_id and the foreign-key check a
left anti join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from marketlens.operators.frames import attach_one_row

# The allowed variants.
VARIANTS = ("control", "treatment")


def _count_when(cond) -> F.Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")


def check_experiment(experiment: DataFrame, customers: DataFrame) -> DataFrame:
    """Q5: rows (check, violations) for Q1-Q4."""
    single = experiment.agg(
        _count_when(F.col("customer_id").isNull()).alias("primary_key_null"),
        _count_when(F.col("variant").isNotNull() & ~F.col("variant").isin(*VARIANTS))
        .alias("variant_domain"),
        _count_when(F.col("variant").isNull()).alias("variant_not_null"),
        _count_when(F.col("sent_at").isNull()).alias("sent_at_not_null"),
        _count_when(F.col("converted").isNull()).alias("converted_not_null"),
    )
    duplicates = (experiment.where(F.col("customer_id").isNotNull())
                  .groupBy("customer_id").count()
                  .agg(_count_when(F.col("count") > 1).alias("primary_key_unique")))
    orphans = (experiment.where(F.col("customer_id").isNotNull())
               .join(customers.select("customer_id"), "customer_id", "left_anti")
               .agg(F.count(F.lit(1)).cast("long").alias("foreign_key_customers")))
    wide = attach_one_row(attach_one_row(single, duplicates), orphans)
    checks = ["primary_key_unique", "primary_key_null", "foreign_key_customers",
              "variant_domain", "variant_not_null", "sent_at_not_null", "converted_not_null"]
    stacked = ", ".join(f"'{c}', {c}" for c in checks)
    return wide.selectExpr(f"stack({len(checks)}, {stacked}) AS (check_name, violations)")
