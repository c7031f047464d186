"""Exports and the features data set on disk.

All writes go through Spark's writers to a path the caller names (on a
cluster, a shared folder); nothing is staged on the driver's local disk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

# Quotes inside a text are doubled; NULL is nothing between two commas, empty text a pair of quotes (the
# writer's and the reader's default).
# The reader takes a field that isn't there for this text, which no field holds; with its default, the
# empty text, it couldn't tell the two apart.
ABSENT = "\0NULL"
CSV = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}

FEATURES_SCHEMA = StructType([
    StructField("customer_id", LongType(), False),
    StructField("channel", StringType(), True),
    StructField("tenure_days", LongType(), True),
    StructField("total_orders", LongType(), True),
    StructField("total_revenue", DoubleType(), True),
    StructField("avg_order_value", DoubleType(), True),
    StructField("first_order_gap_days", LongType(), True),
    StructField("order_frequency", DoubleType(), True),
    StructField("days_since_last_order", LongType(), True),
    StructField("churned", IntegerType(), True),
])


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """K1: CSV with a header row, replacing earlier output.

    ``single_file`` funnels the rows through one writer task; use it only for
    marts whose size is bounded (channel-month, cohort-month tables).
    """
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").options(**CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What ``export_csv`` wrote, typed by its schema: decimals, dates, and empty text apart from NULL."""
    return spark.read.schema(schema).options(**CSV, mode="FAILFAST", nullValue=ABSENT).csv(path)


def round_trip_gaps(df: DataFrame, back: DataFrame) -> DataFrame:
    """One row: rows written, rows lost and rows that came back otherwise (multiset differences).

    Both sides are read once: equal rows meet in one aggregation, which combines map-side and counts each side's.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    side = lambda x, n: x.toDF(*names).withColumn("n_df", F.lit(n)).withColumn("n_back", F.lit(1 - n))
    met = side(df, 1).union(side(back, 0)).groupBy(*names).agg(F.sum("n_df").alias("n_df"), F.sum("n_back").alias("n_back"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    gap = F.col("n_df") - F.col("n_back")
    return met.agg(total(F.col("n_df"), "rows"), total(F.greatest(gap, F.lit(0)), "lost"), total(F.greatest(-gap, F.lit(0)), "changed"))


def export_marts(marts: dict[str, DataFrame], root: str, single_file_for: set[str] = frozenset()) -> None:
    """K1 over several marts: one folder per mart under ``root``."""
    for name, df in marts.items():
        export_csv(df, f"{root.rstrip('/')}/{name}", single_file=name in single_file_for)


def write_features(features: DataFrame, path: str, csv_path: str | None = None) -> None:
    """K2: the features data set as Parquet (and optionally CSV for hand-over)."""
    features.write.mode("overwrite").parquet(path)
    if csv_path:
        export_csv(features, csv_path)


def read_features_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read a features CSV with the declared schema (no inference pass)."""
    return read_csv(spark, path, FEATURES_SCHEMA)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEATURES_SCHEMA).parquet(path)


def register_views(marts: dict[str, DataFrame], replace: bool = True) -> None:
    """K6: define (or replace) a named temporary view per mart, so SQL users
    can query ``mart_channel_economics`` etc. with ``spark.sql``."""
    for name, df in marts.items():
        if replace:
            df.createOrReplaceTempView(name)
        else:
            df.createTempView(name)
