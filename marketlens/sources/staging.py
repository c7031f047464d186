"""Staging tables: schemas, readers, and the adapter over the driver's tables.

The marts consume three staging tables:

=====================  ==================================================
customers              customer_id long, channel string, signup_date date
orders                 order_id long, customer_id long, order_date date,
                       total_amount decimal(12,2)
marketing_spend        channel string, spend_month date (first of month),
                       spend decimal(18,2), leads long
=====================  ==================================================

``read_*`` load real staging Parquet with an explicit schema (no inference).
``staged_*`` derive them from the TPC-H-like test tables (``customer``,
``orders``, ``lineitem``), so every query's work grows with those tables.
Each ``staged_*`` has a DuckDB twin in ``STAGING_SQL`` for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DateType, DecimalType, LongType,
                               StringType, StructField, StructType)

from marketlens.functions.dates import month_start

MONEY = DecimalType(12, 2)
SPEND_MONEY = DecimalType(18, 2)

CUSTOMERS = StructType([
    StructField("customer_id", LongType(), False),
    StructField("channel", StringType(), True),
    StructField("signup_date", DateType(), True),
])
ORDERS = StructType([
    StructField("order_id", LongType(), False),
    StructField("customer_id", LongType(), True),
    StructField("order_date", DateType(), True),
    StructField("total_amount", MONEY, True),
])
MARKETING_SPEND = StructType([
    StructField("channel", StringType(), False),
    StructField("spend_month", DateType(), False),
    StructField("spend", SPEND_MONEY, True),
    StructField("leads", LongType(), True),
])
EXPERIMENT = StructType([
    StructField("customer_id", LongType(), False),
    StructField("variant", StringType(), False),
    StructField("sent_at", DateType(), False),
    StructField("converted", BooleanType(), False),
    StructField("converted_at", DateType(), True),
])
ORDER_EVENTS = StructType([
    StructField("order_id", LongType(), False),
    StructField("customer_id", LongType(), False),
    StructField("channel", StringType(), False),
    StructField("order_date", DateType(), False),
    StructField("total_amount", DecimalType(10, 2), False),
])

# Adapter constants (fixed values of the staging definition).
SIGNUP_EPOCH = "1995-01-01"
SIGNUP_STRIDE = 37
SIGNUP_SPAN_DAYS = 1461
RETURNED_FLAG = "R"


# Columns of the driver's tables that the adapter reads. Declaring them skips
# the Parquet footer inference pass on every read and prunes the scan.
RAW_SCHEMAS = {
    "customer": "c_custkey long, c_mktsegment string",
    "orders": "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz",
    "lineitem": ("l_orderkey long, l_extendedprice double, l_discount double, "
                 "l_returnflag string, l_shipdate timestamp_ntz"),
}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = RAW_SCHEMAS.get(name)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(table_path(sf_dir, name))


def read_staging(spark: SparkSession, path: str, schema: StructType,
                 fmt: str = "parquet") -> DataFrame:
    """Scan a staging table with an explicit schema (dates typed on read)."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


# ------------------------------------------------------------ adapter (Spark)
def customers_from(customer: DataFrame) -> DataFrame:
    offset = (F.col("c_custkey") * SIGNUP_STRIDE % SIGNUP_SPAN_DAYS).cast("int")
    return customer.select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_mktsegment").alias("channel"),
        F.date_add(F.lit(SIGNUP_EPOCH).cast("date"), offset).alias("signup_date"),
    )


def orders_from(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_totalprice").cast(MONEY).alias("total_amount"),
    )


def marketing_spend_from(lineitem: DataFrame, orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Spend and leads per (channel, month) derived from line items.

    spend = sum(price * discount) of the month's shipped lines of the
    channel's customers; leads = orders with a returned line that month.

    Plan: line items are first reduced to one row per (order, ship month)
    (partial aggregation map-side, so even an order holding a huge share of
    all lines shrinks to at most one row per month before any join), which
    also turns the distinct-order lead count into a plain sum (no Expand).
    That table is joined to orders ⋈ customers on the order key in a
    sort-merge join (hinted: after column pruning the optimizer can
    under-estimate the line-item side enough to broadcast it), and the final
    aggregate by (channel, month) combines map-side.
    """
    # price (cents) x discount (hundredths): an exact LONG in 1/10000 units;
    # one order-month has a handful of lines, so its sum cannot overflow.
    cents = (F.col("l_extendedprice").cast(MONEY) * 100).cast("long")
    pct = (F.col("l_discount").cast(DecimalType(4, 2)) * 100).cast("long")
    per_order_month = lineitem.groupBy(
        F.col("l_orderkey"),
        month_start(F.col("l_shipdate").cast("date")).alias("spend_month"),
    ).agg(
        F.sum(cents * pct).alias("amount4"),
        F.max((F.col("l_returnflag") == RETURNED_FLAG).cast("int")).alias("returned"),
    )
    order_channel = (
        orders.select("o_orderkey", "o_custkey")
        .join(customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", F.col("c_mktsegment").alias("channel"))
    )
    joined = per_order_month.hint("merge").join(
        order_channel, F.col("l_orderkey") == F.col("o_orderkey"))
    # The channel-month total is summed as DECIMAL(38,0) (no overflow at any
    # scale), then scaled back to money and rounded half-up to cents.
    total4 = F.sum(F.col("amount4").cast(DecimalType(38, 0)))
    return joined.groupBy("channel", "spend_month").agg(
        F.round(total4 * F.lit("0.0001").cast(DecimalType(4, 4)), 2).cast(SPEND_MONEY).alias("spend"),
        F.sum("returned").cast("long").alias("leads"),
    )


class Staging:
    """The three staging tables over one folder of driver tables.

    Each table is built on first use and raw scans are shared, so a query
    only pays for the tables it reads.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._raw: dict[str, DataFrame] = {}
        self._built: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = read_table(self.spark, self.sf_dir, name)
        return self._raw[name]

    def __getitem__(self, key: str) -> DataFrame:
        if key not in self._built:
            if key == "customers":
                self._built[key] = customers_from(self.raw("customer"))
            elif key == "orders":
                self._built[key] = orders_from(self.raw("orders"))
            elif key == "spend":
                self._built[key] = marketing_spend_from(
                    self.raw("lineitem"), self.raw("orders"), self.raw("customer"))
            else:
                raise KeyError(key)
        return self._built[key]


def staged(spark: SparkSession, sf_dir: str) -> Staging:
    return Staging(spark, sf_dir)


def staged_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir)["customers"]


def staged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir)["orders"]


def staged_marketing_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir)["spend"]


# ---------------------------------------------------------- adapter (DuckDB)
STAGING_SQL = {
    "stg_customers": (
        "SELECT c_custkey AS customer_id, c_mktsegment AS channel, "
        f"CAST(DATE '{SIGNUP_EPOCH}' + CAST(c_custkey * {SIGNUP_STRIDE} % {SIGNUP_SPAN_DAYS} AS INTEGER) AS DATE) "
        "AS signup_date FROM customer"
    ),
    "stg_orders": (
        "SELECT o_orderkey AS order_id, o_custkey AS customer_id, "
        "CAST(o_orderdate AS DATE) AS order_date, "
        "CAST(o_totalprice AS DECIMAL(12,2)) AS total_amount FROM orders"
    ),
    "stg_marketing_spend": (
        "SELECT c.c_mktsegment AS channel, "
        "CAST(date_trunc('month', CAST(l.l_shipdate AS DATE)) AS DATE) AS spend_month, "
        "CAST(ROUND(SUM(CAST(l.l_extendedprice AS DECIMAL(12,2)) * CAST(l.l_discount AS DECIMAL(4,2))), 2) "
        "AS DECIMAL(18,2)) AS spend, "
        f"COUNT(DISTINCT CASE WHEN l.l_returnflag = '{RETURNED_FLAG}' THEN l.l_orderkey END) AS leads "
        "FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey "
        "JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY 1, 2"
    ),
}


def with_staging(sql_body: str, *names: str) -> str:
    """Prefix an oracle query with the staging CTEs it uses."""
    needed = names or tuple(STAGING_SQL)
    ctes = ",\n".join(f"{n} AS ({STAGING_SQL[n]})" for n in needed)
    body = sql_body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
