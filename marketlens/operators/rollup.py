"""Channel-month revenue roll-up: denormalised events, partial states, merge.

The OLAP side keeps one row per order with the channel denormalised at load
time (J5), stored month-partitioned and sorted by (channel, order_date,
customer_id) so channel/date filters prune files and row groups (K5). The
roll-up is kept as mergeable partial states per inserted block — ``sum`` and
``count`` are their own states — and finished by re-aggregating the states
(R3/R4). All three ways to get the numbers must agree (R6).

What is loaded is published through one version log: an entry names every
events and states folder that belongs together, so a reader never sees events
without their states. A load replaces everything or adds to it; ``compact``
merges the states that have gathered into one folder while loads go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from marketlens.functions.dates import month_start, yyyymm
from marketlens.operators.frames import attach_one_row
from marketlens.sources import manifest
from marketlens.sources.staging import ORDER_EVENTS

EVENTS, STATES = "events", "states"
EVENT_MONEY = DecimalType(10, 2)
STATE_MONEY = DecimalType(38, 2)
# The columns of the event table.
EVENT_COLUMNS = ["order_id", "customer_id", "channel", "order_date", "total_amount"]
ROLLUP_KEYS = ["channel", "revenue_month"]


def order_events(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """J5 ``orders_to_rows``: one row per order with its customer's channel.

    Inner join: orders of unknown customers are dropped (see ``orphan_orders``).
    """
    return (orders.join(customers.select("customer_id", "channel"), "customer_id")
            .select("order_id", "customer_id", "channel", "order_date",
                    F.col("total_amount").cast(EVENT_MONEY).alias("total_amount")))


def orphan_orders(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """The orders J5 drops (customer unknown), as a left anti join."""
    return orders.join(customers.select("customer_id"), "customer_id", "left_anti").select(
        "order_id", "customer_id", "order_date", "total_amount")


def rollup_from_orders(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Recompute from staging (join, then aggregate; combines map-side)."""
    return (orders.join(customers.select("customer_id", "channel"), "customer_id")
            .groupBy("channel", month_start(F.col("order_date")).alias("revenue_month"))
            .agg(F.sum("total_amount").cast(STATE_MONEY).alias("revenue"),
                 F.count(F.lit(1)).alias("orders")))


def rollup_from_events(events: DataFrame) -> DataFrame:
    """R2: aggregate the denormalised events (no join at query time)."""
    return (events.groupBy("channel", month_start(F.col("order_date")).alias("revenue_month"))
            .agg(F.sum("total_amount").cast(STATE_MONEY).alias("revenue"),
                 F.count(F.lit(1)).alias("orders")))


def partial_states(events: DataFrame, block: Column | str | None = None) -> DataFrame:
    """Per inserted block, ``sum`` and ``count`` states by (channel, month)."""
    keys = [month_start(F.col("order_date")).alias("revenue_month")]
    if block is not None:
        keys.append((F.col(block) if isinstance(block, str) else block).alias("block"))
    return events.groupBy("channel", *keys).agg(
        F.sum("total_amount").cast(STATE_MONEY).alias("sum_state"),
        F.count(F.lit(1)).alias("cnt_state"))


def merge_states(states: DataFrame) -> DataFrame:
    """Finish the states (``sumMerge`` / ``countMerge``)."""
    return states.groupBy(*ROLLUP_KEYS).agg(
        F.sum("sum_state").cast(STATE_MONEY).alias("revenue"),
        F.sum("cnt_state").cast("long").alias("orders"))


def write_events(events: DataFrame, path: str) -> None:
    """K5: month-partitioned, (channel, order_date, customer_id)-sorted files.

    Idempotent replace (T27). Range partitioning on (month, channel, date,
    customer, order) gives every writer a contiguous slice of a total order,
    so even a hot month or customer-day is split over many writers, and each
    file covers a narrow
    (channel, date) range, which keeps Parquet min/max pruning effective.
    """
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (events.withColumn("yyyymm", yyyymm(F.col("order_date")))
     .repartitionByRange(n, "yyyymm", "channel", "order_date", "customer_id", "order_id")
     .sortWithinPartitions("yyyymm", "channel", "order_date", "customer_id", "order_id")
     .write.mode("overwrite").partitionBy("yyyymm").parquet(path))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*EVENT_COLUMNS)


STATE_SCHEMA = "channel string, revenue_month date, sum_state decimal(38,2), cnt_state long"


def _write_load(orders: DataFrame, customers: DataFrame, root: str) -> tuple[str, str]:
    """New folders of events and of their states, not published yet."""
    events, states = manifest.new_folder(root, EVENTS), manifest.new_folder(root, STATES)
    write_events(order_events(orders, customers), events)
    stored = read_events(orders.sparkSession, events)
    # One block per stored file, as an insert trigger would see them.
    partial_states(stored, F.input_file_name()).drop("block").write.parquet(states)
    return events, states


def load_events_and_rollup(orders: DataFrame, customers: DataFrame, root: str) -> int:
    """K4: replace the events and their roll-up together; returns the version.

    Both are written aside and switched by one log entry. A second load of
    the same data gives the same events and states.
    """
    events, states = _write_load(orders, customers, root)
    return manifest.commit(orders.sparkSession, root, lambda _: {EVENTS: [events], STATES: [states]})


def append_load(orders: DataFrame, customers: DataFrame, root: str, source: str, number: int) -> int:
    """Add a load's events and partial states.

    A source's loads are numbered upwards; one that is published already changes nothing.
    """
    spark = orders.sparkSession
    if manifest.known(manifest.current(spark, root), source, number):
        return manifest.newest(spark, root)
    events, states = _write_load(orders, customers, root)

    def add(now: manifest.Version) -> manifest.Folders:
        return {EVENTS: [*now.folders.get(EVENTS, []), events], STATES: [*now.folders.get(STATES, []), states]}
    return manifest.commit(spark, root, add, load=(source, number))


def compact(spark: SparkSession, root: str) -> int:
    """Merge the published states into one folder; states published meanwhile stay beside it."""
    before = manifest.current(spark, root).folders.get(STATES, [])
    if len(before) < 2:
        return manifest.newest(spark, root)
    merged = manifest.new_folder(root, STATES)
    both = spark.read.schema(STATE_SCHEMA).parquet(*before)
    both.groupBy(*ROLLUP_KEYS).agg(F.sum("sum_state").cast(STATE_MONEY).alias("sum_state"),
                                   F.sum("cnt_state").cast("long").alias("cnt_state")).write.parquet(merged)

    def swap(now: manifest.Version) -> manifest.Folders | None:
        states = now.folders.get(STATES, [])
        if not set(before) <= set(states):  # replaced or compacted by someone else
            return None
        return now.folders | {STATES: [merged, *[s for s in states if s not in before]]}
    return manifest.commit(spark, root, swap)


def read_load(spark: SparkSession, root: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, partial states) of one version, the newest by default."""
    now = manifest.read(spark, root, version) if version else manifest.current(spark, root)
    if not now.number:
        raise FileNotFoundError(f"nothing is loaded under {root}")
    none = spark.createDataFrame([], STATE_SCHEMA)
    states = now.folders.get(STATES)
    events = [read_events(spark, path) for path in now.folders.get(EVENTS, [])]
    every = events[0] if events else spark.createDataFrame([], ORDER_EVENTS)
    for more in events[1:]:
        every = every.unionByName(more)
    return every, spark.read.schema(STATE_SCHEMA).parquet(*states) if states else none


def _count_only(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).agg(F.count(F.lit(1)).alias("n"))


def rollup_consistency(named: dict[str, DataFrame]) -> DataFrame:
    """Pairwise multiset differences against the first roll-up.

    One row per comparison: rows only in the reference side, rows only in
    the other side. All zeros means the ways agree.
    """
    names = list(named)
    base_name, base = names[0], named[names[0]].select("channel", "revenue_month", "revenue", "orders")
    parts = []
    for other_name in names[1:]:
        other = named[other_name].select("channel", "revenue_month", "revenue", "orders")
        left = _count_only(base, other).withColumnRenamed("n", "only_left")
        right = _count_only(other, base).withColumnRenamed("n", "only_right")
        parts.append(attach_one_row(left, right).select(
            F.lit(f"{base_name}_vs_{other_name}").alias("comparison"), "only_left", "only_right"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
