"""Session helpers.

Library operators never create a session; they take DataFrames. These helpers
are for tests, the bench and the registered queries, and for locating the
shared scratch folder (``spark.checkpoint.dir``) that snapshots, streaming
checkpoints and lineage cuts must live in on a cluster.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every entry point relies on for correct results.
#  - UTC session time zone: dates derived from timestamps must not depend on
#    the driver's locale.
#  - AQE with skew-join splitting: a customer holding a large share of all
#    orders is split across tasks in the orders/customers joins.
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "marketlens", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench (the UI stays off)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("MARKETLENS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in {**CORE_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a private one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS, object
    store); it is read from the session and never overridden. Only when it is
    unset (local tests) is a fresh temporary folder used.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="marketlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder path under the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/marketlens/{name}-{uuid.uuid4().hex[:12]}"


def recommended_conf(input_bytes: int, partition_bytes: int = 256 * 1024 ** 2) -> dict[str, str]:
    """Partition sizing for a cluster run over ``input_bytes`` of Parquet.

    Scans split at ``partition_bytes``; the initial shuffle width gives each
    reducer about that much input so sorts and hash tables fit in executor
    memory (spilling stays the exception), and AQE coalesces small partitions
    and splits skewed ones around the same target at run time.
    """
    parts = max(8, -(-int(input_bytes) // partition_bytes))
    size = f"{partition_bytes // (1024 ** 2)}m"
    return {
        **CORE_CONF,
        "spark.sql.files.maxPartitionBytes": size,
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": size,
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": f"{2 * partition_bytes // (1024 ** 2)}m",
    }
