"""V1-V5, K3: versioned, key-checked snapshots of the marts.

A snapshot root holds immutable data folders and a version log
(``sources.manifest``). A refresh writes the new version in full, checks its
unique key on the stored copy, and only then publishes it; readers resolve the
newest version, so they keep seeing the previous result until the new one is
complete (the refresh never blocks or tears reads). Of two refreshes at once,
each gets a number of its own. Everything goes through Spark's writers, so the
root may live on any shared file system named by the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.sources import manifest

DATA = "data"


class KeyViolation(ValueError):
    """Raised when a snapshot's declared unique key does not hold."""


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """V3: one row (rows, duplicate_keys, null_keys) for the declared key.

    One aggregation by key (combined map-side) and a one-row total.
    """
    any_null = None
    for k in keys:
        cond = F.col(k).isNull()
        any_null = cond if any_null is None else (any_null | cond)
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("_n") > 1, 1).otherwise(0)), F.lit(0)).cast("long")
        .alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(any_null, F.col("_n")).otherwise(0)), F.lit(0)).cast("long")
        .alias("null_keys"),
    )


def current_version(spark: SparkSession, root: str) -> int | None:
    return manifest.newest(spark, root) or None


def _read(spark: SparkSession, version: manifest.Version) -> DataFrame:
    return spark.read.parquet(*version.folders[DATA])


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    return _read(spark, manifest.read(spark, root, int(version)))


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """V2 reader: the last committed refresh (a few looks at the log, no job)."""
    now = manifest.current(spark, root)
    if not now.number:
        raise FileNotFoundError(f"no committed snapshot under {root}")
    return _read(spark, now)


def materialise(df: DataFrame, root: str, keys: list[str]) -> int:
    """V1/V2/K3: write a new version, check its key, then publish it.

    Returns the committed version number. On a key violation the version is
    left unpublished (readers never see it) and ``KeyViolation`` is raised.
    """
    spark = df.sparkSession
    path = manifest.new_folder(root, DATA)
    df.write.mode("errorifexists").parquet(path)
    check = key_violations(spark.read.schema(df.schema).parquet(path), keys).first()
    if check["duplicate_keys"] or check["null_keys"]:
        raise KeyViolation(
            f"unique key {keys} violated in {path}: {check['duplicate_keys']} duplicated, "
            f"{check['null_keys']} null rows; version not published")
    return manifest.commit(spark, root, lambda _: {DATA: [path]}, rows=int(check["rows"]))


def refresh_all(marts: dict[str, tuple[DataFrame, list[str]]], root: str,
                parallel: bool = True) -> dict[str, int]:
    """V5: refresh every mart snapshot; returns the committed versions.

    The marts are independent (separate roots and version logs), so their
    jobs are submitted from concurrent driver threads and share the cluster;
    a failure in one still raises after the others finish.
    """
    def one(item):
        name, (df, keys) = item
        return name, materialise(df, f"{root.rstrip('/')}/{name}", keys)

    if not parallel or len(marts) < 2:
        return dict(map(one, marts.items()))
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=len(marts)) as pool:
        return dict(pool.map(one, marts.items()))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """V4: inserted / updated / deleted rows between two snapshots by key.

    A full outer join on the key (one shuffle of each side on the key), with
    a null-safe comparison of every non-key column; unchanged rows drop out.
    """
    values = [c for c in new.columns if c not in keys]
    o = old.select(*[F.col(k).alias(f"_ok_{k}") for k in keys],
                   *[F.col(c).alias(f"_o_{c}") for c in values], F.lit(True).alias("_in_old"))
    n = new.select(*[F.col(k).alias(f"_nk_{k}") for k in keys],
                   *[F.col(c).alias(f"_n_{c}") for c in values], F.lit(True).alias("_in_new"))
    match = None
    for k in keys:  # null-safe: a NULL key matches a NULL key
        c = F.col(f"_ok_{k}").eqNullSafe(F.col(f"_nk_{k}"))
        match = c if match is None else match & c
    same = F.lit(True)
    for c in values:
        same = same & F.col(f"_o_{c}").eqNullSafe(F.col(f"_n_{c}"))
    change = (F.when(F.col("_in_old").isNull(), "inserted")
              .when(F.col("_in_new").isNull(), "deleted")
              .when(~same, "updated"))
    return (o.join(n, match, "full_outer")
            .select(*[F.when(F.col("_in_new").isNotNull(), F.col(f"_nk_{k}"))
                      .otherwise(F.col(f"_ok_{k}")).alias(k) for k in keys],
                    change.alias("change_type"))
            .where(F.col("change_type").isNotNull()))
