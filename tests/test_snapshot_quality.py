"""V1-V5, K3 snapshots and Q1-Q5 data-quality checks."""

from __future__ import annotations

import datetime as dt

import pytest
from helpers import make_customers
from pyspark.sql import functions as F

from marketlens.operators import quality, snapshot
from marketlens.sources.staging import EXPERIMENT


def test_materialise_publish_read_and_refuse(spark, tmp_dir):
    root = f"{tmp_dir}/mart"
    v1 = snapshot.materialise(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), root, ["k"])
    v2 = snapshot.materialise(spark.createDataFrame([(1, "a"), (3, "c")], "k long, v string"), root, ["k"])
    assert (v1, v2) == (1, 2)
    assert sorted(r.k for r in snapshot.read_current(spark, root).collect()) == [1, 3]
    with pytest.raises(snapshot.KeyViolation):
        snapshot.materialise(spark.createDataFrame([(5, "x"), (5, "y")], "k long, v string"), root, ["k"])
    # readers keep the last good version
    assert snapshot.current_version(spark, root) == 2
    diff = {r.k: r.change_type for r in snapshot.snapshot_diff(
        snapshot.read_version(spark, root, 1), snapshot.read_version(spark, root, 2), ["k"]).collect()}
    assert diff == {2: "deleted", 3: "inserted"}


def test_key_violations_and_diff_updates(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 3), (2, 4)], "k long, v long")
    r = snapshot.key_violations(df, ["k"]).collect()[0]
    assert (r.rows, r.duplicate_keys, r.null_keys) == (4, 1, 1)
    old = spark.createDataFrame([(1, None), (2, 5)], "k long, v long")
    new = spark.createDataFrame([(1, None), (2, 6)], "k long, v long")
    assert [(x.k, x.change_type) for x in snapshot.snapshot_diff(old, new, ["k"]).collect()] == [(2, "updated")]


def test_refresh_all(spark, tmp_dir):
    marts = {"a": (spark.range(5).withColumnRenamed("id", "k"), ["k"]),
             "b": (spark.range(3).select(F.col("id").alias("x"), F.lit(1).alias("y")), ["x", "y"])}
    assert snapshot.refresh_all(marts, tmp_dir) == {"a": 1, "b": 1}
    assert snapshot.refresh_all(marts, tmp_dir) == {"a": 2, "b": 2}


def test_quality_report_flags_each_constraint(spark):
    customers = make_customers(spark, [(1, "seo", "2025-01-01"), (2, "seo", "2025-01-01")])
    sent = dt.date(2025, 6, 1)
    good = spark.createDataFrame([(1, "control", sent, False, None), (2, "treatment", sent, True, sent)],
                                 EXPERIMENT)
    assert {r.check_name: r.violations for r in quality.check_experiment(good, customers).collect()} == {
        "primary_key_unique": 0, "primary_key_null": 0, "foreign_key_customers": 0,
        "variant_domain": 0, "variant_not_null": 0, "sent_at_not_null": 0, "converted_not_null": 0}
    loose = EXPERIMENT.fromJson({**EXPERIMENT.jsonValue(), "fields": [
        {**f, "nullable": True} for f in EXPERIMENT.jsonValue()["fields"]]})
    bad = spark.createDataFrame([(1, "control", sent, False, None), (1, "holdout", None, None, None),
                                 (None, None, sent, True, None), (7, "treatment", sent, True, None)], loose)
    got = {r.check_name: r.violations for r in quality.check_experiment(bad, customers).collect()}
    assert got == {"primary_key_unique": 1, "primary_key_null": 1, "foreign_key_customers": 1,
                   "variant_domain": 1, "variant_not_null": 1, "sent_at_not_null": 1,
                   "converted_not_null": 1}


def test_diff_matches_null_keys(spark):
    old = spark.createDataFrame([(None, 1), (2, 5)], "k long, v long")
    new = spark.createDataFrame([(None, 2), (2, 5), (3, 1)], "k long, v long")
    got = sorted((r.k is None, r.k, r.change_type) for r in snapshot.snapshot_diff(old, new, ["k"]).collect())
    assert got == [(False, 3, "inserted"), (True, None, "updated")]
