"""Exports and the features data set round trip."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from helpers import make_customers, make_orders


from marketlens.operators import features
from marketlens.sources import io


def test_features_round_trip_through_parquet_and_csv(spark, tmp_dir):
    customers = make_customers(spark, [(1, "seo", "2025-01-01"), (2, "email", "2025-02-01")])
    orders = make_orders(spark, [(1, 1, "2025-03-01", 10.5), (2, 2, "2025-03-02", 7.25),
                                 (3, 2, "2025-04-02", 1.0)])
    feats = features.build_customer_features(customers, orders)
    io.write_features(feats, f"{tmp_dir}/features", csv_path=f"{tmp_dir}/features_csv")
    back = io.read_features(spark, f"{tmp_dir}/features")
    csv = io.read_features_csv(spark, f"{tmp_dir}/features_csv")
    cols = features.FEATURE_COLUMNS
    assert back.select(*cols).exceptAll(feats.select(*cols)).count() == 0
    assert sorted(tuple(r) for r in csv.select(*cols).collect()) == \
        sorted(tuple(r) for r in feats.select(*cols).collect())


def test_export_marts_single_file_option(spark, tmp_dir):
    df = spark.range(10).withColumnRenamed("id", "k")
    io.export_marts({"small": df, "wide": df}, tmp_dir, single_file_for={"small"})
    small = spark.read.option("header", True).csv(f"{tmp_dir}/small")
    assert small.count() == 10 and small.columns == ["k"]
    assert small.rdd.getNumPartitions() == 1
    io.export_csv(df, f"{tmp_dir}/small")   # replaces, does not append
    assert spark.read.option("header", True).csv(f"{tmp_dir}/small").count() == 10


def test_csv_keeps_types_nulls_and_awkward_texts(spark, tmp_dir):
    rows = [("a,b", Decimal("1.10"), dt.date(2025, 1, 31), 1.5, 3, True), ('say "x"', Decimal("-0.01"), None, None, None, None),
            ("", None, dt.date(1999, 12, 31), float("inf"), -1, False), (None, Decimal("99999999.99"), dt.date(2024, 2, 29), 0.1, 0, True),
            ("  padded  ", None, None, 1e-300, 2**62, None), ("back\\slash", None, None, None, None, None), ("NULL", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "t string, m decimal(12,2), d date, x double, n long, b boolean")
    io.export_csv(df, f"{tmp_dir}/awkward")
    back = io.read_csv(spark, f"{tmp_dir}/awkward", df.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert tuple(io.round_trip_gaps(df, back).first()) == (len(rows), 0, 0)
    assert tuple(io.round_trip_gaps(df, back.where("n is null or n > 0")).first())[1] > 0


def test_csv_that_breaks_its_schema_fails(spark, tmp_dir):
    io.export_csv(spark.createDataFrame([("x",)], "n string"), f"{tmp_dir}/bad")
    with pytest.raises(Exception, match="MALFORMED"):
        io.read_csv(spark, f"{tmp_dir}/bad", spark.createDataFrame([], "n long").schema).collect()


def test_views_answer_sql(spark):
    io.register_views({"mart_test_view": spark.range(4)})
    assert spark.sql("SELECT SUM(id) FROM mart_test_view").first()[0] == 6
    io.register_views({"mart_test_view": spark.range(3)})
    assert spark.sql("SELECT SUM(id) FROM mart_test_view").first()[0] == 3


def test_round_trip_gaps_count_repeated_rows_and_read_each_side_once(spark, tmp_dir):
    for name, rows in (("a", [(1, "x"), (1, "x"), (None, None)]), ("b", [(1, "x"), (None, None), (None, None), (2, "y")])):
        spark.createDataFrame(rows, "n long, t string").write.parquet(f"{tmp_dir}/{name}")
    a, b = (spark.read.schema("n long, t string").parquet(f"{tmp_dir}/{name}") for name in "ab")
    gaps = io.round_trip_gaps(a, b)
    assert tuple(gaps.first()) == (3, 1, 2) and tuple(io.round_trip_gaps(a.limit(0), b.limit(0)).first()) == (0, 0, 0)
    assert gaps._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2


def test_the_export_query_builds_every_mart_once(spark):
    from marketlens.plans import catalog
    out = catalog.queries()["export_round_trip"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().toString()
    assert "orders.parquet" not in plan and "Window" not in plan
