"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import pytest

import __spark_entry__ as entry_mod

SF = os.environ.get("MARKETLENS_TEST_SF", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
# The forest fits (300 trees) are exercised in test_modelling and test_training.
SLOW = {"forest_importance"}


def _norm(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def _sorted(rows):
    return sorted((tuple(_norm(x) for x in r) for r in rows),
                  key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip(f"{SF} not present")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0 and "romi" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())


@pytest.mark.parametrize("name", sorted(set(entry_mod.queries()) - SLOW))
def test_query_matches_oracle(spark, duck, name):
    df = entry_mod.queries()[name](spark, SF)
    rows = df.collect()
    sql = entry_mod.oracle_sql().get(name)
    if sql is None:
        assert len(df.columns) > 0
        return
    rel = duck.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    spark_rows = [[r[c] for c in cols] for r in rows]
    duck_idx = [rel.columns.index(c) for c in cols]
    duck_rows = [[r[i] for i in duck_idx] for r in rel.fetchall()]
    assert _sorted(spark_rows) == _sorted(duck_rows)


SURVEY_NAMES = """channel_economics customer_ltv cohort_retention channel_summary ltv_curve
retention_matrix channel_romi_ranking revenue_per_spend first_order_payback mean_retention_curve
steepest_retention_drop channel_spend_share order_events orphan_orders rollup_from_orders
rollup_from_events rollup_merged rollup_streamed rollup_consistency snapshot_key_check snapshot_diff
quality_report churn_features churn_summary censoring_check experiment_assignment
experiment_conversion experiment_arms experiment_report replicate_rejection_rate power_comparison
stratified_split class_weights scaled_features one_hot_channel roc_auc average_precision roc_curve
confusion_matrix classification_report accuracy logistic_scores forest_importance""".split()


def test_registry_matches_survey_names():
    assert len(SURVEY_NAMES) == 43
    optional = {n for n in entry_mod.queries() if n == "pipeline" or n.startswith("op") and n[2].isdigit()}
    core = set(entry_mod.queries()) - optional
    assert set(SURVEY_NAMES) <= core
    # The two model fits; logistic_audit, forest_audit and model_runs check what makes them right.
    assert sorted(core - set(entry_mod.oracle_sql())) == ["forest_importance", "logistic_scores"]
