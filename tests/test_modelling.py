"""L1-L7, L14-L16 on a small synthetic feature table."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from marketlens.operators import metrics, modelling


@pytest.fixture(scope="module")
def feats(spark):
    rows = []
    for i in range(1, 401):
        churned = 1 if i % 5 == 0 else 0
        orders = 2 + (i % 7) - churned
        rows.append((i, ["seo", "email", "referral"][i % 3], 100 + i, orders, 50.0 * orders,
                     50.0, i % 30, orders / (100 + i), 10 + 90 * churned + i % 5, churned))
    return spark.createDataFrame(rows, "customer_id long, channel string, tenure_days long, "
                                       "total_orders long, total_revenue double, avg_order_value double, "
                                       "first_order_gap_days long, order_frequency double, "
                                       "days_since_last_order long, churned int")


def test_stratified_split_exact_shares(spark, feats):
    split = modelling.stratified_split(feats)
    counts = {(r.churned, r.split): r["count"] for r in split.groupBy("churned", "split").count().collect()}
    assert counts[(1, "test")] == math.ceil(0.25 * 80) and counts[(0, "test")] == math.ceil(0.25 * 320)
    again = modelling.stratified_split(feats)
    assert split.exceptAll(again).count() == 0


@pytest.mark.parametrize("sizes, fraction, want", [
    ({0: 183, 1: 17}, 0.25, {0: 46, 1: 4}), ({0: 150, 1: 51}, 0.25, {0: 38, 1: 13}), ({0: 3, 1: 3, 2: 3}, 0.25, {0: 1, 1: 1, 2: 1}),
    ({0: 5, 1: 5}, 0.25, {0: 2, 1: 1}), ({0: 1, 1: 1}, 0.25, {0: 1, 1: 0}), ({0: 7}, 0.5, {0: 4}), ({0: 6, 1: 4}, 0.0, {0: 0, 1: 0})])
def test_split_apportions_the_test_rows_by_largest_remainder(spark, sizes, fraction, want):
    rows = [(1000 * c + i, c) for c, n in sizes.items() for i in range(n)]
    split = modelling.stratified_split(spark.createDataFrame(rows, "customer_id long, churned int"), test_fraction=fraction)
    got = {r.churned: r.n for r in split.groupBy("churned").agg(F.sum((F.col("split") == "test").cast("int")).alias("n")).collect()}
    assert got == want and sum(want.values()) == math.ceil(fraction * len(rows))


def test_class_weights_balanced(spark, feats):
    w = {r.churned: (r.class_count, r.weight) for r in modelling.class_weights(feats).collect()}
    assert w[1] == (80, 400 / (2 * 80)) and w[0] == (320, 400 / (2 * 320))


def test_standardizer_uses_population_std(spark, feats):
    stats = modelling.fit_standardizer(feats, ["tenure_days"])
    scaled = modelling.apply_standardizer(feats, stats, ["tenure_days"])
    agg = scaled.agg(F.avg("tenure_days_scaled"), F.stddev_pop("tenure_days_scaled")).first()
    assert agg[0] == pytest.approx(0.0, abs=1e-12) and agg[1] == pytest.approx(1.0)


def test_unseen_channel_encodes_as_zeros(spark, feats):
    model = modelling.fit_one_hot(feats)
    probe = spark.createDataFrame([(1, "email"), (2, "tv")], "customer_id long, channel string")
    out = {r.channel: (r.onehot_index, r.onehot_size) for r in modelling.one_hot_positions(model, probe).collect()}
    assert out == {"email": (0, 3), "tv": (None, 3)}


def test_models_fit_score_and_report(spark, feats, tmp_dir):
    split = modelling.stratified_split(feats)
    train, others = modelling.prepare(split.where("split = 'train'"), {"test": split.where("split = 'test'")})
    lr = modelling.fit_logistic(train, max_iter=200)
    scored = modelling.score(lr, others["test"])
    assert scored.count() == 100 and scored.columns == ["id", "label", "score", "prediction"]
    auc = metrics.roc_auc(scored).first().roc_auc
    assert auc > 0.5
    rf = modelling.fit_forest(train, num_trees=10, max_depth=5)
    imp = modelling.importance(rf).collect()
    assert len(imp) == 6 + 3 and imp[0].importance >= imp[-1].importance
    assert abs(sum(r.importance for r in imp) - 1.0) < 1e-9
    coefs = modelling.importance(lr).collect()
    assert {r.feature for r in coefs} >= {"tenure_days", "channel_email"}
    runs = f"{tmp_dir}/runs"
    modelling.log_run(runs, "Logistic Regression", auc, None, None)
    modelling.log_run(runs, "Random Forest", None, None, None, n_estimators=10)
    assert spark.read.parquet(runs).count() == 2


def test_prepare_refuses_leaky_features(spark, feats):
    with pytest.raises(ValueError):
        modelling.prepare(feats, features=["tenure_days", "days_since_last_order"])


def test_fit_partitions_follow_the_rows_alone(spark, monkeypatch):
    from marketlens.operators import modelling
    seen = []

    class Counting:
        def __init__(self, stages):
            pass

        def fit(self, df):
            seen.append(df.rdd.getNumPartitions())

    monkeypatch.setattr(modelling, "Pipeline", Counting)
    parts = 4 * spark.sparkContext.defaultParallelism + 3
    modelling._fit([], spark.range(10), rows=parts * modelling.ROWS_PER_PARTITION)
    assert seen == [parts]


def test_a_fit_is_dealt_to_several_tasks():
    """From some ten thousand rows on; more tasks than a small cluster has only for large tables."""
    parts = [modelling.fit_partitions(n) for n in (0, 1, 10_000, 67_500, 675_000, 4_050_000)]
    assert parts == [1, 1, 1, 7, 12, 41]
