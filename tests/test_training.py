"""What makes fitted models right, and the train-evaluate-record flow."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marketlens.operators import metrics, modelling, training, trees


@pytest.fixture(scope="module")
def split(spark):
    rng = random.Random(8)
    rows = []
    for i in range(1, 501):
        orders = rng.randint(1, 30)
        churned = int(rng.random() < 1 / (1 + orders / 6))
        rows.append((i, ["email", "seo", "social", "tv"][i % 4], 100 + rng.randint(0, 400), orders, orders * 50.0 + rng.random(),
                     40 + 20 * rng.random(), rng.randint(0, 60), orders / (100 + i), 10 + 90 * churned, churned))
    feats = spark.createDataFrame(rows, "customer_id long, channel string, tenure_days long, total_orders long, "
                                        "total_revenue double, avg_order_value double, first_order_gap_days long, "
                                        "order_frequency double, days_since_last_order long, churned int")
    return modelling.stratified_split(feats).cache()


@pytest.fixture(scope="module")
def prepared(split):
    train, others = modelling.prepare(split.where("split = 'train'"), {"test": split.where("split = 'test'")})
    return train, others["test"]


def test_logistic_audit_is_zero_at_the_optimum_alone(prepared):
    train, test = prepared
    good = {r.check: r.value for r in training.logistic_audit(modelling.fit_logistic(train), train, test).collect()}
    assert good.pop("test rows") == 125
    assert len(good) == 1 + 6 + 4 + 3 and set(good.values()) == {0.0}
    early = {r.check: r.value for r in training.logistic_audit(modelling.fit_logistic(train, max_iter=1), train, test).collect()}
    assert any(abs(v) > 1e-4 for c, v in early.items() if c.startswith("gradient"))
    assert early["scores off the logistic function"] == early["predictions against the threshold"] == 0


def test_node_table_walks_and_weighs_like_the_model(prepared, tmp_dir):
    train, test = prepared
    model = modelling.fit_forest(train, num_trees=12, max_depth=6)
    audit = {r.check: r.value for r in training.forest_audit(model, test, f"{tmp_dir}/forest").collect()}
    assert audit.pop("test rows") == 125 and len(audit) == 6 + 4 + 2 and set(audit.values()) == {0.0}


def test_node_table_against_plain_python(prepared, tmp_dir):
    train, test = prepared
    model = modelling.fit_forest(train, num_trees=5, max_depth=4)
    nodes = trees.node_table(model, f"{tmp_dir}/forest")
    table = {(r.tree, r.node): r for r in nodes.collect()}
    assert len({t for t, _ in table}) == 5
    inputs = trees.model_inputs(model, test)
    want = {}
    for r in inputs.collect():
        votes = []
        for t in range(5):
            n = table[(t, 0)]
            while n.left != trees.LEAF:
                v = r.x[n.feature]
                left = v <= n.threshold if n.threshold is not None else v in n.left_values
                n = table[(t, n.left if left else n.right)]
            votes.append(n.p1)
        want[r.id] = sum(votes) / 5
    got = {r.id: r.score for r in trees.score_nodes(nodes, inputs, 5, 4).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_leaf_share_bounds_a_tree(prepared, tmp_dir):
    train, _ = prepared
    model = modelling.fit_forest(train, num_trees=4, leaf_share=0.1)
    nodes = trees.node_table(model, f"{tmp_dir}/forest")
    leaves = nodes.where(F.col("left") == trees.LEAF).groupBy("tree").count().agg(F.max("count")).first()[0]
    assert leaves <= 10


def test_train_and_record_builds_the_features_once(spark, split, tmp_dir):
    features = f"{tmp_dir}/features"
    split.drop("split").write.parquet(features)
    root = f"{tmp_dir}/training"
    small = {"num_trees": 5, "max_depth": 4}
    scored = training.train_and_record(spark.read.parquet(features), root, forest=small)
    assert list(scored) == [training.LOGISTIC, training.FOREST]
    for df in scored.values():
        plan = df._jdf.queryExecution().toString()
        assert features not in plan and f"{root}/scores" in plan
    runs = {r.model: r for r in training.read_runs(spark, root).collect()}
    assert len(runs) == 2 and runs[training.FOREST].n_estimators == 5 and runs[training.LOGISTIC].n_estimators is None
    for name, df in scored.items():
        assert runs[name].roc_auc == metrics.roc_auc(df).first()[0]
        assert runs[name].accuracy == metrics.accuracy(df).first()[0] and 0 < runs[name].pr_auc <= 1
    audit = training.run_audit(scored, training.read_runs(spark, root)).collect()
    assert [(r.test_rows, r.roc_auc_gap, r.accuracy_gap, r.pr_auc_in_range) for r in audit] == [(125, 0.0, 0.0, True)] * 2


def test_the_stored_split_is_all_that_fits_read(spark, tmp_dir, split):
    path = f"{tmp_dir}/split"
    stored = training.store(split, path)
    train, others = modelling.prepare(stored.where("split = 'train'"), {"test": stored.where("split = 'test'")})
    for df in (train, others["test"]):
        plan = df._jdf.queryExecution().toString()
        assert path in plan and "InMemoryRelation" not in plan and "InMemoryTableScan" not in plan
