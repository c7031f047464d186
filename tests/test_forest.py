"""The forest's bins, splits and draws, against plain counting."""

from __future__ import annotations

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketlens.operators import forest, modelling


@pytest.fixture(scope="module")
def train(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1, 401):
        orders = rng.randint(1, 40)
        rows.append((i, ["email", "seo", "tv"][i % 3], 100 + rng.randint(0, 300), orders, orders * 40.0 + rng.random(), 30 + 20 * rng.random(),
                     rng.randint(0, 60), orders / (100 + i), 10, int(rng.random() < 1 / (1 + orders / 8))))
    feats = spark.createDataFrame(rows, "customer_id long, channel string, tenure_days long, total_orders long, total_revenue double, "
                                        "avg_order_value double, first_order_gap_days long, order_frequency double, "
                                        "days_since_last_order long, churned int")
    return modelling.prepare(feats)[0].cache()


def nodes_of(model):
    return sorted(tuple(r) for r in model.stages[-1].nodes().collect())


def block(x, y, w, bucket=0, seq=0):
    return SimpleNamespace(bucket=bucket, seq=seq, n=len(y), x=x.astype(np.uint8).tobytes(), y=y.astype(np.uint8).tobytes(), w=w.astype(float).tobytes())


def sample(n=3_000, seed=3):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 8, n), rng.integers(0, 5, n), rng.integers(0, 2, n)], axis=1)
    y = (rng.random(n) < 0.2 + 0.08 * x[:, 0]).astype(int)
    return x, y, np.where(y == 1, 1.5, 0.75)


PLAN = dict(n_splits=np.array([7, 4, 1]), choices=3, seed=7, max_depth=6, least=20.0)


def unpacked(row):
    feature, split, left, gain, w0, w1 = (np.frombuffer(a, t) for a, t in zip(row[2:8], (np.int16, np.uint8, np.int32, float, float, float)))
    return feature, split, left, gain, np.stack([w0, w1], axis=1)


def test_the_trees_are_stored_and_grown_a_task_each(spark, train):
    model = modelling.fit_forest(train, num_trees=9, max_depth=5).stages[-1]
    assert model.stored.count() == model.getNumTrees == 9 and len(model.stored.inputFiles()) >= 9
    assert not hasattr(model, "_java_obj")  # no forest in the driver's JVM
    few = spark.range(0, 9, 1, 9).select(F.col("id").cast("int").alias("tree"))
    assert few.rdd.cartesian(model.stored.rdd.coalesce(1)).getNumPartitions() == 9


def test_the_forest_follows_from_rows_and_seed_not_from_their_layout(train):
    one = nodes_of(modelling.fit_forest(train, num_trees=4, max_depth=6))
    assert nodes_of(modelling.fit_forest(train.orderBy("total_revenue").repartition(5), num_trees=4, max_depth=6)) == one
    assert nodes_of(modelling.fit_forest(train, num_trees=4, max_depth=6, seed=43)) != one


def test_scores_are_the_trees_mean_shares(train, tmp_dir):
    model = modelling.fit_forest(train, num_trees=5, max_depth=4)
    scored = {r.id: (r.score, r.prediction) for r in modelling.score(model, train).collect()}
    table = {(r.tree, r.node): r for r in model.stages[-1].nodes().collect()}
    from marketlens.operators import trees
    for r in trees.model_inputs(model, train).collect():
        shares = []
        for t in range(5):
            n = table[(t, 0)]
            while n.left != forest.LEAF:
                v = r.x[n.feature]
                n = table[(t, n.left if (v <= n.threshold if n.threshold is not None else v in n.left_values) else n.right)]
            shares.append(n.p1)
        assert abs(scored[r.id][0] - sum(shares) / 5) < 1e-12 and scored[r.id][1] == int(scored[r.id][0] > 0.5)


def test_a_tree_splits_where_plain_counting_does():
    x, y, w = sample()
    drawn = np.random.default_rng([7, 0, 0, 0]).poisson(1.0, len(y))
    feature, split, left, gain, weights = unpacked(forest.grow(0, [block(x, y, w)], **PLAN))
    w = w * drawn

    def gini(rows):
        c = np.array([w[rows & (y == k)].sum() for k in (0, 1)])
        return (1 - ((c / c.sum()) ** 2).sum()) if c.sum() else 0.0, c.sum()

    def check(node, rows, depth):
        assert np.allclose(weights[node], [w[rows & (y == k)].sum() for k in (0, 1)])
        whole, total = gini(rows)
        found = {}
        for f, most in enumerate(PLAN["n_splits"]):
            for s in range(most):
                (gl, wl), (gr, wr) = gini(rows & (x[:, f] <= s)), gini(rows & (x[:, f] > s))
                if min(wl, wr) >= PLAN["least"]:
                    found[f, s] = whole - (wl * gl + wr * gr) / total
        if left[node] == forest.LEAF:
            assert depth == PLAN["max_depth"] or max(found.values(), default=0.0) < 1e-12
            return 1
        assert gain[node] == pytest.approx(max(found.values())) == pytest.approx(found[feature[node], split[node]])
        goes = x[:, feature[node]] <= split[node]
        return check(left[node], rows & goes, depth + 1) + check(left[node] + 1, rows & ~goes, depth + 1)

    assert check(0, np.ones(len(y), bool), 0) > 8


def test_a_tree_is_the_same_from_disk_and_whatever_the_order_of_blocks(monkeypatch):
    x, y, w = sample()
    parts = [block(x[i:i + 500], y[i:i + 500], w[i:i + 500], bucket=i) for i in range(0, 3_000, 500)]
    whole = forest.grow(2, parts, **PLAN)
    monkeypatch.setattr(forest, "SPOOL_BYTES", 1)
    assert forest.grow(2, parts[::-1], **PLAN) == whole
    assert forest.grow(3, parts, **PLAN)[2:] != whole[2:]


def test_a_sample_without_rows_or_of_one_class_is_a_leaf():
    x, y, w = sample(40)
    for labels, weights in ((np.zeros(40), w), (y, np.zeros(40))):
        feature, _, left, _, _ = unpacked(forest.grow(0, [block(x, labels, weights)], **PLAN | {"least": 0.0}))
        assert list(feature) == [forest.LEAF] == list(left)


def test_rows_of_one_bucket_are_cut_into_blocks(monkeypatch):
    monkeypatch.setattr(forest, "BLOCK_LIMIT", 10)
    buckets = [0] * 3 + [2] * 25
    batch = pa.RecordBatch.from_pydict({"bucket": pa.array(buckets, pa.int32()), "x": pa.array([[float(i), 0.0] for i in range(28)]),
                                        "y": pa.array([float(i % 2) for i in range(28)]), "w": pa.array([1.0] * 28)})
    found = [r for b in forest._raw_blocks([batch.slice(0, 9), batch.slice(9)]) for r in b.to_pylist()]
    assert [(r["bucket"], r["seq"], r["n"]) for r in found] == [(0, 0, 3), (2, 0, 10), (2, 1, 10), (2, 2, 5)]
    assert [v for r in found for v in np.frombuffer(r["x"]).reshape(2, -1)[0]] == list(range(28))


@pytest.mark.parametrize("y", [2.0, None])
def test_labels_are_zero_or_one(y):
    batch = pa.RecordBatch.from_pydict({"bucket": pa.array([0], pa.int32()), "x": pa.array([[1.0]]), "y": pa.array([y], pa.float64()), "w": pa.array([1.0])})
    with pytest.raises(ValueError):
        list(forest._raw_blocks([batch]))


def test_split_points_lie_between_values_at_equal_weights():
    assert list(forest.split_points(*forest.summary(np.array([3.0, 1.0, 3.0, 2.0]), np.ones(4)), 31)) == [1.5, 2.5]
    assert list(forest.split_points(*forest.summary(np.array([4.0, 4.0]), np.ones(2)), 31)) == []
    values, weights = forest.summary(np.arange(1000.0), np.ones(1000))
    assert list(forest.split_points(values, weights, 3)) == [249.5, 499.5, 749.5]


def test_a_summary_keeps_the_weights_and_the_quantiles():
    rng = np.random.default_rng(1)
    values, weights = rng.lognormal(size=20_000), rng.random(20_000)
    points, sums = forest.summary(values, weights, 500)
    assert len(points) <= 500 and np.all(np.diff(points) > 0) and sums.sum() == pytest.approx(weights.sum())
    order = np.argsort(values)
    for q in np.arange(1, 32) / 32:
        exact = values[order][np.searchsorted(np.cumsum(weights[order]), q * weights.sum())]
        near = points[np.searchsorted(np.cumsum(sums), q * sums.sum())]
        assert abs((weights[values <= near]).sum() - (weights[values <= exact]).sum()) < weights.sum() / 250


def test_a_level_is_one_pass_over_the_rows_that_are_not_in_leaves(monkeypatch):
    x, y, w = sample()
    read = []
    kept = forest._Chunks.__iter__
    monkeypatch.setattr(forest._Chunks, "__iter__", lambda self: (read.append((id(self), len(c[2]))) or c for c in kept(self)))
    parts = [block(x[i:i + 1000], y[i:i + 1000], w[i:i + 1000], bucket=i) for i in range(0, 3_000, 1000)]
    _, _, left, _, weights = unpacked(forest.grow(1, parts, **PLAN))
    depth, level, sums = 0, [0], []
    while level:  # the rows of a level's pass are those of the level's parents that were not closed
        sums.append(sum(weights[n].sum() for n in level))
        level, depth = [c for n in level if left[n] != forest.LEAF for c in (left[n], left[n] + 1)], depth + 1
    assert sums[0] == pytest.approx(weights[0].sum()) and len(sums) <= PLAN["max_depth"] + 1
    assert len(read) <= 3 * len(sums) and sum(n for _, n in read) <= 3_000 * len(sums)
    assert all(a >= b - 1e-9 for a, b in zip(sums, sums[1:]))


def test_a_tree_on_ten_times_the_rows_needs_no_more_memory(monkeypatch):
    import tracemalloc
    monkeypatch.setattr(forest, "SPOOL_BYTES", 1)

    def peak(blocks):
        tracemalloc.start()
        try:
            forest.grow(0, (block(*sample(5_000, seed), bucket=seed) for seed in range(blocks)), **PLAN | {"least": 50.0 * blocks})
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    peak(1)
    assert peak(50) < 1.5 * peak(5)
