"""A random forest that neither the driver nor a task holds in memory while it is grown.

The algorithm and its settings are Spark ML's: Poisson bootstrap, at most 32
bins an input at weighted quantiles, a fresh choice of inputs at every node,
Gini gain on weighted counts. What differs is who works on what:

* The training rows are dealt by a hash of all their columns and stored as
  blocks of one byte an input (``binned_blocks``), so that the draws depend on
  the rows and the seed alone, not on how the table was laid out.
* A task grows one tree (``_grow``). It copies its bootstrap sample to a
  temporary file and passes over that once a level, in chunks; in memory it has
  a chunk and the histograms of one level's nodes, whatever the number of rows.
* The trees are stored, a row each. The driver reads their importances, and the
  arrays that scoring needs (some 11 bytes a node) only when a table is scored.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.session import scratch_path

MAX_BINS = 32
# Rows of a block on average and at most. A task that grows a tree has one block in memory.
BLOCK_ROWS, BLOCK_LIMIT = 50_000, 65_536
# Points of all blocks' summaries of an input, from which its bins are cut, and of one block's.
SUMMARY_POINTS, LEAST_POINTS, MOST_POINTS = 200_000, 64, 2_048
# A temporary file stays in memory up to this size.
SPOOL_BYTES = 8 << 20
# Nodes whose histograms are searched at once.
NODES_AT_ONCE = 1_024
# Smaller gains and impurities are rounding.
EPSILON = 1e-15
LEAF = -1

BLOCKS = "bucket int, seq int, n int, x binary, y binary, w binary"
TREES = ("tree int, depth int, feature binary, split binary, left binary, gain binary, w0 binary, w1 binary, "
         "importance array<double>")
NODES = ("tree int, node int, feature int, threshold double, left_values array<double>, left int, right int, "
         "gain double, weight double, p0 double, p1 double")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared scratch folder, and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lean(fn):
    """A task's function that gives its memory back at the end; a worker process may idle long after."""
    def run(items):
        try:
            yield from fn(items)
        finally:
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):  # only the C library of Linux has it
                ctypes.CDLL("libc.so.6").malloc_trim(0)
    return run


# ------------------------------------------------------------------ blocks
def _raw_blocks(batches):
    """Rows sorted by bucket -> blocks of at most BLOCK_LIMIT rows of one bucket, the inputs' values one after the other."""
    import pyarrow as pa
    held, rows, bucket, seq = [], 0, None, 0

    def block(parts):
        x, y, w = (np.concatenate([p[k] for p in parts]) for k in range(3))
        return pa.RecordBatch.from_pydict({
            "bucket": pa.array([bucket], pa.int32()), "seq": pa.array([seq], pa.int32()), "n": pa.array([len(y)], pa.int32()),
            "x": pa.array([np.ascontiguousarray(x.T).tobytes()], pa.binary()), "y": pa.array([y.tobytes()], pa.binary()),
            "w": pa.array([w.tobytes()], pa.binary())})

    for batch in batches:
        if not batch.num_rows:
            continue
        found = batch.column("bucket").to_numpy()
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w"))
        if not (np.isin(y, (0.0, 1.0)).all() and (w >= 0).all()):
            raise ValueError("labels must be 0 or 1 and weights must not be negative; found others or nulls")
        y = y.astype(np.uint8)
        ends = [*(np.flatnonzero(np.diff(found)) + 1), batch.num_rows]
        for at, end in zip([0, *ends], ends):
            if found[at] != bucket:
                if rows:
                    yield block(held)
                held, rows, bucket, seq = [], 0, int(found[at]), 0
            while at < end:
                to = min(end, at + BLOCK_LIMIT - rows)
                held.append((x[at:to], y[at:to], w[at:to]))
                rows, at = rows + to - at, to
                if rows == BLOCK_LIMIT:
                    yield block(held)
                    held, rows, seq = [], 0, seq + 1
    if rows:
        yield block(held)


def summary(values: np.ndarray, weights: np.ndarray, points: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order and their weights; beyond ``points`` of them, cells of about equal weight
    with the middle one's value."""
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    values, weights = values[first], np.add.reduceat(weights, first)
    if points is not None and len(values) > points and weights.sum() > 0:
        upto = np.cumsum(weights)
        cell = np.minimum((upto - weights / 2) / upto[-1] * points, points - 1).astype(int)
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        middle = (first + np.r_[first[1:], len(values)]) // 2
        values, weights = values[middle], np.add.reduceat(weights, first)
    return values, weights


def _each(batches):
    """The rows of the batches, one by one, since each is large."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _summaries(inputs: int, numeric: int, points: int):
    def run(batches):
        import pyarrow as pa
        for r in _each(batches):
            x, w = np.frombuffer(r["x"]).reshape(inputs, r["n"]), np.frombuffer(r["w"])
            found = [summary(x[j], w, points) for j in range(numeric)]
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array([r["bucket"]] * numeric, pa.int32()), "seq": pa.array([r["seq"]] * numeric, pa.int32()),
                "input": pa.array(range(numeric), pa.int32()), "points": pa.array([v.tobytes() for v, _ in found], pa.binary()),
                "weights": pa.array([c.tobytes() for _, c in found], pa.binary())})
    return run


def split_points(values: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """Spark ML's split candidates: between all neighbours if there are at most ``most``, else at weighted quantiles."""
    middles = (values[:-1] + values[1:]) / 2
    if len(middles) <= most:
        return middles
    stride = weights.sum() / (most + 1)
    upto, target, found = np.cumsum(weights), stride, []
    for i in range(1, len(values)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            found.append(middles[i - 1])
            target += stride
    return np.array(found)


def _bins(splits: list[np.ndarray]):
    def run(batches):
        import pyarrow as pa
        for r in _each(batches):
            x = np.frombuffer(r["x"]).reshape(len(splits), r["n"])
            r["x"] = np.stack([np.searchsorted(s, v).astype(np.uint8) for s, v in zip(splits, x)], axis=1).tobytes()
            yield pa.RecordBatch.from_pydict({c: pa.array([v], pa.int32() if isinstance(v, int) else pa.binary()) for c, v in r.items()})
    return run


def binned_blocks(rows: DataFrame, inputs: int, numeric: int) -> tuple[DataFrame, list[np.ndarray], float]:
    """(stored blocks of the inputs' bins, the inputs' split points, the weights' sum) of ``rows`` (features, label,
    weight, key).

    A value's bin is the number of split points below it. The first ``numeric``
    inputs are cut at quantiles, the others are two-valued (0 and 1).
    """
    count = rows.count()
    if not count:
        raise ValueError("a forest needs training rows")
    buckets = -(-count // BLOCK_ROWS)
    dealt = (rows.select(F.pmod("key", F.lit(buckets)).cast("int").alias("bucket"), "key",
                         vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"),
                         F.col("weight").cast("double").alias("w"))
             .repartition(buckets, "bucket").sortWithinPartitions("bucket", "key"))
    raw = stored(dealt.select("bucket", "x", "y", "w").mapInArrow(lean(_raw_blocks), BLOCKS), "forest-rows")
    points = min(MOST_POINTS, max(LEAST_POINTS, SUMMARY_POINTS // buckets))
    parts = raw.select("bucket", "seq", "n", "x", "w").mapInArrow(
        lean(_summaries(inputs, numeric, points)), "bucket int, seq int, input int, points binary, weights binary").collect()
    parts.sort(key=lambda r: (r.bucket, r.seq))
    splits = []
    for j in range(inputs):
        if j < numeric:
            mine = [r for r in parts if r.input == j]
            splits.append(split_points(*summary(np.concatenate([np.frombuffer(r.points) for r in mine]),
                                                np.concatenate([np.frombuffer(r.weights) for r in mine])),
                                       min(MAX_BINS, count) - 1))
        else:
            splits.append(np.array([0.5]))
    weight = math.fsum(np.frombuffer(r.weights).sum() for r in parts if r.input == 0)
    return stored(raw.mapInArrow(lean(_bins(splits)), BLOCKS), "forest-bins"), splits, weight


# ------------------------------------------------------------------- trees
class _Chunks:
    """Chunks of rows (bins, class, weight, node) in a temporary file, read in the order of their keys."""

    def __init__(self, inputs: int):
        self.inputs, self.at = inputs, []
        self.file = tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES)

    def add(self, key, x, y, w, node) -> None:
        self.at.append((key, self.file.tell(), len(y)))
        for part in (x, y, w, node):
            self.file.write(part.tobytes())

    def __iter__(self):
        for key, offset, n in sorted(self.at):
            self.file.seek(offset)
            x = np.frombuffer(self.file.read(n * self.inputs), np.uint8).reshape(n, self.inputs)
            yield (key, x, *(np.frombuffer(self.file.read(n * np.dtype(t).itemsize), t) for t in (np.uint8, np.float64, np.int32)))

    def empty(self) -> None:
        self.at = []
        self.file.seek(0)


def _level(rows: _Chunks, to: _Chunks, route, chosen: np.ndarray, bins: int) -> np.ndarray:
    """One pass: rows move to their children, those at leaves stay behind; the class weights per (node, choice, bin)."""
    choices, inputs = chosen.shape[1], rows.inputs
    total = np.zeros(len(chosen) * choices * bins * 2)
    by_choice = [np.ascontiguousarray(chosen[:, j]) for j in range(choices)]
    for key, x, y, w, node in rows:
        if route is not None:
            feature, split, child = route
            value = x.ravel().take(np.arange(0, x.size, inputs) + feature.take(node))
            node = child.take(2 * node + (value > split.take(node)))
            stay = np.flatnonzero(node >= 0)
            if not len(stay):
                continue
            if len(stay) < len(node):
                x, y, w, node = x.take(stay, axis=0), y.take(stay), w.take(stay), node.take(stay)
        to.add(key, x, y, w, node)
        flat, start = x.ravel(), np.arange(0, x.size, inputs)
        base = node.astype(np.int64) * (choices * bins * 2) + y
        for j, feature in enumerate(by_choice):
            code = flat.take(start + feature.take(node)).astype(np.int64)
            code *= 2
            code += base
            code += j * bins * 2
            np.add.at(total, code, w)
    return total.reshape(len(chosen), choices, bins, 2)


def _best_splits(total: np.ndarray, chosen: np.ndarray, n_splits: np.ndarray, least: float):
    """Per node: (gain or 0, input, split, class weights left, right); a child weighs at least ``least``."""
    found = []
    for lo in range(0, len(chosen), NODES_AT_ONCE):
        mine = chosen[lo:lo + NODES_AT_ONCE]
        left = total[lo:lo + NODES_AT_ONCE].cumsum(axis=2)
        whole = left[:, :, -1:]
        right = whole - left
        wl, wr, wt = left.sum(axis=-1), right.sum(axis=-1), whole.sum(axis=-1)
        valid = ((np.arange(total.shape[2]) < n_splits[mine][:, :, None]) & (wl >= least) & (wr >= least) & (wl > 0) & (wr > 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = ((left ** 2).sum(axis=-1) / wl + (right ** 2).sum(axis=-1) / wr - (whole ** 2).sum(axis=-1) / wt) / wt
        gain = np.where(valid, gain, 0.0).reshape(len(mine), -1)
        best = gain.argmax(axis=1)
        every, (choice, split) = np.arange(len(mine)), np.divmod(best, total.shape[2])
        found.append((gain[every, best], mine[every, choice], split, left[every, choice, split], right[every, choice, split]))
    return tuple(np.concatenate(parts) for parts in zip(*found))


def grow(tree: int, blocks, n_splits: np.ndarray, choices: int, seed: int, max_depth: int, least: float):
    """The tree's nodes by level, the root first and siblings side by side, as a row of ``TREES``."""
    inputs, bins = len(n_splits), int(n_splits.max(initial=0)) + 1
    seeds = (seed & (1 << 64) - 1, tree)
    rows, spare = _Chunks(inputs), _Chunks(inputs)
    for b in blocks:
        times = np.random.default_rng([*seeds, b.bucket, b.seq]).poisson(1.0, b.n)
        drawn = np.flatnonzero(times)
        rows.add((b.bucket, b.seq), np.frombuffer(b.x, np.uint8).reshape(b.n, inputs).take(drawn, axis=0),
                 np.frombuffer(b.y, np.uint8).take(drawn), (np.frombuffer(b.w) * times).take(drawn), np.zeros(len(drawn), np.int32))
    choose = np.random.default_rng(seeds)
    levels, weights, opened, route, made, depth = [], None, np.zeros(1, np.int64), None, 1, 0
    while True:
        chosen = choose.random((len(opened), inputs)).argsort(axis=1)[:, :choices]
        total = _level(rows, spare, route, chosen, bins)
        rows.empty()
        rows, spare = spare, rows
        if weights is None:
            weights = total[:, 0].sum(axis=1)  # the root's
        gain, feature, split, left, right = _best_splits(total, chosen, n_splits, least)
        cut = (gain > EPSILON) & (depth < max_depth)
        n, k = len(weights), int(cut.sum())
        level = {"feature": np.full(n, LEAF, np.int16), "split": np.zeros(n, np.uint8), "left": np.full(n, LEAF, np.int32),
                 "gain": np.zeros(n), "weights": weights}
        at = opened[cut]
        level["feature"][at], level["split"][at], level["gain"][at] = feature[cut], split[cut], gain[cut]
        level["left"][at] = made + 2 * np.arange(k)
        levels.append(level)
        if not k:
            break
        depth, made = depth + 1, made + 2 * k
        weights = np.stack([left[cut], right[cut]], axis=1).reshape(2 * k, 2)
        heavy = weights.sum(axis=1)
        mixed = 1.0 - (weights ** 2).sum(axis=1) / heavy ** 2 > EPSILON
        opened = np.flatnonzero(mixed & (heavy >= 2 * least * (1 - 1e-9)) & (depth < max_depth))
        if not len(opened):
            levels.append({"feature": np.full(2 * k, LEAF, np.int16), "split": np.zeros(2 * k, np.uint8),
                           "left": np.full(2 * k, LEAF, np.int32), "gain": np.zeros(2 * k), "weights": weights})
            break
        number = np.full(2 * k, LEAF, np.int32)
        number[opened] = np.arange(len(opened))
        child = np.full((len(cut), 2), LEAF, np.int32)
        child[cut] = number.reshape(k, 2)
        route = (feature, split.astype(np.uint8), child.ravel())
    nodes = {c: np.concatenate([level[c] for level in levels]) for c in levels[0]}
    inner = nodes["left"] != LEAF
    share = np.bincount(nodes["feature"][inner], weights=(nodes["gain"] * nodes["weights"].sum(axis=1))[inner], minlength=inputs)
    if share.sum() > 0:
        share = share / share.sum()
    w0, w1 = np.ascontiguousarray(nodes["weights"].T)
    return (tree, depth, *(bytearray(a.tobytes()) for a in (nodes["feature"], nodes["split"], nodes["left"], nodes["gain"], w0, w1)),
            share.tolist())


def each_with_all(few: DataFrame, all_of: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` over the pairs of each row of ``few`` with every row of ``all_of``, which streams through the tasks of
    ``few``: nothing is shuffled or collected, and neither side is held."""
    pairs = few.rdd.cartesian(all_of.rdd.coalesce(1))
    return few.sparkSession.createDataFrame(pairs.mapPartitions(lean(fn)), schema, verifySchema=False)


def _grow(**plan):
    def run(pairs):
        from itertools import chain
        first = next(pairs, None)
        if first is None:  # no pair, no tree
            return
        yield grow(first[0].tree, chain([first[1]], (b for _, b in pairs)), **plan)
    return run


def fit(rows: DataFrame, num_trees: int, seed: int, max_depth: int, leaf_share: float, inputs: int, numeric: int) -> ForestModel:
    """Fit ``num_trees`` trees to ``rows`` (features, label, weight, key); ``key`` is a 64-bit hash of the whole row."""
    blocks, splits, weight = binned_blocks(rows, inputs, numeric)
    spark = rows.sparkSession
    one_each = spark.range(0, num_trees, 1, num_trees).select(F.col("id").cast("int").alias("tree"))
    plan = dict(n_splits=np.array([len(s) for s in splits]), choices=int(np.ceil(np.sqrt(inputs))), seed=seed,
                max_depth=max_depth, least=leaf_share * weight)
    return ForestModel(stored(each_with_all(one_each, blocks, _grow(**plan), TREES), "forest-trees"), splits, numeric)


# ------------------------------------------------------------------- model
class _Tree:
    """A tree's arrays for scoring; a leaf is its own left child."""

    def __init__(self, r):
        feature, split = np.frombuffer(r.feature, np.int16), np.frombuffer(r.split, np.uint8)
        left, w0, w1 = np.frombuffer(r.left, np.int32), np.frombuffer(r.w0), np.frombuffer(r.w1)
        leaf = left == LEAF
        self.depth = r.depth
        self.feature = np.where(leaf, 0, feature).astype(np.int16)
        self.split = np.where(leaf, 255, split).astype(np.uint8)
        self.left = np.where(leaf, np.arange(len(left)), left).astype(np.int32)
        self.share = np.divide(w1, w0 + w1, out=np.zeros(len(left)), where=leaf & (w0 + w1 > 0))
        self.votes = bool(w0[0] + w1[0] > 0)  # an empty bootstrap sample has no vote

    def scores(self, x: np.ndarray) -> np.ndarray:
        flat, start, node = x.ravel(), np.arange(0, x.size, x.shape[1]), np.zeros(len(x), np.int32)
        for _ in range(self.depth):
            node = self.left.take(node) + (flat.take(start + self.feature.take(node)) > self.split.take(node))
        return self.share.take(node)


def _nodes(splits: list[np.ndarray], numeric: int):
    """Stored trees -> a row per node."""
    def run(batches):
        import pyarrow as pa
        start = np.cumsum([0, *[len(s) for s in splits]])[:-1]
        points = np.r_[np.concatenate(splits), 0.0]  # a leaf's place, never shown
        for r in _each(batches):
            feature, split = np.frombuffer(r["feature"], np.int16).astype(np.int32), np.frombuffer(r["split"], np.uint8)
            left, gain, w0, w1 = (np.frombuffer(r[c], t) for c, t in (("left", np.int32), ("gain", float), ("w0", float), ("w1", float)))
            leaf, weight, n = left == LEAF, w0 + w1, len(left)
            by_value = ~leaf & (feature >= numeric)
            p = [np.divide(w, weight, out=np.zeros(n), where=weight > 0) for w in (w0, w1)]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, r["tree"], np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(feature, mask=leaf),
                pa.array(points.take(np.where(leaf, len(points) - 1, start.take(feature) + split)), mask=leaf | by_value),
                pa.array([[0.0] if b else None for b in by_value], pa.list_(pa.float64())),
                pa.array(left), pa.array(np.where(leaf, LEAF, left + 1).astype(np.int32)), pa.array(gain, mask=leaf),
                pa.array(weight), pa.array(p[0]), pa.array(p[1])], names=[c.split()[0] for c in NODES.split(", ")])
    return run


class ForestModel(Model):
    """A fitted forest: its stored trees (``TREES``) and the inputs' split points."""

    def __init__(self, trees: DataFrame, splits: list[np.ndarray], numeric: int):
        super().__init__()
        self.stored, self.splits, self.numeric = trees, splits, numeric
        known = trees.select("tree", "depth", "importance").collect()
        self.depth, self.getNumTrees = max(r.depth for r in known), len(known)
        total = np.sum([r.importance for r in sorted(known)], axis=0)
        self.featureImportances = Vectors.dense(total / total.sum() if total.sum() > 0 else total)
        self._sent = None

    def nodes(self) -> DataFrame:
        """(tree, node, feature, threshold, left_values, left, right, gain, weight, p0, p1) per node."""
        return self.stored.mapInArrow(lean(_nodes(self.splits, self.numeric)), NODES)

    def _arrays(self):
        """The trees as the workers need them: bounded by the forest, not by any table."""
        if self._sent is None:
            rows = self.stored.select("tree", "depth", "feature", "split", "left", "w0", "w1").toLocalIterator()
            found = [(r.tree, _Tree(r)) for r in rows]
            self._sent = self.stored.sparkSession.sparkContext.broadcast([t for _, t in sorted(found, key=lambda f: f[0])])
        return self._sent

    def _transform(self, dataset: DataFrame) -> DataFrame:
        sent, splits = self._arrays(), self.splits

        def scored(batches):
            for features in batches:
                if not len(features):
                    yield pd.Series([], dtype=object)
                    continue
                x = np.stack(features.to_numpy())
                x = np.stack([np.searchsorted(s, x[:, j]).astype(np.uint8) for j, s in enumerate(splits)], axis=1)
                ones = np.zeros(len(x))
                for tree in sent.value:
                    ones += tree.scores(x)
                zeros = sum(t.votes for t in sent.value) - ones
                yield pd.Series(list(np.stack([zeros, ones], axis=1)))

        @F.pandas_udf("array<double>")
        def votes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            return lean(scored)(batches)

        raw = vector_to_array("rawPrediction")
        total = raw[0] + raw[1]
        return (dataset.withColumn("rawPrediction", array_to_vector(votes(vector_to_array("features"))))
                .withColumn("probability", array_to_vector(F.when(total > 0, F.transform(raw, lambda v: v / total)).otherwise(raw)))
                .withColumn("prediction", (raw[1] > raw[0]).cast("double")))
