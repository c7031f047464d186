"""L6/L14 as data: a fitted forest as a table of nodes, scored and weighed by Spark.

``node_table`` stores the forest as one row per node, so that what was learnt
can be queried, compared and audited without the model object. ``score_nodes``
walks every (row, tree) pair down that table, by thresholds where the model
compares bins; ``node_importance`` sums the gains.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from marketlens.operators import forest

LEAF = forest.LEAF
# Rows that one task walks down all trees.
BLOCK_ROWS = 10_000
PACKED = "tree int, width int, feature binary, threshold binary, values binary, left binary, right binary, p0 binary, p1 binary"


def node_table(model: PipelineModel, path: str) -> DataFrame:
    """(tree, node, feature, threshold, left_values, left, right, gain, weight, p0, p1) per node.

    ``feature`` is the input's position; a row goes left if its value is at
    most ``threshold``, or among ``left_values`` where a two-valued input is
    split by category. Leaves have neither, and children of -1.
    """
    model.stages[-1].nodes().write.parquet(path)
    return model.stages[-1].stored.sparkSession.read.schema(forest.NODES).parquet(path)


def model_inputs(model: PipelineModel, df: DataFrame, id_col: str = "customer_id") -> DataFrame:
    """(id, x): the assembled inputs of every row as an array."""
    out = df
    for stage in model.stages[:-1]:
        out = stage.transform(out)
    return out.select(F.col(id_col).alias("id"), vector_to_array("features").alias("x"))


def _packed(group):
    """A tree's rows of the node table, in one row of arrays; children by their place among the rows."""
    import pyarrow as pa
    found = group.sort_by("node")
    node = found["node"].to_numpy()
    given = found["left_values"].to_pylist()
    values = np.full((max(1, max(len(v or ()) for v in given)), len(node)), np.nan)
    for i, mine in enumerate(given):
        values[:len(mine or ()), i] = mine or ()

    def place(side):
        at = np.searchsorted(node, found[side].to_numpy())
        known = node.take(at, mode="clip") == found[side].to_numpy()
        # A leaf stays where it is; a child that is missing leads to a last place without votes.
        return np.where(found["left"].to_numpy() == LEAF, np.arange(len(node)), np.where(known, at, len(node)))
    numbers = {c: found[c].fill_null(0).to_numpy() for c in ("feature", "p0", "p1")}
    arrays = [numbers["feature"].astype(np.int32), found["threshold"].fill_null(np.nan).to_numpy(), values,
              place("left").astype(np.int32), place("right").astype(np.int32), numbers["p0"], numbers["p1"]]
    return pa.table([pa.array([v], k) for v, k in [(int(found["tree"][0].as_py()), pa.int32()), (len(values), pa.int32()),
                                                   *((np.ascontiguousarray(a).tobytes(), pa.binary()) for a in arrays)]],
                    names=[c.split()[0] for c in PACKED.split(", ")])


def _blocks(batches):
    """Rows (id, x) -> (ids in Arrow's stream format, number of rows, values)."""
    import pyarrow as pa
    for batch in batches:
        if batch.num_rows:
            ids = pa.BufferOutputStream()
            with pa.ipc.new_stream(ids, batch.select(["id"]).schema) as out:
                out.write_batch(batch.select(["id"]))
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([ids.getvalue().to_pybytes()], pa.binary()), pa.array([batch.num_rows], pa.int32()),
                                              pa.array([x.tobytes()], pa.binary())], names=["ids", "n", "x"])


def _walk(depth):
    """Pairs of a block and a tree -> every block's votes."""
    def run(pairs):
        votes = {}
        for block, tree in pairs:
            x = np.frombuffer(block.x).reshape(block.n, -1)
            feature, left, right = (np.frombuffer(a, np.int32) for a in (tree.feature, tree.left, tree.right))
            threshold, p0, p1 = (np.frombuffer(a) for a in (tree.threshold, tree.p0, tree.p1))
            values = np.frombuffer(tree.values).reshape(tree.width, -1)
            mine = votes.setdefault(bytes(block.ids), np.zeros((2, block.n)))
            rows, n = np.arange(block.n), np.zeros(block.n, np.int32)
            lost = n < 0
            for _ in range(depth):
                value = x[rows, feature.take(n)]
                goes_left = value <= threshold.take(n)
                for some in values:
                    goes_left |= value == some.take(n)
                n = np.where(goes_left, left.take(n), right.take(n))
                lost |= n == len(p0)
                n[lost] = 0
            mine += np.where(lost, 0.0, [p0.take(n), p1.take(n)])
        for ids, (v0, v1) in votes.items():
            yield ids, v0.tobytes(), v1.tobytes()
    return run


def _unpacked(batches):
    import pyarrow as pa
    for batch in batches:
        for ids, v0, v1 in zip(*(batch.column(k).to_pylist() for k in range(3))):
            for found in pa.ipc.open_stream(ids):
                yield pa.RecordBatch.from_arrays([found.column(0), pa.array(np.frombuffer(v0)), pa.array(np.frombuffer(v1))], names=["id", "v0", "v1"])


def score_nodes(nodes: DataFrame, inputs: DataFrame, trees: int, depth: int) -> DataFrame:
    """(id, score, prediction) of ``inputs`` (id, x): every tree's class shares at the leaf, averaged.

    Each tree's nodes are stored as one row, and streamed past every block of
    rows: all pairs of a row and a tree move down a level at a time, a pair at
    a leaf stays, and only the sums of their votes leave the task. The
    prediction is class 1 if its share is the larger one.
    """
    packed = forest.stored(nodes.where(F.col("tree") < trees).groupBy("tree").applyInArrow(_packed, PACKED), "forest-packed")
    blocks = inputs.repartition(max(1, -(-inputs.count() // BLOCK_ROWS))).select("id", "x").mapInArrow(_blocks, "ids binary, n int, x binary")
    walked = forest.each_with_all(blocks, packed, _walk(depth), "ids binary, v0 binary, v1 binary")
    both = StructType([inputs.schema["id"], StructField("v0", DoubleType()), StructField("v1", DoubleType())])
    votes = walked.mapInArrow(_unpacked, both).groupBy("id").agg(F.sum("v0").alias("v0"), F.sum("v1").alias("v1"))
    return votes.select("id", (F.col("v1") / (F.col("v0") + F.col("v1"))).alias("score"),
                        (F.col("v1") > F.col("v0")).cast("int").alias("prediction"))


def node_importance(nodes: DataFrame, names: list[str]) -> DataFrame:
    """(feature, importance): weighted gains, normalised within each tree, then over the forest."""
    per = (nodes.where(F.col("left") != LEAF).groupBy("tree", "feature")
           .agg(F.sum(F.col("gain") * F.col("weight")).alias("g")))
    shares = per.withColumn("g", F.try_divide("g", F.sum("g").over(Window.partitionBy("tree"))))
    sums = shares.groupBy("feature").agg(F.sum("g").alias("g"))
    every = Window.partitionBy(F.lit(0))  # one row per model input
    spark = nodes.sparkSession
    inputs = spark.createDataFrame(list(enumerate(names)), "feature int, name string")
    return (inputs.join(sums, "feature", "left").withColumn("g", F.coalesce("g", F.lit(0.0)))
            .select(F.col("name").alias("feature"), F.try_divide("g", F.sum("g").over(every)).alias("importance")))
