"""Exact top-k search by tiled matrix products.

Queries and candidates are dealt into blocks by a hash of their id; a tile is one
query block against one candidate shard. A tile multiplies two bounded integer
matrices, keeps each query's best k by partial selection, and the per-query lists
are merged up a two-level tree. Tile sizes follow from the row counts, so a task's
memory does not depend on the size of the input.

Defined cases: a vector that is null, or that holds a null or non-finite
component, takes no part; rows that repeat an id count once, with the smallest
vector; ids that are null take no part; vectors of different length are never
compared; a component beyond the range of a long saturates, and so does a score.
An empty table gives an empty result. Extra columns, of any name, never reach the operator.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

TILE_SCHEMA = "query_id long, vec_id long, score long, shard int"
_LONG = np.iinfo(np.int64)


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = 1024) -> DataFrame:
    """(id, v): floor(scale * x) of every component of the vectors that take part."""
    inf = float("inf")
    ok = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    v = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return (df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ok)
            .select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
            .groupBy("id").agg(F.min("v").alias("v")))


def _matrix(t: pa.Table, name: str) -> np.ndarray:
    flat = t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(t.num_rows, -1) if t.num_rows else flat.reshape(0, 0)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products; float64 BLAS only while every partial sum is exact."""
    if q.shape[1] == 0:
        return np.zeros((len(q), len(c)), dtype=np.int64)
    top = float(np.abs(q.astype(np.float64)).max()) * float(np.abs(c.astype(np.float64)).max()) * q.shape[1]
    if top < 2.0 ** 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if top < 2.0 ** 62:
        return q @ c.T
    return np.clip(q.astype(object) @ c.astype(object).T, _LONG.min, _LONG.max).astype(np.int64)


def _tile(k: int):
    def run(queries: pa.Table, shard: pa.Table) -> pa.Table:
        out = ([], [], [])
        no = shard.column("c_shard")[0].as_py() if shard.num_rows else 0
        if queries.num_rows and shard.num_rows:
            ids = shard.column("c_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, c = ids[order], _matrix(shard, "c_v")[order]
            scores = _scores(_matrix(queries, "v"), c)
            for qid, row in zip(queries.column("id").to_pylist(), scores):
                # Partial selection: one more than k, as the query's own row may be among them.
                if len(row) > k + 1:
                    edge = np.partition(row, len(row) - k - 1)[len(row) - k - 1]
                    at = np.flatnonzero(row >= edge)
                else:
                    at = np.arange(len(row))
                at = at[ids[at] != qid]
                at = at[np.argsort(-row[at].astype(object) if row.min() == _LONG.min else -row[at], kind="stable")][:k]
                out[0].append(np.full(len(at), qid, dtype=np.int64))
                out[1].append(ids[at])
                out[2].append(row[at])
        cat = [np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in out]
        return pa.table({"query_id": cat[0], "vec_id": cat[1], "score": cat[2],
                         "shard": pa.array(np.full(len(cat[0]), no, dtype=np.int32))})
    return run


def exact_topk(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vec_col: str = "embedding",
               k: int = 10, scale: int = 1024, query_block: int = 1024, shard_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of every query.

    ``is_query`` marks the query rows by the column ``id``; candidates are all rows
    but the query's own, ties go to the smaller id. ``query_block`` and
    ``shard_rows`` are the mean tile sides.
    """
    v = integer_vectors(vectors, id_col, vec_col, scale)
    n, n_q = (vectors.select(F.col(id_col).cast("long").alias("id"))
              .agg(F.count("*"), F.count(F.when(is_query, 1))).first())
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(n_q / query_block))
    at = lambda parts, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    queries = v.where(is_query).withColumn("dim", F.size("v")).withColumn("block", at(blocks, 1)) \
        .withColumn("shard", each(shards))
    cands = (v.withColumn("dim", F.size("v")).withColumn("shard", at(shards, 2)).withColumn("block", each(blocks))
             .select(*[F.col(c).alias(f"c_{c}") for c in ("block", "shard", "dim", "id", "v")]))
    lists = (queries.groupBy("block", "shard", "dim").cogroup(cands.groupBy("c_block", "c_shard", "c_dim"))
             .applyInArrow(_tile(k), TILE_SCHEMA))
    fan = max(1, math.isqrt(shards))
    best = F.col("score").desc(), F.col("vec_id")
    inner = Window.partitionBy("query_id", F.col("shard") % fan).orderBy(*best)
    merged = lists.withColumn("r", F.row_number().over(inner)).where(F.col("r") <= k)
    outer = Window.partitionBy("query_id").orderBy(*best)
    return (merged.withColumn("rank", F.row_number().over(outer)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
