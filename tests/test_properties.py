"""Property tests: the scalable G1 plans equal their single-task definitions."""

from __future__ import annotations

import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window, functions as F

from marketlens.operators import ranking

SETTINGS = settings(max_examples=4, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

rows_strategy = st.lists(
    st.tuples(st.integers(0, 5), st.integers(0, 20), st.integers(-50, 50)),
    min_size=1, max_size=120)


@SETTINGS
@given(rows=rows_strategy, hot=st.integers(0, 5))
def test_prefix_scan_equals_window(spark, rows, hot):
    # make one key hot, give every row a unique order id
    data = [((hot if i % 2 else k), day, i, v) for i, (k, day, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "k long, day long, oid long, v long")
    w = Window.partitionBy("k").orderBy("day", "oid")
    every = Window.partitionBy("k")
    plain = df.select("oid", F.row_number().over(w).cast("long").alias("rn"),
                      F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"),
                      F.sum("v").over(every).alias("tot"), F.count("*").over(every).alias("cnt"))
    out = ranking.prefix_scan(df, ["k"], {"_day": F.col("day")}, ["day", "oid"], rank_col="rn",
                              running={"cum": "v"}, totals={"tot": "v"}, counts="cnt")
    assert sorted(map(tuple, out.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))


@SETTINGS
@given(ids=st.sets(st.integers(1, 10_000), min_size=1, max_size=200), salt=st.text(min_size=0, max_size=6),
       digits=st.sampled_from([(1,), (3, 2), (1, 1, 2)]))
def test_hash_rank_equals_sorted_position(spark, ids, salt, digits):
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    got = {r.id: r["rank"] for r in ranking.rank_by_hash(df, "id", salt, digits=digits).collect()}
    order = sorted(ids, key=lambda i: (hashlib.md5(f"{salt}{i}".encode()).hexdigest(), i))
    assert got == {i: pos for pos, i in enumerate(order, start=1)}
