"""G1: bucketed ranks and prefix sums equal their single-task definitions."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from marketlens.operators import ranking


def test_rank_by_hash_matches_global_sort(spark):
    ids = list(range(1, 3001))
    df = spark.createDataFrame([(i, i % 3) for i in ids], "id long, grp long")
    out = {(r.grp, r.id): (r["rank"], r.size) for r in
           ranking.rank_by_hash(df, "id", "salt", by=["grp"], size_col="size").collect()}
    for g in range(3):
        members = sorted((hashlib.md5(f"salt{i}".encode()).hexdigest(), i) for i in ids if i % 3 == g)
        for pos, (_, i) in enumerate(members, start=1):
            assert out[(g, i)] == (pos, len(members))


def test_ordered_prefix_matches_brute_force(spark):
    rng = random.Random(3)
    vals = sorted({round(rng.random(), 3) for _ in range(900)} | {0.0, -0.5, -3.25, 1e-300, -1e-300, 5e-324, 1e300,
                                                                  float("inf"), float("-inf"), 1.0, 2.0, -2.0}
                  | {0.7 + k * 1e-9 for k in range(200)} | {-k for k in range(1, 40)})
    rows = [(float(v), rng.randint(0, 5)) for v in vals]
    df = spark.createDataFrame(rows, "s double, w long").repartition(5)
    for descending in (True, False):
        ahead = (lambda s, v: s > v) if descending else (lambda s, v: s < v)
        incl = {r.s: r.a for r in ranking.ordered_prefix(df, "s", {"a": "w"}, descending=descending).collect()}
        out = ranking.ordered_prefix(df, "s", {"a": "w"}, descending=descending, inclusive=False, totals={"t": "w"})
        excl = {r.s: (r.a, r.t) for r in out.collect()}
        for v, w in rows:
            before = sum(x for s, x in rows if ahead(s, v))
            assert excl[v] == (before, sum(x for _, x in rows)) and incl[v] == before + w


def test_number_levels_never_fall_and_split_crowded_scores(spark):
    rng = random.Random(1)
    vals = sorted({rng.uniform(-1, 1) * 10 ** rng.randint(-300, 300) for _ in range(2000)}
                  | {2.0 ** k * (1 + d * 2 ** -52) for k in range(-60, 60) for d in (-1, 0, 1)}
                  | {0.9 + i * 1e-7 for i in range(500)} | {0.0, float("inf"), float("-inf")})
    levels = ranking.number_levels(F.col("s"))
    out = (spark.createDataFrame([(v,) for v in vals], "s double").withColumns(levels).collect())
    tags = [(r["_e"], r["_m"]) for r in sorted(out, key=lambda r: r.s)]
    assert tags == sorted(tags)
    crowded = {(r["_e"], r["_m"]) for r in out if 0.9 <= r.s < 0.90005}
    assert len(crowded) > 50


def brute_scan(rows):
    """(k, day, oid, v) -> (row number, running sum, total, count), NULL while no value was seen."""
    none_first = lambda x: (x is not None, x or 0)
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (none_first(r[1]), none_first(r[2])))
        total = None
        for r in own:
            total = total if r[3] is None else (total or 0) + r[3]
        run = None
        for n, r in enumerate(own, 1):
            run = run if r[3] is None else (run or 0) + r[3]
            out[(r[0], r[2])] = (n, run, total, len(own))
    return out


def scan(df, levels):
    out = ranking.prefix_scan(df, ["k"], levels, ["day", "oid"], rank_col="rn", running={"cum": "v"},
                              totals={"tot": "v"}, counts="cnt")
    assert set(out.columns) == {"k", "day", "oid", "v", "rn", "cum", "tot", "cnt"}
    return {(r.k, r.oid): (r.rn, r.cum, r.tot, r.cnt) for r in out.collect()}


def level_sets():
    return [{"_day": F.col("day")}, {"_week": F.floor(F.col("day") / 7), "_day": F.col("day")},
            {"_day": F.col("day"), "_ids": F.floor(F.col("oid") / 16)}]


def test_prefix_scan_on_a_key_with_a_third_of_all_rows(spark):
    rng = random.Random(11)
    rows = [(1 if n % 3 == 0 else rng.randint(2, 60), rng.randint(0, 40), n, rng.choice([None, 1, 5, -3]))
            for n in range(1500)]
    rows += [(70, 1, 5000, None), (70, 2, 5001, None), (None, 3, 5002, 4), (None, 1, 5003, None), (None, None, 5004, 2),
             (71, None, 5005, 1), (71, 0, 5006, 2)]
    df = spark.createDataFrame(rows, "k long, day long, oid long, v long").repartition(6)
    want = brute_scan(rows)
    for levels in level_sets():
        assert scan(df, levels) == want


def test_prefix_scan_of_nothing_and_with_extra_columns(spark):
    schema = "k long, day long, oid long, v long"
    assert scan(spark.createDataFrame([], schema), {"_day": F.col("day")}) == {}
    rows = [(1, 1, 1, 5), (2, 1, 2, 6), (None, 1, 3, 7)]
    names = spark.createDataFrame([(1, "one")], "k long, name string")
    out = ranking.prefix_scan(spark.createDataFrame(rows, schema), ["k"], {"_day": F.col("day")}, ["day", "oid"],
                              extra=names, running={"cum": "v"}).collect()
    assert [(r.k, r.name, r.cum) for r in out] == [(1, "one", 5)]  # keys that the names don't know drop out


def test_scan_builds_one_plan_without_jobs(spark):
    """No job, sample or checkpoint while the plan is built; rows are shuffled by key and segment."""
    df = spark.range(1000).selectExpr("id % 7 AS k", "id % 11 AS day", "id AS oid", "id AS v")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("scan-plan", "plan only")
    ranking.prefix_scan(df, ["k"], {"_day": F.col("day")}, ["day", "oid"], rank_col="rn", running={"cum": "v"})
    ranking.ordered_prefix(df.select("oid", "v"), "oid", {"cum": "v"})
    assert not tracker.getJobIdsForGroup("scan-plan")
    spark.sparkContext.setJobGroup("", "")


def test_rank_by_hash_and_prefix_keep_null_groups(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 0), (None, 0)], "id long, grp long")
    out = ranking.rank_by_hash(df, "id", "s", by=["grp"], size_col="size").collect()
    assert len(out) == 4
    assert sorted(r["rank"] for r in out if r.grp is None) == [1, 2]
    assert sorted(r.size for r in out) == [2, 2, 2, 2]
    scores = spark.createDataFrame([(None, 1), (0.5, 2), (0.7, 3)], "s double, w long")
    pref = ranking.ordered_prefix(scores, "s", {"cum": "w"}).collect()
    assert {r.s: r.cum for r in pref} == {0.7: 3, 0.5: 5, None: 6}
