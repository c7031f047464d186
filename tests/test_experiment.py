"""X1-X12 against the published golden values (FIXTURES.md A6, A7, §C)."""

from __future__ import annotations

import pytest
from helpers import make_customers, make_orders
from pyspark.sql import functions as F

from marketlens.operators import experiment
from marketlens.sources import manifest
from marketlens.sources.staging import EXPERIMENT


def analyse_one(spark, n1, x1, n2, x2):
    arms = spark.createDataFrame([("e", n1, x1, n2, x2)],
                                 "experiment string, n_control long, x_control long, "
                                 "n_treatment long, x_treatment long")
    return experiment.analyse(arms).collect()[0]


def test_srm_balanced_and_skewed(spark):
    r = analyse_one(spark, 100, 6, 100, 11)
    assert r.srm_chi2 == pytest.approx(0.0) and r.srm_p == pytest.approx(1.0)
    s = analyse_one(spark, 70, 5, 130, 9)
    assert s.srm_chi2 == pytest.approx(18.0) and s.srm_p == pytest.approx(2.2090e-5, rel=1e-3)


def test_golden_values_of_the_published_experiment(spark):
    r = analyse_one(spark, 100, 6, 100, 11)
    assert r.z == pytest.approx(1.26775, abs=1e-5) and r.p_value == pytest.approx(0.20489, abs=1e-5)
    assert r.diff == pytest.approx(0.05)
    assert r.ci_low == pytest.approx(-0.02699, abs=1e-5) and r.ci_high == pytest.approx(0.12699, abs=1e-5)
    assert r.required_n_per_arm == 485 and r.power_now == pytest.approx(0.24353, abs=1e-5)
    assert r.verdict.startswith("NO SHIP (inconclusive)") and r.direction == "positive"


# The inputs and results are the published golden values, which have to match.
def test_hand_computed_z_and_power(spark):
    r = analyse_one(spark, 100, 8, 100, 12)
    assert r.z == pytest.approx(0.9428, abs=1e-3) and r.p_value == pytest.approx(0.3458, abs=1e-3)
    assert r.diff == pytest.approx(0.04) and r.ci_low < 0 < r.ci_high
    assert r.required_n_per_arm == 880 and r.power_now == pytest.approx(0.15400, abs=1e-5)
    big = analyse_one(spark, 880, 70, 880, 106)
    assert big.power_now == pytest.approx(0.80, abs=2e-2)
    assert experiment.expected_power(0.08, 0.12, 880) == pytest.approx(0.79919, abs=1e-5)


def test_degenerate_worse_and_srm_verdicts(spark):
    none = analyse_one(spark, 50, 0, 50, 0)
    assert none.z is None and none.p_value is None and none.significant is False
    assert none.required_n_per_arm is None
    worse = analyse_one(spark, 500, 100, 500, 50)
    assert worse.verdict.startswith("SHIP") and worse.direction == "negative"
    srm = analyse_one(spark, 70, 7, 130, 60)
    assert srm.significant and srm.verdict.startswith("NO SHIP - SRM")


def test_assignment_odd_pool_and_determinism(spark):
    customers = make_customers(spark, [(i, "seo", "2025-01-01") for i in range(1, 6)])
    a = {r.customer_id: r.variant for r in experiment.assign(customers, "salt").collect()}
    assert sorted(a.values()).count("control") == 2 and len(a) == 5
    b = {r.customer_id: r.variant for r in experiment.assign(customers, "salt").collect()}
    assert a == b
    big = make_customers(spark, [(i, "seo", "2025-01-01") for i in range(1, 2001)])
    counts = {r.variant: r["count"] for r in experiment.assign(big, "s2").groupBy("variant").count().collect()}
    assert counts == {"control": 1000, "treatment": 1000}


def test_conversion_window_is_after_send_and_within_14_days(spark):
    customers = make_customers(spark, [(1, "seo", "2025-01-01"), (2, "seo", "2025-01-01"),
                                       (3, "seo", "2025-01-01")])
    orders = make_orders(spark, [(1, 1, "2025-06-15", 5), (2, 2, "2025-06-16", 5),
                                 (3, 3, "2025-06-01", 5), (4, 1, "2025-06-03", 5)])
    assigned = experiment.assign(customers, "s")
    out = {r.customer_id: r for r in
           experiment.attribute_conversions(assigned, orders, "2025-06-01").collect()}
    assert out[1].converted and str(out[1].converted_at) == "2025-06-03"
    assert not out[2].converted and not out[3].converted and out[3].converted_at is None


def _simulated(spark, p1, p2, n, reps, seed):
    """Test-only Bernoulli replicates with known rates."""
    base = spark.range(reps * 2 * n).select(
        (F.col("id") % reps + 1).alias("replicate"),
        F.when((F.col("id") / reps).cast("long") % 2 == 0, "control").otherwise("treatment").alias("variant"),
        F.rand(seed).alias("u"))
    return base.select("replicate", "variant",
                       F.when(F.col("variant") == "control", F.col("u") < p1)
                       .otherwise(F.col("u") < p2).alias("converted"))


def test_empirical_power_matches_theory(spark):
    reps = _simulated(spark, 0.08, 0.12, 300, 500, seed=1)
    empirical = experiment.rejection_rate(reps, ["replicate"]).collect()[0].rejection_rate
    assert empirical == pytest.approx(experiment.expected_power(0.08, 0.12, 300), abs=0.05)
    large = experiment.rejection_rate(_simulated(spark, 0.05, 0.5, 50, 200, seed=0), ["replicate"]).collect()[0]
    assert large.rejection_rate > 0.95


def test_every_outcome_is_in_every_random_split(spark):
    outcomes = spark.range(1, 3001).select(F.col("id").alias("customer_id"), (F.col("id") % 10 == 0).alias("converted"))
    reps = experiment.aa_replicates(outcomes, 100, "aa")
    assert reps.count() == 300_000 and reps.where("converted").count() == 30_000
    rate = experiment.rejection_rate(reps, ["replicate"]).collect()[0]
    assert rate.replicates == 100 and rate.rejection_rate <= 0.15


def test_the_rejection_rate_is_that_of_200_splits(spark):
    from marketlens.plans import catalog
    assert catalog.queries()["replicate_rejection_rate"](spark, "/root/testdata/sf0.001").first().replicates == 200


def test_power_comparison_over_natural_replicates(spark):
    """A/A outcomes by group: few rejections, and the power that the whole experiment's rates give at each size."""
    rows = spark.range(1, 6001).select(
        (F.col("id") % 60).alias("grp"), F.when(F.hash("id") % 2 == 0, "control").otherwise("treatment").alias("variant"),
        (F.xxhash64("id") % 10 == 0).alias("converted"))
    rate = experiment.rejection_rate(rows, ["grp"]).collect()[0]
    assert rate.replicates == 60 and rate.rejection_rate <= 0.15
    cmp = experiment.power_comparison(rows, ["grp"]).collect()[0]
    arms = {r.variant: (r.n, r.x) for r in rows.groupBy("variant").agg(
        F.count("*").alias("n"), F.sum(F.col("converted").cast("int")).alias("x")).collect()}
    p1, p2 = (arms[v][1] / arms[v][0] for v in ("control", "treatment"))
    sizes = [r.n for r in rows.where("variant = 'control'").groupBy("grp").agg(F.count("*").alias("n")).collect()]
    want = sum(experiment.expected_power(p1, p2, n) for n in sizes) / len(sizes)
    assert cmp.replicates == 60 and cmp.theoretical_power == pytest.approx(want, abs=1e-6)
    assert cmp.empirical_power == pytest.approx(rate.rejection_rate)


def test_enrolling_more_customers_moves_nobody(spark, tmp_dir):
    root = f"{tmp_dir}/experiment"
    everyone = make_customers(spark, [(i, "seo", "2025-01-01") for i in range(1, 400)])
    orders = make_orders(spark, [(i, i, "2025-06-05", 5) for i in range(1, 400, 7)])
    assert experiment.read_experiment(spark, root).count() == 0
    arms = {}
    for n, upto in enumerate((1, 8, 9, 120, 121, 399, 399), start=1):
        assert experiment.enrol(everyone.where(F.col("customer_id") <= upto), orders, root, "s", "2025-06-01") == n
        table = experiment.read_experiment(spark, root)
        assert table.schema.fieldNames() == EXPERIMENT.fieldNames()
        now = {r.customer_id: r.variant for r in table.collect()}
        assert len(now) == table.count() == upto and arms.items() <= now.items()
        assert sum(v == "control" for v in now.values()) == upto // 2
        arms = now
    assert {r.customer_id for r in table.where("converted").collect()} == set(range(1, 400, 7))
    first = experiment.assign(everyone.where("customer_id <= 8"), "s").collect()
    grown = experiment.extend_assignment(spark.createDataFrame([], "customer_id long, variant string"),
                                         everyone.where("customer_id <= 8"), "s").collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, grown))


def test_an_enrolment_overtaken_by_another_is_refused(spark, tmp_dir, monkeypatch):
    root = f"{tmp_dir}/experiment"
    customers = make_customers(spark, [(i, "seo", "2025-01-01") for i in range(1, 20)])
    orders = make_orders(spark, [(1, 1, "2025-06-05", 5)])
    plain = experiment.attribute_conversions

    def late(*args, **kwargs):
        monkeypatch.setattr(experiment, "attribute_conversions", plain)
        experiment.enrol(customers, orders, root, "s", "2025-06-01")
        return plain(*args, **kwargs)
    monkeypatch.setattr(experiment, "attribute_conversions", late)
    with pytest.raises(manifest.ConcurrentRefresh):
        experiment.enrol(customers, orders, root, "s", "2025-06-01")
    assert experiment.read_experiment(spark, root).count() == 19


def test_empty_arm_gives_nulls_not_errors(spark):
    r = analyse_one(spark, 0, 0, 10, 2)
    assert r.rate_control is None and r.z is None and r.p_value is None
    assert r.significant is False and r.srm_p is not None and r.srm_p < 0.01
    assert r.verdict.startswith("NO SHIP - SRM")
