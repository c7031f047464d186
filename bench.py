"""Benchmark the headline queries; prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Mirrors the reference's published comparisons: each mart recomputed from
staging ("view") versus read from its stored snapshot ("stored"), and the
channel-month revenue recomputed from orders, aggregated from denormalised
events, and finished from stored partial states. A few heavier operators
(features, experiment report, exact ROC-AUC) are timed too. Every timing is
the median of BENCH_RUNS runs after one warm-up; each run executes the whole
plan into Spark's no-op sink (no collect to the driver). One-time set-up
(writing snapshots, events and states) is excluded and reported separately.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from marketlens.operators import features, marts, metrics, rollup, snapshot  # noqa: E402
from marketlens.plans import catalog  # noqa: E402
from marketlens.session import build_session  # noqa: E402
from marketlens.sources.staging import staged  # noqa: E402


def run_noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def median_time(build, runs: int) -> float:
    run_noop(build())  # warm-up
    samples = []
    for _ in range(runs):
        t0 = time.perf_counter()
        run_noop(build())
        samples.append(time.perf_counter() - t0)
    return statistics.median(samples)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus),
                          extra={"spark.checkpoint.dir": os.environ.get(
                              "BENCH_CHECKPOINT_DIR", tempfile.mkdtemp(prefix="marketlens-bench-"))})
    root = spark.conf.get("spark.checkpoint.dir")

    def s():
        return staged(spark, sf_dir)

    t0 = time.perf_counter()
    st = s()
    snap = {
        "channel_economics": (marts.channel_economics(st["customers"], st["orders"], st["spend"]),
                              ["channel", "spend_month"]),
        "customer_ltv": (marts.customer_ltv(st["customers"], st["orders"]), ["order_id"]),
        "cohort_retention": (marts.cohort_retention(st["customers"], st["orders"]),
                             ["cohort_month", "month_number"]),
    }
    snapshot.refresh_all(snap, f"{root}/snapshots")
    rollup.load_events_and_rollup(st["orders"], st["customers"], f"{root}/load")
    setup = time.perf_counter() - t0

    def stored(name):
        return lambda: snapshot.read_current(spark, f"{root}/snapshots/{name}")

    headline = {
        "channel_economics_view": lambda: (lambda t: marts.channel_economics(
            t["customers"], t["orders"], t["spend"]))(s()),
        "channel_economics_stored": stored("channel_economics"),
        "customer_ltv_view": lambda: (lambda t: marts.customer_ltv(t["customers"], t["orders"]))(s()),
        "customer_ltv_stored": stored("customer_ltv"),
        "cohort_retention_view": lambda: (lambda t: marts.cohort_retention(t["customers"], t["orders"]))(s()),
        "cohort_retention_stored": stored("cohort_retention"),
        "rollup_recompute": lambda: (lambda t: rollup.rollup_from_orders(t["orders"], t["customers"]))(s()),
        "rollup_raw_events": lambda: rollup.rollup_from_events(rollup.read_load(spark, f"{root}/load")[0]),
        "rollup_merged_states": lambda: rollup.merge_states(rollup.read_load(spark, f"{root}/load")[1]),
        "churn_features": lambda: (lambda t: features.build_customer_features(t["customers"], t["orders"]))(s()),
        "experiment_report": lambda: catalog.q_experiment_report(spark, sf_dir),
        "roc_auc": lambda: metrics.roc_auc(catalog._scored(spark, sf_dir)),
    }
    times = {name: round(median_time(fn, runs), 4) for name, fn in headline.items()}
    print(json.dumps({
        "metric": "headline_query_seconds_sum",
        "value": round(sum(times.values()), 4),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "cpus": cpus,
        "runs": runs,
        "setup_sec": round(setup, 3),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
