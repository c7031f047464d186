"""J5, J7, R1-R6, K4, K5 (FIXTURES.md A3, A4 and the replay/reload cases)."""

from __future__ import annotations

import datetime as dt
import uuid

import pytest
from helpers import make_customers, make_orders

from marketlens.operators import rollup
from marketlens.sources import manifest
from marketlens.streaming import rollup_stream


def test_order_events_denormalise_channel_in_column_order(spark):
    who = {7: "email", 8: "seo", 9: "email"}
    customers = make_customers(spark, [(c, channel, "2023-06-15") for c, channel in who.items()])
    orders = make_orders(spark, [(500 + k, 7 + k % 3, f"2024-0{1 + k}-28", 3.5 * k) for k in range(7)])
    out = rollup.order_events(orders, customers)
    assert out.columns == rollup.EVENT_COLUMNS
    rows = out.collect()
    assert len(rows) == 7 and all(r.channel == who[r.customer_id] for r in rows)


def test_orders_of_unknown_customers_are_reported_not_loaded(spark):
    customers = make_customers(spark, [(c, "email", "2023-06-15") for c in (7, 8)])
    orders = make_orders(spark, [(k, 7 + k % 4, "2024-02-29", 12.25) for k in range(12)])
    loaded = {r.order_id for r in rollup.order_events(orders, customers).collect()}
    reported = {r.order_id for r in rollup.orphan_orders(orders, customers).collect()}
    assert loaded == {k for k in range(12) if k % 4 < 2} and reported == set(range(12)) - loaded


def _fixture(spark):
    customers = make_customers(spark, [(i, ["seo", "email", "referral"][i % 3], "2025-01-01")
                                       for i in range(1, 40)])
    orders = make_orders(spark, [(n, 1 + n % 39, str(dt.date(2025, 1, 1) + dt.timedelta(days=n % 200)),
                                  10 + (n * 7) % 90) for n in range(1, 600)])
    return orders, customers


def collected(df):
    return sorted(tuple(r) for r in df.collect())


def test_three_ways_agree_and_reload_is_idempotent(spark, tmp_dir):
    orders, customers = _fixture(spark)
    root = f"{tmp_dir}/load"
    assert rollup.load_events_and_rollup(orders, customers, root) == 1
    assert rollup.load_events_and_rollup(orders, customers, root) == 2  # second load: unchanged
    events, states = rollup.read_load(spark, root)
    named = {
        "orders": rollup.rollup_from_orders(orders, customers),
        "events": rollup.rollup_from_events(events),
        "merged": rollup.merge_states(states),
    }
    report = {r.comparison: (r.only_left, r.only_right) for r in rollup.rollup_consistency(named).collect()}
    assert report == {"orders_vs_events": (0, 0), "orders_vs_merged": (0, 0)}
    assert events.count() == 599
    folder = manifest.current(spark, root).folders[rollup.EVENTS][0]
    assert {f.name for f in spark.read.parquet(folder).schema} >= {"yyyymm"}


def test_events_and_states_switch_together(spark, tmp_dir):
    """A reader in between sees the old pair, whole, until the new one is named by the log."""
    orders, customers = _fixture(spark)
    root = f"{tmp_dir}/load"
    with pytest.raises(FileNotFoundError):
        rollup.read_load(spark, root)
    rollup.load_events_and_rollup(orders.where("order_id < 100"), customers, root)
    before = rollup.read_load(spark, root)
    rollup._write_load(orders, customers, root)  # written, not published
    events, states = rollup.read_load(spark, root)
    assert events.count() == 99 and collected(rollup.merge_states(states)) == collected(rollup.rollup_from_events(events))
    rollup.load_events_and_rollup(orders, customers, root)
    events, states = rollup.read_load(spark, root)
    assert events.count() == 599 and collected(rollup.merge_states(states)) == collected(rollup.rollup_from_events(events))
    assert before[0].count() == 99 and collected(rollup.merge_states(before[1])) == collected(rollup.rollup_from_events(before[0]))
    assert rollup.read_load(spark, root, 1)[0].count() == 99


def test_second_load_is_added_once_and_compaction_changes_nothing(spark, tmp_dir):
    orders, customers = _fixture(spark)
    root = f"{tmp_dir}/load"
    assert rollup.append_load(orders.where("order_id < 300"), customers, root, "daily", 1) == 1
    assert rollup.append_load(orders.where("order_id >= 300"), customers, root, "daily", 2) == 2
    assert rollup.append_load(orders.where("order_id >= 300"), customers, root, "daily", 2) == 2  # replayed
    assert rollup.append_load(orders.where("order_id < 300"), customers, root, "daily", 1) == 2  # replayed late
    whole = collected(rollup.rollup_from_orders(orders, customers))
    assert collected(rollup.merge_states(rollup.read_load(spark, root)[1])) == whole
    assert rollup.compact(spark, root) == 3
    now = manifest.current(spark, root)
    assert len(now.folders[rollup.STATES]) == 1 and len(now.folders[rollup.EVENTS]) == 2
    events, states = rollup.read_load(spark, root)
    assert collected(rollup.merge_states(states)) == collected(rollup.rollup_from_events(events)) == whole
    assert states.count() == states.select(*rollup.ROLLUP_KEYS).distinct().count()
    assert rollup.compact(spark, root) == 3  # nothing to merge


def test_a_load_during_compaction_stays(spark, tmp_dir, monkeypatch):
    orders, customers = _fixture(spark)
    root = f"{tmp_dir}/load"
    for n, part in enumerate(("order_id < 100", "order_id between 100 and 199")):
        rollup.append_load(orders.where(part), customers, root, "daily", n)
    plain = manifest.commit

    def late(spark_, root_, update, **kwargs):
        monkeypatch.setattr(manifest, "commit", plain)
        rollup.append_load(orders.where("order_id >= 200"), customers, root, "daily", 2)
        return plain(spark_, root_, update, **kwargs)
    monkeypatch.setattr(manifest, "commit", late)
    rollup.compact(spark, root)
    assert len(manifest.current(spark, root).folders[rollup.STATES]) == 2
    assert collected(rollup.merge_states(rollup.read_load(spark, root)[1])) == collected(rollup.rollup_from_orders(orders, customers))


def test_stream_matches_batch_and_replayed_batch_is_idempotent(spark, tmp_dir):
    orders, customers = _fixture(spark)
    events = f"{tmp_dir}/events"
    rollup.write_events(rollup.order_events(orders, customers), events)
    root, ckpt = f"{tmp_dir}/states-{uuid.uuid4().hex}", f"{tmp_dir}/ckpt"
    q = rollup_stream.start_rollup_stream(spark, events, root, ckpt, "orders", max_files_per_trigger=2, compact_every=3)
    q.awaitTermination()
    now = manifest.current(spark, root)
    assert now.loads["orders"] >= 3 and len(now.folders[rollup.STATES]) < 3  # compacted on the way
    batch = rollup.rollup_from_orders(orders, customers)
    assert collected(rollup_stream.read_rollup(spark, root)) == collected(batch)
    # A replayed micro-batch (at-least-once delivery) finds its number in the log.
    replayed = f"{tmp_dir}/replay-{uuid.uuid4().hex}"
    sink = rollup_stream.publish_batch_states(replayed, "orders")
    batch_rows = rollup.read_events(spark, events)
    sink(batch_rows, 3)
    once = collected(rollup_stream.read_rollup(spark, replayed))
    sink(batch_rows, 3)
    assert collected(rollup_stream.read_rollup(spark, replayed)) == once == collected(batch)
