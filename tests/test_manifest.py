"""The version log: numbers without gaps, one owner each, and refreshes at once."""

from __future__ import annotations

import threading

import pytest

from marketlens.operators import snapshot
from marketlens.sources import manifest


def test_numbers_are_found_without_listing(spark, tmp_dir):
    root = f"{tmp_dir}/log"
    assert manifest.newest(spark, root) == 0 and manifest.current(spark, root) == manifest.Version()
    for n in range(1, 20):
        assert manifest.commit(spark, root, lambda now, n=n: {"data": [f"f{n}"]}, rows=n) == n
        assert manifest.newest(spark, root) == n
    assert manifest.read(spark, root, 7).folders == {"data": ["f7"]} and manifest.read(spark, root, 7).rows == 7
    with pytest.raises(FileNotFoundError):
        manifest.read(spark, root, 20)


def test_a_number_has_one_owner(spark, tmp_dir):
    root = f"{tmp_dir}/log"
    assert manifest.claim(spark, root, manifest.Version(1, {"data": ["mine"]}))
    assert not manifest.claim(spark, root, manifest.Version(1, {"data": ["yours"]}))
    assert manifest.read(spark, root, 1).folders == {"data": ["mine"]}


def test_an_update_sees_what_was_published_in_between(spark, tmp_dir):
    root, asked = f"{tmp_dir}/log", []

    def add(now):
        asked.append(now.number)
        if len(asked) == 1:
            manifest.commit(spark, root, lambda _: {"data": ["theirs"]})
        return {"data": [*now.folders.get("data", []), "mine"]}
    assert manifest.commit(spark, root, add) == 2 and asked == [0, 1]
    assert manifest.current(spark, root).folders == {"data": ["theirs", "mine"]}


def test_loads_are_known_by_their_highest_number(spark, tmp_dir):
    root = f"{tmp_dir}/log"
    for source, number, want in (("a", 3, 1), ("a", 3, 1), ("a", 2, 1), ("b", 0, 2), ("a", 4, 3)):
        assert manifest.commit(spark, root, lambda now: now.folders, load=(source, number)) == want
    assert manifest.current(spark, root).loads == {"a": 4, "b": 0}
    assert manifest.commit(spark, root, lambda now: None) == 3


def test_two_refreshes_at_once_get_a_version_each(spark, tmp_dir):
    root, found, start = f"{tmp_dir}/mart", [], threading.Barrier(4)

    def refresh(k):
        start.wait()
        found.append((snapshot.materialise(spark.range(10 * k, 10 * k + 5).withColumnRenamed("id", "k"), root, ["k"]), k))
    threads = [threading.Thread(target=refresh, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(v for v, _ in found) == [1, 2, 3, 4]
    for version, k in found:  # every version is whole and belongs to one refresh
        assert sorted(r.k for r in snapshot.read_version(spark, root, version).collect()) == list(range(10 * k, 10 * k + 5))
    last = dict(found)[4]
    assert sorted(r.k for r in snapshot.read_current(spark, root).collect()) == list(range(10 * last, 10 * last + 5))


def test_claims_race_for_one_number(spark, tmp_dir):
    root, won, start = f"{tmp_dir}/race", [], threading.Barrier(8)

    def take(k):
        start.wait()
        if manifest.claim(spark, root, manifest.Version(1, {"data": [str(k)]})):
            won.append(str(k))
    threads = [threading.Thread(target=take, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and manifest.read(spark, root, 1).folders == {"data": won}
