"""Ranked search against scores of every (item, document) pair."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from marketlens.llm import lexical

DOC = "doc_id long, text string, score string, rank string, key string"
ITEM = "item_id long, text string, doc string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def expected(docs, items, k=10):
    own = [(i, terms(t)) for i, t, *_ in docs]
    own = [(i, ts, Counter(ts)) for i, ts in own if ts]
    n, length = len(own), sum(len(ts) for _, ts, _ in own)
    df = Counter(t for _, _, c in own for t in c)
    out = []
    for item, text, *_ in items:
        rows = []
        for i, ts, c in own:
            m = 25 + (75 * len(ts) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in terms(text) if c[t])
            if s > 0:
                rows.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(rows)[:k], 1)]
    return Counter(out)


def fixture():
    rng = np.random.default_rng(11)
    vocabulary = ["the", "of", "and", "Été", "ß", "x1", "naïve", *[f"w{i}" for i in range(400)]]
    p = 1 / np.arange(1, len(vocabulary) + 1)
    text = lambda n: " ".join(rng.choice(vocabulary, n, p=p / p.sum()))
    docs = [(i, text(int(rng.integers(1, 120))), "s", "r", "k") for i in range(400)]
    docs += [(400 + i, docs[3][1], "s", "r", "k") for i in range(40)]  # copies: ties
    docs += [(5, text(30), "s", "r", "k"), (None, docs[3][1], "s", "r", "k"), (None, None, "s", "r", "k"), (900, "", "s", "r", "k"),
             (901, " .,;\t\x00", "s", "r", "k"), (902, text(20_000), "s", "r", "k"), (903, "the,THE.The_w1", "s", "r", "k")]
    items = [(i, text(int(rng.integers(1, 40))), "d") for i in range(30)]
    items += [(3, docs[3][1], "d"), (31, None, "d"), (32, "", "d"), (None, "ÉTÉ été Été w399", "d"), (33, "nowhere", "d"), (34, text(5000), "d")]
    return docs, items


@pytest.mark.parametrize("blocks", [(4096, 200_000), (37, 200_000), (4096, 300)])
def test_ranked_matches_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(lexical, "ITEM_BLOCK", blocks[1])
    docs, items = fixture()
    frame = spark.createDataFrame(docs, DOC).repartition(2)
    # The block sides bind at the workers: a small one comes from many partitions.
    frame = frame.repartition(max(1, len(docs) // blocks[0]))
    rows = lexical.ranked(frame, spark.createDataFrame(items, ITEM)).collect()
    assert Counter(tuple(r) for r in rows) == expected(docs, items)


def test_ranked_of_nothing(spark):
    docs, items = fixture()
    empty, none = spark.createDataFrame([], DOC), spark.createDataFrame([], ITEM)
    for d, i in ((empty, spark.createDataFrame(items, ITEM)), (spark.createDataFrame(docs[:5], DOC), none), (empty, none)):
        out = lexical.ranked(d, i)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_search_skips_and_keeps_the_best():
    """Short and long lists of one block against plain sums, for several scores to beat."""
    rng = np.random.default_rng(2)
    docs = 500
    n = rng.integers(1, 50, docs)
    found = {t: np.flatnonzero(rng.random(docs) < s) for t, s in enumerate((.9, .7, .02, .5, .01, .3))}
    found = {t: a for t, a in found.items() if len(a)}
    tf = {t: rng.integers(1, 5, len(a)) for t, a in found.items()}
    lists = lexical.Lists(list(found), np.array([len(a) for a in found.values()]),
                          np.concatenate(list(found.values())).astype(np.int32).tobytes(),
                          np.concatenate(list(tf.values())).astype(np.int32).tobytes(), n.astype(np.int64).tobytes(), docs, int(n.sum()))
    m = 25 + (75 * n * docs) // n.sum()
    for weights in ([(0, 5), (1, 40), (2, 900), (3, 100), (4, 2000), (5, 70)], [(0, 3)], [(2, 10), (9, 4)], [(0, 0)], []):
        full = np.zeros(docs, dtype=np.int64)
        for t, w in weights:
            if t in found:
                full[found[t]] += w * (10**9 * tf[t] // (1000 * tf[t] + 8 * m[found[t]]))
        for beat in (1, int(np.sort(full)[-5]) or 1, int(full.max()) + 1):
            at, got = lists.search(weights, 10, beat)
            assert (full[at] == got).all()
            best = sorted((x for x in full.tolist() if x >= beat), reverse=True)[:10]
            assert sorted(got.tolist(), reverse=True)[:10] == best
