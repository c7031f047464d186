"""Repeated bytes against every window of every text."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from marketlens.llm import repeats

DOC = "doc_id long, text string, part string, spans string, n_bytes string"


def expected(rows, length=200):
    raws = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (doc, *_), r in zip(rows, raws):
        gone = np.zeros(len(r), dtype=bool)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(int))).reshape(-1, 2)
        out.append((doc, len(r), tuple(map(tuple, edge.tolist())), bytes(b for b, g in zip(r, gone) if not g)))
    return Counter(out)


def fixture():
    rng = np.random.default_rng(4)
    word = ["".join(rng.choice(list("aeioudtnsr é"), int(rng.integers(2, 9)))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(word, n))
    rows = [(i, text(int(rng.integers(1, 300)))) for i in range(60)]
    long_one, passage, almost = text(3000), text(60)[:230], text(60).encode()[:199].decode("utf-8", "ignore")
    rows += [(100 + i, text(40) + passage + text(40)) for i in range(30)]
    rows += [(140 + i, text(30) + almost + text(30)) for i in range(10)]
    for i in range(12):  # near copies: some words changed
        w = long_one.split(" ")
        for j in rng.integers(0, len(w), i * 3):
            w[j] = f"edit{i}{j}"
        rows.append((160 + i, " ".join(w)))
    rows += [(180, rows[5][1] * 3), (181, "a" * 1500), (182, "ab" * 400), (183, text(50) + "x" * 260 + text(50) + "x" * 230),
             (184, "a" * 199), (185, "b" * 200), (186, "b" * 200), (187, "c" * 201), (188, "\x00" * 300), (189, long_one[100:5000]),
             (190, text(25_000)), (190, "short"), (190, "short"), (191, None), (None, ""), (None, rows[7][1]), (192, rows[7][1])]
    return [(i, t, "p", "s", "n") for i, t in rows]


def collected(df):
    return Counter((r["doc_id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["spans"]), bytes(r["kept"])) for r in df.collect())


@pytest.mark.parametrize("hot, parts", [(2048, 5), (3, 2), (1, 3)])
def test_removed_bytes_match_brute_force(spark, hot, parts):
    rows = fixture()
    got = collected(repeats.without_repeats(spark.createDataFrame(rows, DOC).repartition(parts), hot=hot))
    want = expected(rows)
    assert got == want


def test_no_rows(spark):
    out = repeats.without_repeats(spark.createDataFrame([], DOC))
    assert out.columns == ["doc_id", "n_bytes", "spans", "kept"] and out.count() == 0


def test_run_index_matching_statistics():
    """Against the longest match of every suffix by plain comparison, with fewer runs than bytes."""
    rng = np.random.default_rng(9)
    base = bytes(rng.integers(97, 101, 120).tolist())
    strings = [base, base, base[10:90], b"zz" + base[40:], b"aaaaaaaaaa", b"", b"\x00\x00\x00", b"q"]
    index = repeats.RunIndex(strings)
    got = index.matching_statistics()
    suffixes = {(s, i): x[i:] for s, x in enumerate(strings) for i in range(len(x))}

    def common(x, y):
        return next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    for (s, i), x in suffixes.items():
        best = max(common(x, y) for other, y in suffixes.items() if other != (s, i))
        assert max(0, got[index.starts[s] + i]) == best
    assert index.runs < index.n * 0.8


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    shared = bytes(rng.integers(0, 256, 400).tolist())
    found = []
    for k in (0, 57, 140_000):
        raw = bytes(rng.integers(0, 256, k).tolist()) + shared + b"tail" * 60
        lo, hi, anchor, _ = repeats.regions(raw)
        assert lo[0] == 0 and hi[-1] == len(raw) - repeats.LENGTH and (lo[1:] == hi[:-1] + 1).all()
        each = np.repeat(anchor, hi - lo + 1)
        found.append(each[k:k + len(shared) - repeats.LENGTH + 1])
    assert (found[0] == found[1]).all() and (found[0] == found[2]).all()


def test_pieces_of_equal_windows_agree_at_every_level():
    rng = np.random.default_rng(8)
    shared = bytes(rng.integers(0, 256, 300).tolist())
    for shared in (shared, b"ab" * 150, b"x" * 300):
        raws = [b + shared + e for b, e in ((b"", b""), (b"left" * 3, b"r"), (b"\x07" * 40, b"tail" * 9))]
        for level in range(1, repeats.OFFSET_BITS + 1):
            keys = []
            for raw in raws:
                for a, e, anchor, _ in zip(*repeats.regions(raw)):
                    region = raw[a:e + repeats.LENGTH]
                    lo, hi, key, _ = repeats.pieces(region, level)
                    assert lo[0] == 0 and hi[-1] == e - a and (lo[1:] == hi[:-1] + 1).all()
                    keys += [(region[w:w + repeats.LENGTH], k) for x, y, k in zip(lo, hi, key) for w in range(x, y + 1)]
            by_window = {}
            for w, k in keys:
                assert by_window.setdefault(w, k) == k
            if level == repeats.OFFSET_BITS:  # single windows: no two share a key
                assert len(set(by_window.values())) == len(by_window)
