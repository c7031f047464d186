"""L8-L13 against brute force and the FIXTURES.md tie cases."""

from __future__ import annotations

import random

import pytest

from marketlens.operators import metrics


def scored(spark, rows):
    return spark.createDataFrame([(i, lab, sc, pred) for i, (lab, sc, pred) in enumerate(rows)],
                                 "id long, label int, score double, prediction int")


def brute_auc(rows):
    pos = [s for lab, s, _ in rows if lab == 1]
    neg = [s for lab, s, _ in rows if lab == 0]
    wins = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def brute_ap(rows):
    total_pos = sum(lab for lab, _, _ in rows)
    ap = 0.0
    for t in sorted({s for _, s, _ in rows}, reverse=True):
        tp = sum(1 for lab, s, _ in rows if s >= t and lab == 1)
        fp = sum(1 for lab, s, _ in rows if s >= t and lab == 0)
        here = sum(1 for lab, s, _ in rows if s == t and lab == 1)
        ap += here / total_pos * tp / (tp + fp)
    return ap


def test_tied_scores_give_half(spark):
    assert metrics.roc_auc(scored(spark, [(1, 0.5, 1), (0, 0.5, 1)])).collect()[0].roc_auc == 0.5


def test_average_precision_is_stepwise(spark):
    rows = [(1, 0.9, 1), (0, 0.8, 1), (1, 0.7, 0), (0, 0.6, 0)]
    df = scored(spark, rows)
    assert metrics.average_precision(df).collect()[0].average_precision == pytest.approx(0.8333, abs=1e-4)
    assert metrics.roc_auc(df).collect()[0].roc_auc == pytest.approx(0.75)


def test_against_brute_force_with_many_ties(spark):
    rng = random.Random(7)
    rows = [(lab, round(rng.random() * 0.3 + 0.4 * lab * rng.random(), 2), rng.randint(0, 1))
            for lab in [rng.randint(0, 1) for _ in range(700)]]
    df = scored(spark, rows)
    assert metrics.roc_auc(df).collect()[0].roc_auc == pytest.approx(brute_auc(rows), abs=1e-12)
    assert metrics.average_precision(df).collect()[0].average_precision == pytest.approx(brute_ap(rows), abs=1e-12)
    curve = sorted((r.threshold, r.fpr, r.tpr) for r in metrics.roc_curve(df).collect())
    assert curve[-1] == (float("inf"), 0.0, 0.0)
    assert len(curve) == len({s for _, s, _ in rows}) + 1
    assert curve[0][1:] == (1.0, 1.0)


def test_confusion_report_and_accuracy(spark):
    rows = [(1, 0.9, 1), (1, 0.8, 1), (0, 0.7, 1), (0, 0.1, 0), (1, 0.2, 0)]
    df = scored(spark, rows)
    cells = {(r.label, r.prediction): r["count"] for r in metrics.confusion(df).collect()}
    assert cells == {(0, 0): 1, (0, 1): 1, (1, 0): 1, (1, 1): 2}
    report = {r.class_label: r for r in metrics.classification_report(df).collect()}
    assert report["1"].precision == pytest.approx(2 / 3) and report["1"].recall == pytest.approx(2 / 3)
    assert report["0"].support == 2 and report["weighted avg"].support == 5
    assert report["macro avg"].f1_score == pytest.approx((0.5 + 2 / 3) / 2)
    assert metrics.accuracy(df).collect()[0].accuracy == pytest.approx(0.6)


def test_zero_division_counts_as_zero(spark):
    df = scored(spark, [(1, 0.9, 0), (1, 0.8, 0)])
    report = {r.class_label: r for r in metrics.classification_report(df).collect()}
    assert report["1"].precision == 0.0 and report["0"].precision == 0.0 and report["0"].support == 0
    cells = {(r.label, r.prediction): r["count"] for r in metrics.confusion(df).collect()}
    assert cells[(0, 1)] == 0 and cells[(1, 0)] == 2


def test_undefined_metrics_are_null_not_errors(spark):
    one_class = scored(spark, [(1, 0.5, 1), (1, 0.7, 1)])
    assert metrics.roc_auc(one_class).first().roc_auc is None
    curve = metrics.roc_curve(one_class).collect()
    assert all(r.fpr is None for r in curve if r.threshold != float("inf"))
    empty = scored(spark, [])
    assert metrics.roc_auc(empty).first().roc_auc is None
    assert metrics.average_precision(empty).first().average_precision is None
    assert metrics.roc_curve(empty).collect() == [] or len(metrics.roc_curve(empty).collect()) == 1
    assert metrics.accuracy(empty).first().accuracy is None


def test_null_or_nan_scores_are_an_error(spark):
    import pytest

    from marketlens.operators.metrics import roc_auc
    for bad in (None, float("nan")):
        df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, bad)], "label int, score double")
        with pytest.raises(Exception, match="score is NULL or NaN"):
            roc_auc(df).collect()
