"""Exact classifier metrics over a scored table (label, score, prediction).

Curve metrics first collapse the table to one row per distinct score (positive
and negative counts, combined map-side), then take running sums in score
order with ``ordered_prefix`` (segments by exponent and leading bits, never a
single-task global window). The input is read once: the counts per score feed
both the segments' sums and the rows. Ties share one threshold, so ROC-AUC equals the
Mann-Whitney statistic with half credit for ties, and average precision is
the step-wise sum (not the trapezoid).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from marketlens.operators.ranking import ordered_prefix

_BIG = DecimalType(38, 0)


def score_counts(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Positives and negatives per distinct score; a NULL or NaN score is an error."""
    pos = F.col(label).cast("long")
    bad = F.col(score).isNull() | F.isnan(F.col(score).cast("double"))
    value = F.when(bad, F.raise_error(F.lit("score is NULL or NaN"))).otherwise(F.col(score))
    return scored.groupBy(value.alias("score")).agg(
        F.sum(pos).alias("pos"), F.sum(F.lit(1) - pos).alias("neg"))


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row ``roc_auc`` = Σ neg·(2·tp_above + pos) / (2·P·N), exact."""
    pref = ordered_prefix(score_counts(scored, label, score), "score",
                          {"tp_above": "pos"}, descending=True, inclusive=False)
    term = F.col("neg").cast(_BIG) * (F.col("tp_above").cast(_BIG) * 2 + F.col("pos").cast(_BIG))
    # Undefined (NULL) when only one class is present.
    return pref.agg(
        F.try_divide(F.sum(term).cast("double"),
                     (F.sum("pos").cast(_BIG) * F.sum("neg").cast(_BIG) * 2).cast("double"))
        .alias("roc_auc"))


def _cumulative(scored: DataFrame, label: str, score: str) -> DataFrame:
    return ordered_prefix(score_counts(scored, label, score), "score",
                          {"tp": "pos", "fp": "neg"}, descending=True, inclusive=True)


def average_precision(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Σ (pos_s / P) · precision at s over distinct scores s."""
    cum = _cumulative(scored, label, score)
    precision = F.col("tp").cast("double") / (F.col("tp") + F.col("fp")).cast("double")
    return cum.agg(F.try_divide(F.sum(F.col("pos").cast("double") * precision),
                                F.sum("pos").cast("double")).alias("average_precision"))


def roc_curve(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score plus the (0, 0) start."""
    cum = ordered_prefix(score_counts(scored, label, score), "score", {"tp": "pos", "fp": "neg"},
                         totals={"_P": "pos", "_N": "neg"})
    points = cum.select(
        F.col("score").cast("double").alias("threshold"),
        F.try_divide(F.col("fp").cast("double"), F.col("_N").cast("double")).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.col("_P").cast("double")).alias("tpr"))
    start = scored.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"),
                                                F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(points)


def _cells(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row n00, n01, n10, n11 (label a, prediction b), one pass."""
    return scored.agg(*[
        F.coalesce(F.sum(((F.col(label).cast("int") == a)
                          & (F.col(prediction).cast("int") == b)).cast("long")), F.lit(0).cast("long"))
        .alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)])


def confusion(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Dense 2x2 counts (label, prediction, count), zero cells included."""
    cells = ", ".join(f"{a}, {b}, n{a}{b}" for a in (0, 1) for b in (0, 1))
    return _cells(scored, label, prediction).selectExpr(
        f"stack(4, {cells}) AS (label, prediction, count)")


def _safe(num, den):
    """``num / den``, 0 when the divisor is 0 (scikit-learn ``zero_division=0``)."""
    return F.when(den != 0, F.try_divide(num, den)).otherwise(F.lit(0.0))


def classification_report(scored: DataFrame, label: str = "label",
                          prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1, support per class, macro and weighted means;
    a zero division counts as 0."""
    n00, n01, n10, n11 = (F.col(f"n{a}{b}").cast("double") for a in (0, 1) for b in (0, 1))
    stats = {}
    for cls, tp, pred, actual in (("0", n00, n00 + n10, n00 + n01), ("1", n11, n01 + n11, n10 + n11)):
        p = _safe(tp, pred)
        r = _safe(tp, actual)
        stats[cls] = (p, r, _safe(F.lit(2.0) * p * r, p + r), actual)
    wide = _cells(scored, label, prediction).select(*[
        e.alias(f"{m}_{cls}") for cls, vals in stats.items()
        for m, e in zip(("precision", "recall", "f1", "support"), vals)])
    s0, s1 = F.col("support_0"), F.col("support_1")
    total = s0 + s1
    rows = []
    for cls in ("0", "1"):
        rows.append(F.struct(F.lit(cls).alias("class_label"), F.col(f"precision_{cls}").alias("precision"),
                             F.col(f"recall_{cls}").alias("recall"), F.col(f"f1_{cls}").alias("f1_score"),
                             F.col(f"support_{cls}").alias("support")))
    for name, agg in (("macro avg", lambda m: (F.col(f"{m}_0") + F.col(f"{m}_1")) / 2),
                      ("weighted avg", lambda m: _safe(F.col(f"{m}_0") * s0 + F.col(f"{m}_1") * s1, total))):
        rows.append(F.struct(F.lit(name).alias("class_label"), agg("precision").alias("precision"),
                             agg("recall").alias("recall"), agg("f1").alias("f1_score"),
                             total.alias("support")))
    return (wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
            .withColumn("support", F.col("support").cast("long")))


def accuracy(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Share of rows whose prediction equals the label."""
    hit = (F.col(label).cast("int") == F.col(prediction).cast("int")).cast("long")
    return scored.agg(F.try_divide(F.sum(hit).cast("double"), F.count(F.lit(1)).cast("double"))
                      .alias("accuracy"))
