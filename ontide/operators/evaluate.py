"""Evaluation of a (label, score) table of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontide.functions.aggregates import count_where
from ontide.operators.cumulative import running_totals
from ontide.session import stage

F1_EPSILON = 1e-9  # Fixed value: keeps the F1 of an empty prediction at zero.


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(
        F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)
    )


def confusion_counts(
    scored: DataFrame, threshold: float, label: str = "label", score: str = "score"
) -> DataFrame:
    flagged, late = F.col(score) >= F.lit(threshold), F.col(label) == 1
    on_time = F.col(label) == 0
    return scored.agg(
        count_where(flagged & late).alias("tp"),
        count_where(flagged & on_time).alias("fp"),
        count_where(~flagged & on_time).alias("tn"),
        count_where(~flagged & late).alias("fn"),
    ).select(F.lit(threshold).cast("double").alias("threshold"), "tp", "fp", "tn", "fn")


def classification_metrics(confusion: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy; an empty denominator gives 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    rated = confusion.withColumns(
        {
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "accuracy": _ratio(tp + tn, tp + fp + tn + fn),
        }
    )
    return rated.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def score_histogram(
    scored: DataFrame, label: str = "label", score: str = "score"
) -> DataFrame:
    """Late and on-time rows per distinct score, staged for the curve passes."""
    return stage(
        scored.groupBy(F.col(score).cast("double").alias("threshold")).agg(
            count_where(F.col(label) == 1).alias("late"),
            count_where(F.col(label) == 0).alias("on_time"),
        )
    )


def _with_class_totals(curve: DataFrame, histogram: DataFrame) -> DataFrame:
    totals = histogram.agg(
        F.sum("late").alias("all_late"), F.sum("on_time").alias("all_on_time")
    )
    return curve.join(F.broadcast(totals), how="cross")


def threshold_curve(
    scored: DataFrame, label: str = "label", score: str = "score", buckets: int | None = None
) -> DataFrame:
    """Counts and rates when flagging `score >= threshold`, one row per distinct score."""
    histogram = score_histogram(scored, label, score)
    curve = running_totals(
        histogram, "threshold", ["late", "on_time"], descending=True, buckets=buckets, following=True
    )
    tp, fp = F.col("upto_late"), F.col("upto_on_time")
    counted = _with_class_totals(curve, histogram).select(
        "threshold",
        "late",
        "on_time",
        "next_late",
        "next_on_time",
        tp.alias("tp"),
        fp.alias("fp"),
        (F.col("all_on_time") - fp).alias("tn"),
        (F.col("all_late") - tp).alias("fn"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, F.col("all_late")).alias("recall"),
        F.try_divide(fp.cast("double"), F.col("all_on_time").cast("double")).alias("fpr"),
        F.try_divide(tp.cast("double"), F.col("all_late").cast("double")).alias("tpr"),
    )
    precision, recall = F.col("precision"), F.col("recall")
    return counted.withColumn(
        "f1", 2 * precision * recall / (precision + recall + F.lit(F1_EPSILON))
    )


def pr_curve(scored: DataFrame, **options) -> DataFrame:
    """Precision and recall per threshold, and the end point without a threshold."""
    curve = threshold_curve(scored, **options).select("threshold", "precision", "recall")
    end = scored.sparkSession.createDataFrame(
        [(None, 1.0, 0.0)], "threshold double, precision double, recall double"
    )
    return curve.unionByName(end)


def roc_curve(scored: DataFrame, drop_intermediate: bool = True, **options) -> DataFrame:
    """False and true positive rate per threshold, from the point (0, 0).

    `drop_intermediate` leaves out points on a straight stretch: those whose step equals
    the next step. The start, where nothing is flagged, has no threshold.
    """
    curve = threshold_curve(scored, **options)
    if drop_intermediate:
        bends = (F.col("late") != F.col("next_late")) | (F.col("on_time") != F.col("next_on_time"))
        curve = curve.filter(F.coalesce(bends, F.lit(True)))
    start = scored.sparkSession.createDataFrame(
        [(None, 0.0, 0.0)], "threshold double, fpr double, tpr double"
    )
    return curve.select("threshold", "fpr", "tpr").unionByName(start)


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score", buckets: int | None = None) -> DataFrame:
    """Probability that a late row scores above an on-time row, ties counted half.

    Null when only one class is present.
    """
    histogram = score_histogram(scored, label, score)
    curve = running_totals(histogram, "threshold", ["on_time"], buckets=buckets)
    below = (F.col("upto_on_time") - F.col("on_time")).cast("double")
    wins = F.col("late").cast("double") * (below + F.col("on_time") / 2)
    totals = curve.agg(
        F.sum(wins).alias("wins"),
        F.sum("late").cast("double").alias("all_late"),
        F.sum("on_time").cast("double").alias("all_on_time"),
    )
    return totals.select(
        F.try_divide(F.col("wins"), F.col("all_late") * F.col("all_on_time")).alias("auc_roc")
    )


def threshold_analysis(scored: DataFrame, **options) -> DataFrame:
    return threshold_curve(scored, **options).select("threshold", "precision", "recall", "f1")


def best_threshold(scored: DataFrame, **options) -> DataFrame:
    """The threshold with the highest F1; the lowest of several."""
    return (
        threshold_analysis(scored, **options)
        .orderBy(F.desc("f1"), F.asc("threshold"))
        .limit(1)
    )


def evaluate_scores(
    scored: DataFrame, threshold: float, label: str = "label", score: str = "score"
) -> DataFrame:
    """AUC, metrics and counts at a threshold, as one row."""
    metrics = classification_metrics(confusion_counts(scored, threshold, label, score))
    auc = roc_auc(scored, label, score)
    return metrics.join(F.broadcast(auc), how="cross").select(
        "threshold", "auc_roc", "precision", "recall", "f1", "accuracy", "tp", "fp", "tn", "fn"
    )


def classification_report(confusion: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, with the usual averages."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    base = confusion.select(
        _ratio(tn, tn + fn).alias("p0"),
        _ratio(tn, tn + fp).alias("r0"),
        (tn + fp).alias("s0"),
        _ratio(tp, tp + fp).alias("p1"),
        _ratio(tp, tp + fn).alias("r1"),
        (tp + fn).alias("s1"),
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
    ).withColumns({"f0": _f1(F.col("p0"), F.col("r0")), "f1": _f1(F.col("p1"), F.col("r1"))})
    total = F.col("s0") + F.col("s1")
    absent = F.lit(None).cast("double")

    def line(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            support.alias("support"),
        )

    def macro(kind: str) -> Column:
        return (F.col(f"{kind}0") + F.col(f"{kind}1")) / 2

    def weighted(kind: str) -> Column:
        return _ratio(F.col(f"{kind}0") * F.col("s0") + F.col(f"{kind}1") * F.col("s1"), total)

    return base.select(
        F.inline(
            F.array(
                line("0", F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
                line("1", F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
                line("accuracy", absent, absent, F.col("accuracy"), total),
                line("macro avg", macro("p"), macro("r"), macro("f"), total),
                line("weighted avg", weighted("p"), weighted("r"), weighted("f"), total),
            )
        )
    )


def confusion_cells(confusion: DataFrame) -> DataFrame:
    """The 2x2 matrix as rows."""
    cells = [
        ("On-Time", "On-Time", "tn", "correct"),
        ("On-Time", "Late", "fp", "false alarm"),
        ("Late", "On-Time", "fn", "missed"),
        ("Late", "Late", "tp", "caught"),
    ]
    return confusion.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(actual).alias("actual"),
                        F.lit(predicted).alias("predicted"),
                        F.lit(cell.upper()).alias("cell"),
                        F.lit(caption).alias("caption"),
                        F.col(cell).alias("orders"),
                    )
                    for actual, predicted, cell, caption in cells
                ]
            )
        )
    )


def business_impact(confusion: DataFrame) -> DataFrame:
    """Orders flagged, caught, missed and wrongly flagged, with their rates in percent."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return confusion.select(
        "threshold",
        (tp + fp + F.col("tn") + fn).alias("orders"),
        (tp + fn).alias("late_orders"),
        tp.alias("caught"),
        fn.alias("missed"),
        fp.alias("false_alarms"),
        (tp + fp).alias("flagged"),
        (_ratio(tp, tp + fn) * 100).alias("caught_pct"),
        (_ratio(fn, tp + fn) * 100).alias("missed_pct"),
        (_ratio(tp, tp + fp) * 100).alias("precision_pct"),
    )
