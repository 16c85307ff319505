"""Quantiles, running totals and curves against brute force."""

import math
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ontide.operators import evaluate as ev
from ontide.operators.cumulative import running_totals
from ontide.operators.quantiles import exact_quantiles, order_statistics, quantile_bins

PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x double").repartition(4)


def brute(values, p):
    known = sorted(v for v in values if v is not None)
    return float(np.quantile(known, p))


CASES = {
    "uniform": [random.Random(1).uniform(-50, 50) for _ in range(4000)],
    "one value holds a third": [5.0] * 1500 + [random.Random(2).gauss(5, 1) for _ in range(3000)],
    "constant": [3.0] * 200,
    "nulls": [None, 1.0, None, 2.0, 4.0],
    "long tail": [float(i) for i in range(3000)] + [10.0**i for i in range(12)],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("limit", [10, 100_000])
def test_quantiles_match_numpy(spark, case, limit):
    values = CASES[case]
    found = exact_quantiles(
        frame(spark, values), ["x"], PROBABILITIES, max_candidates=limit, accuracy=50
    )["x"]
    for p, value in zip(PROBABILITIES, found):
        assert math.isclose(value, brute(values, p), rel_tol=1e-12, abs_tol=1e-9)


def test_quantiles_of_several_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None, 4), (3.0, None, 6)], "a double, b double, c int")
    assert exact_quantiles(df, ["a", "b", "c"], [0.5]) == {"a": [2.0], "b": [None], "c": [5.0]}


def test_order_statistics_are_exact_members(spark):
    values = [random.Random(3).random() for _ in range(3000)]
    found = order_statistics(
        frame(spark, values), {"x": [(n, n) for n in (0, 7, 1500, 2999)]}, None, 20, 50
    )
    assert [found["x", n] for n in (0, 7, 1500, 2999)] == [sorted(values)[n] for n in (0, 7, 1500, 2999)]


def test_quantile_bins_are_closed_on_the_right(spark):
    rows = [(float(v), v % 2) for v in range(1, 9)]
    df = spark.createDataFrame(rows, "x double, is_late int")
    bins = quantile_bins(df, "x", "is_late").collect()
    assert [b.order_count for b in bins] == [2, 2, 2, 2]
    assert (bins[0].lower_edge, bins[0].upper_edge, bins[3].upper_edge) == (1.0, 2.75, 8.0)


def test_quantile_bins_merge_equal_edges_and_skip_nulls(spark):
    values = [1.0] * 6 + [2.0, 3.0] + [None]
    df = spark.createDataFrame([(v, 1) for v in values], "x double, is_late int")
    bins = quantile_bins(df, "x", "is_late").collect()
    assert sum(b.order_count for b in bins) == 8
    assert len(bins) < 4
    constant = spark.createDataFrame([(1.0, 1)] * 3, "x double, is_late int")
    assert quantile_bins(constant, "x", "is_late").count() == 0


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("buckets", [1, 7, 256])
def test_running_totals_match_a_plain_sum(spark, descending, buckets):
    chooser = random.Random(4)
    rows = [(chooser.random(), chooser.randint(0, 5)) for _ in range(500)]
    df = spark.createDataFrame(rows, "k double, n long").repartition(3).cache()
    found = {
        r.k: (r.upto_n, r.next_n)
        for r in running_totals(df, "k", ["n"], descending, buckets, following=True).collect()
    }
    ordered = sorted(rows, reverse=descending)
    total = 0
    for i, (k, n) in enumerate(ordered):
        total += n
        following = ordered[i + 1][1] if i + 1 < len(ordered) else None
        assert found[k] == (total, following)


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, score double")


def brute_auc(rows):
    late = [s for label, s in rows if label == 1]
    on_time = [s for label, s in rows if label == 0]
    wins = sum((a > b) + 0.5 * (a == b) for a in late for b in on_time)
    return wins / (len(late) * len(on_time))


@settings(max_examples=6, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=4, max_size=40).filter(
        lambda rows: len({label for label, _ in rows}) == 2
    )
)
def test_auc_matches_pair_counting(spark, rows):
    rows = [(label, score / 6) for label, score in rows]
    assert math.isclose(ev.roc_auc(scored(spark, rows), buckets=4).first()[0], brute_auc(rows))


def test_auc_extremes(spark):
    assert ev.roc_auc(scored(spark, [(0, 0.5), (1, 0.5)])).first()[0] == 0.5
    assert ev.roc_auc(scored(spark, [(0, 0.1), (0, 0.2), (1, 0.9)])).first()[0] == 1.0
    assert ev.roc_auc(scored(spark, [(1, 0.1), (1, 0.2)])).first()[0] is None


CURVE = [(1, 0.9), (0, 0.8), (1, 0.7), (1, 0.7), (0, 0.3), (0, 0.2), (0, 0.1)]


@pytest.mark.parametrize("buckets", [1, 3, 64])
def test_threshold_curve_counts(spark, buckets):
    rows = {r.threshold: r for r in ev.threshold_curve(scored(spark, CURVE), buckets=buckets).collect()}
    for threshold, row in rows.items():
        flagged = [label for label, score in CURVE if score >= threshold]
        assert (row.tp, row.fp) == (sum(flagged), len(flagged) - sum(flagged))
        assert (row.tp + row.fn, row.fp + row.tn) == (3, 4)
    assert ev.best_threshold(scored(spark, CURVE), buckets=buckets).first().threshold == 0.7


def test_best_threshold_takes_the_lowest_of_equals(spark):
    rows = [(1, 0.8), (0, 0.6), (1, 0.4)]
    best = ev.best_threshold(scored(spark, [(1, 0.8), (1, 0.4), (0, 0.4), (0, 0.3)])).first()
    assert best.threshold in (0.4, 0.8)
    curve = {r.threshold: r.f1 for r in ev.threshold_analysis(scored(spark, rows)).collect()}
    top = max(curve.values())
    assert ev.best_threshold(scored(spark, rows)).first().threshold == min(
        t for t, f1 in curve.items() if f1 == top
    )


def test_roc_curve_drops_points_on_straight_stretches(spark):
    full = ev.roc_curve(scored(spark, CURVE), drop_intermediate=False).count()
    kept = {(r.fpr, r.tpr) for r in ev.roc_curve(scored(spark, CURVE)).collect()}
    assert full == 7
    # From (0.25, 1.0) to (1.0, 1.0) the curve is straight.
    assert kept == {(0.0, 0.0), (0.0, 1 / 3), (0.25, 1 / 3), (0.25, 1.0), (1.0, 1.0)}


def test_metrics_with_empty_denominators(spark):
    metrics = ev.classification_metrics(ev.confusion_counts(scored(spark, [(0, 0.1)]), 0.5)).first()
    assert (metrics.precision, metrics.recall, metrics.f1, metrics.accuracy) == (0, 0, 0, 1)


def test_recorded_counts_give_the_recorded_metrics(spark):
    """Counts and rounded metrics published with the model."""
    cells = spark.createDataFrame(
        [(0.5968, 765, 1883, 15846, 800), (0.5, 960, 3339, 14390, 605)],
        "threshold double, tp long, fp long, tn long, fn long",
    )
    columns = ["precision", "recall", "f1", "accuracy"]
    rows = ev.classification_metrics(cells).select(*[F.round(c, 4) for c in columns]).collect()
    assert tuple(rows[0]) == (0.2889, 0.4888, 0.3632, 0.8609)
    assert tuple(rows[1]) == (0.2233, 0.6134, 0.3274, 0.7956)


def test_a_stage_leaves_no_shuffle_files(spark):
    import os

    from ontide.session import SHUFFLE_CLEANUP, stage

    block_manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager()
    folders = [f.getPath() for f in block_manager.diskBlockManager().localDirs()]

    def shuffle_files():
        return {name for top in folders for _, _, names in os.walk(top) for name in names if name.startswith("shuffle_")}

    rows = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n"))
    setting, before = spark.conf.get(SHUFFLE_CLEANUP, None), shuffle_files()
    staged = stage(rows)
    deadline = time.time() + 20
    while shuffle_files() - before and time.time() < deadline:
        time.sleep(0.2)
    assert shuffle_files() - before == set()
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == setting
    assert staged.count() == rows.count() == 100 and rows.agg(F.sum("n")).first()[0] == 10_000
