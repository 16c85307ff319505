"""Prefixes of boosted trees: margins, AUC per round, patience, gain per feature."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ontide.operators import boosting, train
from ontide.operators.cumulative import running_totals
from ontide.operators.evaluate import roc_auc


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    made = []
    for i in range(900):
        x = [rng.random() for _ in range(4)]
        late = int(x[0] + x[1] * x[2] + 0.3 * rng.random() > 1.0)
        made.append((i, *x, late))
    df = spark.createDataFrame(made, "order_id long, a double, b double, c double, d double, is_late int")
    return df.withColumn("unused", F.lit(1.0))


FEATURES = ["a", "b", "c", "d", "unused"]


@pytest.fixture(scope="module")
def fitted(rows):
    data = train.training_rows(rows, FEATURES, "is_late")
    return data, train.boosted_trees(train.BoostingParams(rounds=8, max_depth=3)).fit(data)


def test_every_prefix_has_the_auc_of_its_own_model(fitted):
    data, trees = fitted
    found = [r.auc_roc for r in boosting.prefix_aucs(data, trees).collect()]
    assert len(found) == 8
    for rounds in (1, 2, 5, 8):
        model = boosting.first_trees(trees, rounds)
        assert model.getNumTrees == rounds and model.treeWeights == trees.treeWeights[:rounds]
        margin = train.vector_to_array("rawPrediction")[1]
        scored = model.transform(data).select("label", F.round(margin, 12).alias("score"))
        assert math.isclose(found[rounds - 1], roc_auc(scored).first()[0], rel_tol=1e-9)


def test_cut_model_can_be_stored(spark, fitted, tmp_path):
    data, trees = fitted
    cut = boosting.first_trees(trees, 3)
    cut.write().save(str(tmp_path / "cut"))
    loaded = type(cut).load(str(tmp_path / "cut"))
    one, two = (m.transform(data).select("rawPrediction").collect() for m in (cut, loaded))
    assert one == two and loaded.numFeatures == len(FEATURES)


def test_patience():
    rising = [0.5 + i / 1000 for i in range(60)]
    assert boosting.patient_rounds(rising, 50) == (60, False)
    assert boosting.patient_rounds([*rising, *[0.5] * 49], 50) == (60, False)
    assert boosting.patient_rounds([*rising, *[0.5] * 50], 50) == (60, True)
    # a better round after the stop doesn't count, an equal one isn't better
    assert boosting.patient_rounds([0.6, *[0.6] * 50, 0.9], 50) == (1, True)
    assert boosting.patient_rounds([None, None], 50) == (1, False)


def test_fit_goes_on_while_the_auc_gains_though_the_loss_rises(spark, rows, monkeypatch):
    """A validation AUC that gains for 20 rounds of rising loss doesn't end the fit."""
    seen = []

    def aucs(judged, trees):
        seen.append(trees.getNumTrees)
        gaining = [(i + 1, 0.5 + i / 100 if i < 23 else 0.6) for i in range(trees.getNumTrees)]
        return spark.createDataFrame(gaining, "rounds int, auc_roc double")

    monkeypatch.setattr(train, "prefix_aucs", aucs)
    params = train.BoostingParams(rounds=64, max_depth=2, learning_rate=0.9)
    model = train.fit_baseline(rows, FEATURES, params, patience=5)
    assert seen == [10, 20, 40] and model.getNumTrees == 23


def test_rounds_end_without_patience(rows):
    params = train.BoostingParams(rounds=4, max_depth=2)
    assert 1 <= train.fit_baseline(rows, FEATURES, params).getNumTrees <= 4


def test_gains_of_a_hand_made_model(spark):
    nodes = spark.createDataFrame(
        [
            # tree 0: a splits 10 rows, b the 4 on the left
            (0, 0, 10.0, 0, 0.5, None),
            (0, 1, 4.0, 1, 0.25, None),
            (0, 2, 3.0, None, None, 1.0),
            (0, 3, 1.0, None, None, 2.0),
            (0, 4, 6.0, None, None, 3.0),
            # tree 1: a again
            (1, 0, 10.0, 0, 0.1, None),
            (1, 1, 5.0, None, None, -1.0),
            (1, 2, 5.0, None, None, 1.0),
        ],
        "tree int, node int, weight double, feature_index int, gain double, prediction double",
    )
    found = {r.feature: tuple(r)[1:] for r in boosting.feature_gains(nodes, ["a", "b", "c"]).collect()}
    assert found == {"a": (2, 6.0, 3.0), "b": (1, 1.0, 1.0), "c": (0, 0.0, 0.0)}
    leaves = {(r.tree, r.leaf): r.value for r in boosting.leaf_values(nodes, [1.0, 0.5]).collect()}
    assert leaves == {(0, 0): 1.0, (0, 1): 2.0, (0, 2): 3.0, (1, 0): -0.5, (1, 1): 0.5}


def test_gains_of_a_fitted_model(spark, fitted):
    _, trees = fitted
    nodes = boosting.tree_nodes(spark, trees)
    gains = {r.feature: r for r in boosting.feature_gains(nodes, FEATURES).collect()}
    assert gains["unused"].gain == 0 and gains["a"].gain > gains["d"].gain
    inner = sum(t.numNodes // 2 for t in trees.trees)
    assert sum(r.splits for r in gains.values()) == inner
    listed = train.feature_gain(spark, trees, FEATURES, 2).collect()
    assert [r.gain for r in listed] == sorted((r.gain for r in gains.values()), reverse=True)[:2]


@pytest.mark.parametrize("rows_per_range", [7, 40, 10_000])
def test_ranges_follow_the_rows(spark, rows_per_range):
    rng = random.Random(4)
    values = [(i % 3, rng.random(), rng.randrange(5)) for i in range(200)]
    df = spark.createDataFrame(values, "g int, x double, n long")
    totals = running_totals(df, ["g", "x"], ["n"], rows_per_range=rows_per_range, following=True).collect()
    wanted, so_far = {}, 0
    ordered = sorted(values)
    for i, (g, x, n) in enumerate(ordered):
        so_far += n
        wanted[g, x] = (so_far, ordered[i + 1][2] if i + 1 < len(ordered) else None)
    assert {(r.g, r.x): (r.upto_n, r.next_n) for r in totals} == wanted


def test_number_of_ranges(spark, monkeypatch):
    from ontide.operators import cumulative

    seen = []
    dealt = cumulative.ordered_ranges
    monkeypatch.setattr(cumulative, "ordered_ranges", lambda df, by, n: seen.append(n) or dealt(df, by, n))
    for rows in (100, 1000):
        df = spark.range(rows).withColumn("n", F.lit(1))
        assert running_totals(df, "id", ["n"], rows_per_range=50).agg(F.max("upto_n")).first()[0] == rows
    assert seen == [2, 20]


def test_one_tree_a_round_keeps_no_node_ids(fitted):
    data, trees = fitted
    learner = train.boosted_trees(train.BoostingParams(rounds=8, max_depth=3))
    assert not learner.getCacheNodeIds()
    # only a way to compute: the trees are the same
    kept = learner.setCacheNodeIds(True).fit(data)
    assert kept.toDebugString.split("\n")[1:] == trees.toDebugString.split("\n")[1:]


def test_final_fits_run_together(spark, rows, monkeypatch):
    """The model that chooses the threshold and the final one don't wait for each other."""
    from threading import Barrier

    pair = Barrier(2)

    class Learner:
        def fit(self, data):
            pair.wait(60)
            return made.fit(data)

    made = train.boosted_trees(train.BoostingParams(rounds=2, max_depth=2))
    fitted = train.Preprocessor(features=FEATURES)
    first = made.fit(train.training_rows(rows, FEATURES, "is_late"))
    monkeypatch.setattr(train, "fit_preprocessor", lambda *_, **__: fitted)
    monkeypatch.setattr(train, "feature_matrix", lambda part, _: part)
    monkeypatch.setattr(train, "fit_baseline", lambda *_: first)
    monkeypatch.setattr(train, "boosted_trees", lambda _: Learner())
    run = train.train_risk_model(rows, draws=0)
    assert run.scored_test.count() == run.test.count() > 0
