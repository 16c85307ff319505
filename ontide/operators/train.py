"""Boosted-tree training, random search, and the saved model."""

from __future__ import annotations

import json
import random
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontide.contract import TARGET_COLUMN, TOP_FEATURES
from ontide.operators.boosting import (
    feature_gains,
    first_trees,
    patient_rounds,
    prefix_aucs,
    tree_nodes,
    unseen_aucs,
)
from ontide.operators.evaluate import best_threshold, evaluate_scores
from ontide.operators.features import (
    Preprocessor,
    encoder_stages,
    feature_matrix,
    fit_preprocessor,
)
from ontide.operators.growing import BoostedTrees, Growth, can_grow
from ontide.operators.split import class_weight, stratified_folds, stratified_split
from ontide.session import shared_dir, stage


@dataclass(frozen=True)
class BoostingParams:
    """Settings of the baseline fit."""

    rounds: int = 1000
    max_depth: int = 6
    learning_rate: float = 0.05
    subsample: float = 0.8
    feature_share: float = 0.8
    min_rows_per_leaf: int = 3
    seed: int = 42


# The choices of the random search.
SEARCH_SPACE: dict[str, list] = {
    "max_depth": [3, 4, 5, 6, 7, 8],
    "learning_rate": [0.01, 0.03, 0.05, 0.08, 0.10, 0.15, 0.20],
    "subsample": [0.60, 0.70, 0.80, 0.90, 1.00],
    "feature_share": [0.60, 0.70, 0.80, 0.90, 1.00],
    "min_rows_per_leaf": [1, 2, 3, 5, 7, 10],
}
SEARCH_DRAWS = 5
SEARCH_FOLDS = 3


# Fixed value: rounds without a better validation AUC that end the baseline fit.
PATIENCE = 50


def assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")


def training_rows(
    matrix: DataFrame, features: Sequence[str], target: str, extra: Sequence[str] = ()
) -> DataFrame:
    """Feature vector, label and class weight, staged because boosting reads it every round."""
    weight = class_weight(matrix, target).first()["scale_pos_weight"]
    rows = assembler(features).transform(matrix).select(
        "features",
        F.col(target).cast("double").alias("label"),
        F.when(F.col(target) == 1, F.lit(weight)).otherwise(F.lit(1.0)).alias("weight"),
        *extra,
    )
    return stage(rows)


def boosted_trees(params: BoostingParams) -> BoostedTrees:
    return BoostedTrees(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        maxIter=params.rounds,
        maxDepth=params.max_depth,
        stepSize=params.learning_rate,
        subsamplingRate=params.subsample,
        featureSubsetStrategy=str(params.feature_share),
        minInstancesPerNode=params.min_rows_per_leaf,
        seed=params.seed,
        # For fits that are left to MLlib. Shortens the lineage of the residuals, which grows with every round.
        checkpointInterval=10,
        # A round has one tree: to walk it costs less than to keep each row's node between the levels.
        cacheNodeIds=False,
    )


def fit_baseline(
    matrix: DataFrame,
    features: Sequence[str],
    params: BoostingParams = BoostingParams(),
    target: str = TARGET_COLUMN,
    key: str = "order_id",
    validation_share: float = 0.1,
    patience: int = PATIENCE,
) -> GBTClassificationModel:
    """Fit until the AUC of a stratified validation part hasn't grown for `patience` rounds, and keep the rounds
    up to its first best.

    The AUC is looked at once the fit has gone on to twice the rounds, until the rule is met or the rounds are spent.
    """
    shared_dir(matrix.sparkSession)
    inner = stratified_split(matrix, key, target, validation_share, params.seed)
    held_out = inner.withColumn("held_out", F.col("split") == "test")
    rows = training_rows(held_out, features, target, ["held_out"])
    learned, judged = rows.filter(~F.col("held_out")), rows.filter("held_out")
    rounds = min(params.rounds, 2 * patience)
    with boosted_trees(params).models(learned) as model:
        while True:
            trees = model(rounds)
            aucs = [row["auc_roc"] for row in prefix_aucs(judged, trees).collect()]
            best, done = patient_rounds(aucs, patience)
            if done or rounds == params.rounds:
                return first_trees(trees, best)
            rounds = min(params.rounds, 2 * rounds)


def draw_params(
    base: BoostingParams,
    draws: int = SEARCH_DRAWS,
    space: Mapping[str, Sequence] = SEARCH_SPACE,
) -> list[BoostingParams]:
    """Distinct seeded draws from the search space."""
    chooser = random.Random(base.seed)
    drawn: list[BoostingParams] = []
    while len(drawn) < draws:
        choice = replace(base, **{name: chooser.choice(list(values)) for name, values in space.items()})
        if choice not in drawn:
            drawn.append(choice)
    return drawn


@dataclass(frozen=True)
class SearchResult:
    params: BoostingParams
    score: float
    tried: list[tuple[BoostingParams, float]]


def grown_scores(rows: DataFrame, tasks: Sequence[tuple[BoostingParams, int]], folds: int) -> list[float]:
    """AUC of each fit on the fold that it leaves out, all fits of as many rounds in one growth."""
    others = [F.col("fold") != fold for fold in range(folds)]
    scores: dict[int, float] = {}
    for rounds in {params.rounds: None for params, _ in tasks}:
        own = [i for i, (params, _) in enumerate(tasks) if params.rounds == rounds]
        learners = [(boosted_trees(tasks[i][0]), others[tasks[i][1]]) for i in own]
        with Growth(rows, learners) as growth:
            growth.upto(rounds)
            scores.update(zip(own, unseen_aucs(growth.unseen_margins(), len(own))))
    return [scores[i] for i in range(len(tasks))]


def fitted_scores(rows: DataFrame, tasks: Sequence[tuple[BoostingParams, int]], parallelism: int) -> list[float]:
    """The same, a fit at a time."""
    judge = BinaryClassificationEvaluator(
        labelCol="label", rawPredictionCol="rawPrediction", metricName="areaUnderROC", numBins=0
    )

    def fold_score(task: tuple[BoostingParams, int]) -> float:
        params, fold = task
        model = boosted_trees(params).fit(rows.filter(F.col("fold") != fold))
        return judge.evaluate(model.transform(rows.filter(F.col("fold") == fold)))

    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(fold_score, tasks))


def random_search(
    matrix: DataFrame,
    features: Sequence[str],
    candidates: Sequence[BoostingParams],
    folds: int = SEARCH_FOLDS,
    target: str = TARGET_COLUMN,
    key: str = "order_id",
    parallelism: int = 2,
) -> SearchResult:
    """Mean AUC over stratified folds per candidate; the first best one wins. Fits of equally many rounds grow
    side by side; `parallelism` counts for those that MLlib does one by one."""
    shared_dir(matrix.sparkSession)
    seed = candidates[0].seed
    rows = training_rows(
        stratified_folds(matrix, folds, key, target, seed), features, target, ["fold"]
    )
    tasks = [(params, fold) for params in candidates for fold in range(folds)]
    if all(can_grow(boosted_trees(params), rows) for params in candidates):
        scores = grown_scores(rows, tasks, folds)
    else:
        scores = fitted_scores(rows, tasks, parallelism)
    tried = [
        (params, sum(scores[i * folds : (i + 1) * folds]) / folds)
        for i, params in enumerate(candidates)
    ]
    best = max(tried, key=lambda entry: entry[1])
    return SearchResult(best[0], best[1], tried)


@dataclass
class RiskModel:
    """A fitted preprocessor with the pipeline that encodes, assembles and scores."""

    preprocessor: Preprocessor
    pipeline: PipelineModel
    threshold: float = 0.5

    @property
    def trees(self) -> GBTClassificationModel:
        return self.pipeline.stages[-1]

    def save(self, spark: SparkSession, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        state = {"threshold": self.threshold, **asdict(self.preprocessor)}
        document = spark.createDataFrame([(json.dumps(state),)], "value string")
        document.coalesce(1).write.mode("overwrite").text(f"{path}/preprocessor")

    @staticmethod
    def load(spark: SparkSession, path: str) -> RiskModel:
        state = json.loads(spark.read.text(f"{path}/preprocessor").first()["value"])
        threshold = state.pop("threshold")
        return RiskModel(Preprocessor(**state), PipelineModel.load(f"{path}/pipeline"), threshold)


def scoring_pipeline(fitted: Preprocessor, trees: GBTClassificationModel) -> PipelineModel:
    return PipelineModel(
        stages=[*encoder_stages(fitted.labels), assembler(fitted.features), trees]
    )


def score_matrix(
    matrix: DataFrame, features: Sequence[str], trees: GBTClassificationModel, keep: Sequence[str]
) -> DataFrame:
    """Probability of the late class for rows of an encoded feature matrix."""
    scored = trees.transform(assembler(features).transform(matrix))
    return scored.select(*keep, vector_to_array("probability")[1].alias("score"))


def feature_importance(
    spark: SparkSession, trees: GBTClassificationModel, features: Sequence[str], size: int = TOP_FEATURES
) -> DataFrame:
    """Share of the gain per feature, 0 for an unused one; the largest first."""
    gains = trees.featureImportances.toArray()
    rows = [(name, float(gain)) for name, gain in zip(features, gains)]
    return (
        spark.createDataFrame(rows, "feature string, importance double")
        .orderBy(F.desc("importance"), "feature")
        .limit(size)
    )


def feature_gain(
    spark: SparkSession, trees: GBTClassificationModel, features: Sequence[str], size: int = TOP_FEATURES
) -> DataFrame:
    """Loss that a split on each feature takes away on average, the largest first."""
    return feature_gains(tree_nodes(spark, trees), features).limit(size)


@dataclass
class TrainingRun:
    """Everything the reports need from one training."""

    model: RiskModel
    train: DataFrame
    test: DataFrame
    scored_test: DataFrame
    baseline_row: dict
    default_row: dict
    optimal_row: dict
    params: BoostingParams
    best_rounds: int


def train_risk_model(
    mart: DataFrame,
    params: BoostingParams = BoostingParams(),
    draws: int = SEARCH_DRAWS,
    folds: int = SEARCH_FOLDS,
    seed: int = 42,
) -> TrainingRun:
    """Split, preprocess, fit a baseline, search, refit, choose a threshold, evaluate.

    Fill values and labels are learned from training rows only. The threshold is chosen
    on a validation part of the training rows, so the test rows stay unseen.
    """
    spark = mart.sparkSession
    marked = stage(stratified_split(mart, seed=seed))
    train_mart = marked.filter(F.col("split") == "train").drop("split")
    test_mart = marked.filter(F.col("split") == "test").drop("split")
    fitted = fit_preprocessor(train_mart, stable=True)
    features = fitted.features
    train = stage(feature_matrix(train_mart, fitted))
    test = stage(feature_matrix(test_mart, fitted))
    keep = ["order_id", F.col(TARGET_COLUMN).alias("label")]

    baseline = fit_baseline(train, features, params)
    best_rounds = baseline.getNumTrees
    baseline_scores = score_matrix(test, features, baseline, keep)
    baseline_row = evaluate_scores(baseline_scores, 0.5).first().asDict()

    tuned = replace(params, rounds=best_rounds)
    if draws:
        candidates = draw_params(tuned, draws)
        tuned = random_search(train, features, candidates, folds).params
    # Choose the threshold with a model that has not seen the validation rows.
    inner = stratified_split(train, test_share=0.1, seed=seed)
    part = inner.filter(F.col("split") == "train")
    held_out = inner.filter(F.col("split") == "test")
    learned = [training_rows(rows, features, TARGET_COLUMN) for rows in (part, train)]
    # The two fits don't need each other; a round's small jobs leave most cores idle.
    with ThreadPoolExecutor(2) as pool:
        probe, trees = pool.map(boosted_trees(tuned).fit, learned)
    threshold = best_threshold(score_matrix(held_out, features, probe, keep)).first()["threshold"]
    scored = stage(score_matrix(test, features, trees, keep))
    return TrainingRun(
        model=RiskModel(fitted, scoring_pipeline(fitted, trees), threshold),
        train=train,
        test=test,
        scored_test=scored,
        baseline_row=baseline_row,
        default_row=evaluate_scores(scored, 0.5).first().asDict(),
        optimal_row=evaluate_scores(scored, threshold).first().asDict(),
        params=tuned,
        best_rounds=best_rounds,
    )


def model_deltas(spark: SparkSession, run: TrainingRun) -> DataFrame:
    """AUC, recall and F1 of the final model against the baseline, both at 0.5."""
    rows = [
        (metric, run.baseline_row[metric], run.default_row[metric])
        for metric in ("auc_roc", "recall", "f1")
    ]
    return spark.createDataFrame(rows, "metric string, baseline double, final double").withColumn(
        "difference", F.col("final") - F.col("baseline")
    )


_METRICS = "auc_roc double, recall double, precision double, f1 double, accuracy double, tp long, fp long, tn long, fn long"
METRICS_SCHEMA = f"""
    model_type string, n_features int, feature_names array<string>,
    n_train long, n_test long, late_rate_train double, late_rate_test double,
    scale_pos_weight double, best_n_estimators int, best_params map<string, double>,
    optimal_threshold double, baseline_accuracy double,
    at_default_threshold struct<{_METRICS.replace(' double', ': double').replace(' long', ': long')}>,
    at_optimal_threshold struct<{_METRICS.replace(' double', ': double').replace(' long', ': long')}>
"""


def metrics_document(spark: SparkSession, run: TrainingRun) -> DataFrame:
    """The training's metrics as one nested row; rates rounded to four digits."""
    names = [part.split()[0] for part in _METRICS.split(", ")]

    def block(row: dict) -> tuple:
        return tuple(round(v, 4) if isinstance(v, float) else v for v in (row[n] for n in names))

    sizes = {
        part: df.agg(
            F.count(F.lit(1)).alias("rows"), F.avg(TARGET_COLUMN).alias("late_rate")
        ).first()
        for part, df in (("train", run.train), ("test", run.test))
    }
    weight = class_weight(run.train).first()["scale_pos_weight"]
    params = {k: float(v) for k, v in asdict(run.params).items() if k not in ("seed", "rounds")}
    features = run.model.preprocessor.features
    row = (
        "GBTClassifier",
        len(features),
        list(features),
        sizes["train"]["rows"],
        sizes["test"]["rows"],
        sizes["train"]["late_rate"],
        sizes["test"]["late_rate"],
        weight,
        run.best_rounds,
        params,
        run.model.threshold,
        1 - sizes["test"]["late_rate"],
        block(run.default_row),
        block(run.optimal_row),
    )
    return spark.createDataFrame([row], METRICS_SCHEMA)
