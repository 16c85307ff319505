"""Named queries over the star-schema test tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from uuid import uuid4
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontide.contract import (
    CATEGORICAL_COLUMNS,
    DEFAULT_THRESHOLD,
    DERIVED_FEATURES,
    FINAL_FEATURE_COLUMNS,
    ON_TIME_SHORT_LABEL,
)
from ontide.functions.columns import rounded
from ontide.operators import evaluate as ev
from ontide.operators import features as ft
from ontide.operators import mart as mt
from ontide.operators import profile as prof
from ontide.operators import rates, scoring, split, train
from ontide.operators.correlation import correlation_matrix, correlation_with_target
from ontide.operators.quantiles import quantile_bins
from ontide.plans import kpis
from ontide.plans.reports import key_findings
from ontide.session import stage, staged_path
from ontide.sources.adapter import PORTABLE_SCORE, PORTABLE_TEST_ROWS, delivery_tables
from ontide.sources.cleaning import clean_column_names, coerce_timestamps, nan_strings_to_null
from ontide.sources.readers import table_row_counts
from ontide.sources.sinks import load_check, load_warehouse_table, save_stage
from ontide.streaming import incoming, jobs

Query = Callable[[SparkSession, str], DataFrame]

# Approximate centres of the regions that stand for states in the test tables.
REGION_CENTRES = {
    "AFRICA": (2.0, 21.0),
    "AMERICA": (15.0, -90.0),
    "ASIA": (34.0, 100.0),
    "EUROPE": (50.0, 15.0),
    "MIDDLE EAST": (29.0, 42.0),
}

SAMPLE_THRESHOLD = 0.6

# What the filled mart shows.
IMPUTED_COLUMNS = [
    "order_id",
    "total_price",
    "freight_ratio",
    "avg_product_weight_g",
    "approval_time_hours",
    "max_payment_installments",
    "avg_review_score",
    *CATEGORICAL_COLUMNS,
]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def mart(spark: SparkSession, folder: str) -> DataFrame:
    return mt.order_mart(delivery_tables(spark, folder))


def derived(spark: SparkSession, folder: str) -> DataFrame:
    return ft.build_derived_features(mart(spark, folder))


def matrix(
    spark: SparkSession, folder: str, features: Sequence[str] = FINAL_FEATURE_COLUMNS
) -> DataFrame:
    """Feature matrix with fill values and labels learned from the whole mart.

    A query that reads a few features names them, and only those are computed.
    """
    staged = stage(mart(spark, folder).select(*ft.matrix_sources(features)))
    return ft.feature_matrix(staged, ft.fit_preprocessor(staged, features, stable=True))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Label and portable score of every delivered order."""
    orders = mt.with_durations(mt.delivered_orders(delivery_tables(spark, folder)["orders"]))
    return orders.select(
        "order_id", F.col("is_late").alias("label"), F.expr(PORTABLE_SCORE).alias("score")
    )


# --- Sources and sinks


@query
def table_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table_row_counts(delivery_tables(spark, folder))


@query
def warehouse_load_check(spark: SparkSession, folder: str) -> DataFrame:
    source = mt.with_durations(mt.delivered_orders(delivery_tables(spark, folder)["orders"]))
    table = f"load_check_{uuid4().hex}"
    try:
        return stage(load_check(source, load_warehouse_table(source, table)))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


@query
def clean_columns(spark: SparkSession, folder: str) -> DataFrame:
    sellers = delivery_tables(spark, folder)["sellers"]
    return clean_column_names(sellers.toDF(" Seller-ID", "Seller City ", "seller/State"))


@query
def nan_text_to_null(spark: SparkSession, folder: str) -> DataFrame:
    customers = delivery_tables(spark, folder)["customers"]
    exported = customers.withColumn(
        "customer_city",
        F.when(F.col("customer_id") % 10 == 0, "nan").otherwise(F.col("customer_city")),
    )
    return nan_strings_to_null(exported)


@query
def findings(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(key_findings(mart(spark, folder)))


# --- Profiling


@query
def describe_tables(spark: SparkSession, folder: str) -> DataFrame:
    return prof.describe_tables(delivery_tables(spark, folder))


@query
def join_key_counts(spark: SparkSession, folder: str) -> DataFrame:
    return prof.join_key_counts(delivery_tables(spark, folder))


@query
def orphan_keys(spark: SparkSession, folder: str) -> DataFrame:
    return prof.orphan_keys(delivery_tables(spark, folder))


@query
def order_status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(prof.value_counts(delivery_tables(spark, folder)["orders"], "order_status"))


@query
def purchase_date_range(spark: SparkSession, folder: str) -> DataFrame:
    return prof.date_range(delivery_tables(spark, folder)["orders"])


@query
def baseline_late_rate(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(prof.baseline_late_rate(delivery_tables(spark, folder)["orders"]))


@query
def missing_order_dates(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(prof.missing_summary(delivery_tables(spark, folder)["orders"]))


@query
def table_overview(spark: SparkSession, folder: str) -> DataFrame:
    return prof.table_overview(delivery_tables(spark, folder))


@query
def describe_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = delivery_tables(spark, folder)["orders"]
    # Identifiers are text in the delivery schema.
    named = orders.withColumns(
        {c: F.col(c).cast("string") for c in ("order_id", "customer_id")}
    )
    return rounded(prof.describe(named), 4)


@query
def describe_item_prices(spark: SparkSession, folder: str) -> DataFrame:
    items = delivery_tables(spark, folder)["order_items"]
    return rounded(prof.describe(items.select("price", "freight_value")), 4)


@query
def describe_product_sizes(spark: SparkSession, folder: str) -> DataFrame:
    products = delivery_tables(spark, folder)["products"]
    return rounded(
        prof.describe(
            products.select(
                "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm"
            )
        ),
        4,
    )


@query
def missing_values(spark: SparkSession, folder: str) -> DataFrame:
    return prof.missing_values(delivery_tables(spark, folder))


@query
def mart_null_columns(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(prof.columns_with_nulls(mart(spark, folder)))


@query
def feature_report(spark: SparkSession, folder: str) -> DataFrame:
    features = matrix(spark, folder)
    return prof.feature_report(features, ft.feature_columns(features))


@query
def matrix_validation(spark: SparkSession, folder: str) -> DataFrame:
    features = matrix(spark, folder)
    return rounded(prof.matrix_validation(features, FINAL_FEATURE_COLUMNS))


@query
def target_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(prof.target_distribution(mart(spark, folder)))


@query
def derived_feature_stats(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(prof.derived_feature_stats(derived(spark, folder)))


# --- Projections, filters and scalar functions


@query
def delivered_filter(spark: SparkSession, folder: str) -> DataFrame:
    return mt.delivered_orders(delivery_tables(spark, folder)["orders"])


@query
def dropped_orders(spark: SparkSession, folder: str) -> DataFrame:
    return mt.dropped_orders(delivery_tables(spark, folder)["orders"])


@query
def order_durations(spark: SparkSession, folder: str) -> DataFrame:
    orders = mt.with_durations(mt.delivered_orders(delivery_tables(spark, folder)["orders"]))
    return rounded(
        orders.select(
            "order_id",
            "delivery_days_actual",
            "delivery_days_estimated",
            "delivery_delay_days",
            "is_late",
        )
    )


@query
def date_parts(spark: SparkSession, folder: str) -> DataFrame:
    orders = mt.with_time_parts(mt.delivered_orders(delivery_tables(spark, folder)["orders"]))
    return orders.select(
        "order_id",
        "purchase_year",
        "purchase_month_num",
        "purchase_month",
        "purchase_day_of_week",
        "purchase_hour",
    )


@query
def product_volume(spark: SparkSession, folder: str) -> DataFrame:
    products = mt.with_volume(delivery_tables(spark, folder)["products"])
    return rounded(products.select("product_id", "product_volume_cm3"))


@query
def derived_features(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(derived(spark, folder).select("order_id", *DERIVED_FEATURES))


@query
def coerced_timestamps(spark: SparkSession, folder: str) -> DataFrame:
    orders = delivery_tables(spark, folder)["orders"]
    exported = orders.select(
        "order_id",
        F.when(F.col("order_id") % 10 == 0, "not a date")
        .otherwise(F.col("order_purchase_timestamp").cast("string"))
        .alias("order_purchase_timestamp"),
    )
    return coerce_timestamps(exported, ["order_purchase_timestamp"])


@query
def feature_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(matrix(spark, folder))


# --- Joins


@query
def item_enriched(spark: SparkSession, folder: str) -> DataFrame:
    tables = delivery_tables(spark, folder)
    enriched = mt.enrich_items(
        tables["order_items"],
        tables["products"],
        tables["category_translation"],
        tables["sellers"],
    )
    return rounded(
        enriched.select(
            "order_id",
            "order_item_id",
            "product_id",
            "seller_id",
            "price",
            "freight_value",
            "product_category_name",
            "product_category_name_english",
            "product_weight_g",
            "product_volume_cm3",
            "seller_city",
            "seller_state",
        )
    )


@query
def order_mart(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(mart(spark, folder), 4)


# --- Aggregations


@query
def item_features(spark: SparkSession, folder: str) -> DataFrame:
    tables = delivery_tables(spark, folder)
    return rounded(
        mt.item_features(
            tables["order_items"],
            tables["products"],
            tables["category_translation"],
            tables["sellers"],
        ),
        4,
    )


@query
def payment_features(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(mt.payment_features(delivery_tables(spark, folder)["payments"]), 4)


@query
def review_features(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(mt.review_features(delivery_tables(spark, folder)["reviews"]))


def _rate_query(dimension: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(rates.late_rate_by(mart(spark, folder), dimension))

    return run


for _dimension in rates.RATE_DIMENSIONS:
    QUERIES[f"late_rate_by_{_dimension}"] = _rate_query(_dimension)


@query
def late_rate_all_dimensions(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rates.late_rate_all(mart(spark, folder)))


@query
def baseline_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rates.baseline_summary(mart(spark, folder))


@query
def late_rate_weekdays(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rates.late_rate_weekdays(mart(spark, folder)))


@query
def late_rate_months(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rates.late_rate_months(mart(spark, folder)))


@query
def review_by_outcome(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rates.review_by_outcome(mart(spark, folder)))


@query
def price_quartiles(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(quantile_bins(mart(spark, folder), "total_price", "is_late"), 4)


@query
def freight_quartiles(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(quantile_bins(mart(spark, folder), "total_freight", "is_late"), 4)


@query
def correlations(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(correlation_matrix(mart(spark, folder)))


@query
def correlations_with_target(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(correlation_with_target(mart(spark, folder)))


@query
def overall_kpis(spark: SparkSession, folder: str) -> DataFrame:
    features = ["delivery_days_estimated", "total_price", "total_freight", "cross_state"]
    return kpis.overall_kpis(matrix(spark, folder, features))


@query
def state_late_rates(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.state_late_rates(mart(spark, folder))


@query
def route_segments(spark: SparkSession, folder: str) -> DataFrame:
    features = ["delivery_days_estimated", "total_freight", "seller_count", "cross_state"]
    return kpis.route_segments(matrix(spark, folder, features))


@query
def monthly_late_rate(spark: SparkSession, folder: str) -> DataFrame:
    features = ["purchase_month_num", "total_freight"]
    return kpis.monthly_late_rate(matrix(spark, folder, features))


@query
def delivery_summary(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.delivery_summary(mart(spark, folder))


@query
def seller_state_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.seller_state_ranking(mart(spark, folder))


@query
def monthly_rolling_average(spark: SparkSession, folder: str) -> DataFrame:
    features = ["purchase_month_num", "total_freight"]
    return kpis.monthly_rolling_average(matrix(spark, folder, features))


@query
def monthly_trend(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.monthly_trend(mart(spark, folder))


@query
def cross_state_comparison(spark: SparkSession, folder: str) -> DataFrame:
    features = ["delivery_days_estimated", "total_freight", "cross_state"]
    return kpis.cross_state_comparison(matrix(spark, folder, features))


@query
def worst_route_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return kpis.worst_route_pairs(mart(spark, folder))


@query
def delivery_histogram_100(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rates.delivery_histogram(mart(spark, folder), 1, 100, 80))


@query
def delivery_histogram_80(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        rates.delivery_histogram(mart(spark, folder), 1, 80, 70, ON_TIME_SHORT_LABEL)
    )


@query
def delay_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rates.delay_distribution(mart(spark, folder)))


@query
def top_categories(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rates.top_categories(mart(spark, folder)))


@query
def state_map(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rates.state_map(mart(spark, folder), rates.state_centres(spark, REGION_CENTRES)))


@query
def state_ranking_table(spark: SparkSession, folder: str) -> DataFrame:
    states = rates.state_map(mart(spark, folder), rates.state_centres(spark, REGION_CENTRES))
    return rates.state_ranking(states)


@query
def category_list(spark: SparkSession, folder: str) -> DataFrame:
    return rates.category_list(mart(spark, folder))


def _top_chart_query(dimension: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(rates.top_chart_rows(mart(spark, folder), dimension))

    return run


for _dimension in ("customer_state", "main_seller_state", "main_product_category"):
    QUERIES[f"top15_{_dimension}"] = _top_chart_query(_dimension)


# --- Features, splits and evaluation


@query
def impute_values(spark: SparkSession, folder: str) -> DataFrame:
    """Fill values of the columns with nulls, as rows."""
    source = derived(spark, folder)
    numeric, text = ft.imputable_columns(source)
    numeric_fill, text_fill = ft.fit_fill_values(source, numeric, text)
    rows = [(c, v, None) for c, v in numeric_fill.items()]
    rows += [(c, None, v) for c, v in text_fill.items()]
    return rounded(
        spark.createDataFrame(rows, "column_name string, numeric_fill double, text_fill string"), 4
    )


@query
def imputed_mart(spark: SparkSession, folder: str) -> DataFrame:
    # Each column's fill value is its own: only the columns shown are computed and measured.
    staged = stage(derived(spark, folder).select(*IMPUTED_COLUMNS))
    numeric_fill, text_fill = ft.fit_fill_values(staged, stable=True)
    return rounded(ft.apply_fill_values(staged, numeric_fill, text_fill), 4)


@query
def encoded_categories(spark: SparkSession, folder: str) -> DataFrame:
    staged = stage(mart(spark, folder).select("order_id", *CATEGORICAL_COLUMNS))
    return ft.apply_labels(staged, ft.fit_labels(staged))


@query
def portable_split_balance(spark: SparkSession, folder: str) -> DataFrame:
    orders = mt.with_durations(mt.delivered_orders(delivery_tables(spark, folder)["orders"]))
    part = F.when(F.expr(PORTABLE_TEST_ROWS), "test").otherwise("train")
    return rounded(split.split_balance(orders.withColumn("split", part)))


@query
def stratified_split_balance(spark: SparkSession, folder: str) -> DataFrame:
    orders = mt.with_durations(mt.delivered_orders(delivery_tables(spark, folder)["orders"]))
    return rounded(split.split_balance(split.stratified_split(orders)))


@query
def late_class_weight(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(split.class_weight(mart(spark, folder)))


def confusion(spark: SparkSession, folder: str) -> DataFrame:
    return ev.confusion_counts(scored(spark, folder), SAMPLE_THRESHOLD)


@query
def confusion_counts(spark: SparkSession, folder: str) -> DataFrame:
    return confusion(spark, folder)


@query
def classification_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.classification_metrics(confusion(spark, folder)))


@query
def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.roc_auc(scored(spark, folder)))


@query
def pr_curve(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.pr_curve(scored(spark, folder)))


@query
def roc_curve(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.roc_curve(scored(spark, folder)))


@query
def best_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.best_threshold(scored(spark, folder)))


@query
def threshold_analysis(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.threshold_analysis(scored(spark, folder)))


@query
def classification_report(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.classification_report(confusion(spark, folder)))


@query
def confusion_cells(spark: SparkSession, folder: str) -> DataFrame:
    return ev.confusion_cells(confusion(spark, folder))


@query
def business_impact(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ev.business_impact(confusion(spark, folder)))


# --- Training. One run per session and folder serves these queries.

# The runs go when their session does.
_RUNS: WeakKeyDictionary[SparkSession, dict[str, train.TrainingRun]] = WeakKeyDictionary()


def training_run(spark: SparkSession, folder: str) -> train.TrainingRun:
    runs = _RUNS.setdefault(spark, {})
    if folder not in runs:
        runs[folder] = train.train_risk_model(mart(spark, folder))
    return runs[folder]


@query
def model_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """What holds for any trained model: one score in [0, 1] per test order, importances that
    sum to one, and a better order than chance."""
    run = training_run(spark, folder)
    importances = run.model.trees.featureImportances.toArray()
    return run.scored_test.agg(
        F.count(F.lit(1)).alias("test_orders"),
        (F.count_distinct("order_id") == F.count(F.lit(1))).alias("scored_once"),
        F.every(F.col("score").between(0, 1)).alias("scores_in_range"),
        F.lit(bool(abs(importances.sum() - 1) < 1e-9)).alias("importances_sum_to_one"),
        F.lit(bool(run.default_row["auc_roc"] > 0.5)).alias("beats_chance"),
    )


@query
def feature_importance(spark: SparkSession, folder: str) -> DataFrame:
    run = training_run(spark, folder)
    return train.feature_importance(spark, run.model.trees, run.model.preprocessor.features)


@query
def feature_gain(spark: SparkSession, folder: str) -> DataFrame:
    run = training_run(spark, folder)
    return rounded(train.feature_gain(spark, run.model.trees, run.model.preprocessor.features))


@query
def model_deltas(spark: SparkSession, folder: str) -> DataFrame:
    return train.model_deltas(spark, training_run(spark, folder))


@query
def metrics_document(spark: SparkSession, folder: str) -> DataFrame:
    return train.metrics_document(spark, training_run(spark, folder))


@query
def model_scores(spark: SparkSession, folder: str) -> DataFrame:
    return training_run(spark, folder).scored_test


@query
def kpi_row(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.kpi_row(train.metrics_document(spark, training_run(spark, folder)))


@query
def threshold_comparison(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.threshold_comparison(
        train.metrics_document(spark, training_run(spark, folder))
    )


def portable_run(spark: SparkSession, folder: str) -> train.TrainingRun:
    """The portable score in place of a trained model, its square as the baseline's; the threshold is the best of
    the training rows."""
    orders = mt.with_durations(mt.delivered_orders(delivery_tables(spark, folder)["orders"]))
    rows = stage(orders.select("order_id", "is_late", F.expr(PORTABLE_SCORE).alias("score")))
    in_test = F.expr(PORTABLE_TEST_ROWS)
    parts = {True: rows.filter(in_test), False: rows.filter(~in_test)}
    judged = {kind: part.withColumn("label", F.col("is_late")) for kind, part in parts.items()}
    threshold = ev.best_threshold(judged[False]).first()["threshold"]
    squared = judged[True].withColumn("score", F.col("score") * F.col("score"))

    def row(scores: DataFrame, at: float) -> dict:
        return ev.evaluate_scores(scores, at).first().asDict()

    return train.TrainingRun(
        model=train.RiskModel(ft.Preprocessor(), None, threshold),
        train=parts[False],
        test=parts[True],
        scored_test=judged[True],
        baseline_row=row(squared, DEFAULT_THRESHOLD),
        default_row=row(judged[True], DEFAULT_THRESHOLD),
        optimal_row=row(judged[True], threshold),
        params=train.BoostingParams(),
        best_rounds=1,
    )


@query
def portable_kpi_row(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(scoring.kpi_row(train.metrics_document(spark, portable_run(spark, folder))))


@query
def portable_threshold_comparison(spark: SparkSession, folder: str) -> DataFrame:
    document = train.metrics_document(spark, portable_run(spark, folder))
    return rounded(scoring.threshold_comparison(document))


@query
def portable_model_deltas(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(train.model_deltas(spark, portable_run(spark, folder)))


@query
def portable_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The plain fields of the metrics document."""
    document = train.metrics_document(spark, portable_run(spark, folder))
    return rounded(
        document.select(
            "n_features",
            "n_train",
            "n_test",
            "late_rate_train",
            "late_rate_test",
            "scale_pos_weight",
            "optimal_threshold",
            "baseline_accuracy",
            F.col("at_default_threshold.accuracy").alias("default_accuracy"),
            F.col("at_optimal_threshold.accuracy").alias("optimal_accuracy"),
            F.col("at_default_threshold.tn").alias("default_tn"),
            F.col("at_optimal_threshold.fn").alias("optimal_fn"),
        )
    )


# --- Scoring


def numeric_inputs(
    spark: SparkSession, folder: str, described: Callable[[DataFrame, Sequence[str]], DataFrame], columns: Sequence[str]
) -> DataFrame:
    """The numeric model inputs of `described` orders. Categories that no number is made of are not shown, so
    they are neither computed nor learned."""
    numeric = [c for c in FINAL_FEATURE_COLUMNS if not c.endswith("_encoded")]
    staged = stage(mart(spark, folder).select(*ft.matrix_sources(numeric)))
    fitted = ft.fit_preprocessor(staged, numeric, stable=True)
    unseen = set(CATEGORICAL_COLUMNS) - set(staged.columns)
    inputs = scoring.scoring_inputs(described(staged, [c for c in columns if c not in unseen]), fitted)
    return rounded(inputs.select("order_id", *numeric))


@query
def score_inputs(spark: SparkSession, folder: str) -> DataFrame:
    return numeric_inputs(spark, folder, scoring.order_profiles, scoring.PROFILE_COLUMNS)


@query
def score_inputs_known(spark: SparkSession, folder: str) -> DataFrame:
    known = [*scoring.PROFILE_COLUMNS, *scoring.KNOWN_COLUMNS]
    return numeric_inputs(spark, folder, scoring.known_orders, known)


@query
def risk_factors(spark: SparkSession, folder: str) -> DataFrame:
    staged = stage(mart(spark, folder).select(*ft.matrix_sources()))
    profiles = scoring.order_profiles(staged)
    fitted = ft.fit_preprocessor(staged, ["avg_product_weight_g"], stable=True)
    found = scoring.risk_factors(profiles, fitted)
    return found.select(
        "order_id",
        F.array_join("risk_factors", ",").alias("risk_factors"),
        "risk_factor_count",
    )


@query
def risk_explanations(spark: SparkSession, folder: str) -> DataFrame:
    staged = stage(mart(spark, folder).select(*ft.matrix_sources()))
    profiles = scoring.order_profiles(staged)
    fitted = ft.fit_preprocessor(staged, ["avg_product_weight_g"], stable=True)
    found = scoring.risk_factors(profiles, fitted)
    return scoring.describe_factors(found)


@query
def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    rows = scored(spark, folder)
    return rounded(
        rows.select(
            "order_id", "score", scoring.verdict(F.col("score"), DEFAULT_THRESHOLD).alias("verdict")
        )
    )


@query
def action_tiers(spark: SparkSession, folder: str) -> DataFrame:
    rows = scored(spark, folder)
    tier = scoring.action_tier(F.col("score"), SAMPLE_THRESHOLD)
    return rows.groupBy(tier.alias("action")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("label").alias("late_orders")
    )


@query
def risk_bands(spark: SparkSession, folder: str) -> DataFrame:
    band = scoring.risk_band(F.col("score"))
    return scored(spark, folder).groupBy(band.alias("risk_band")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("label").alias("late_orders")
    )


@query
def order_summary(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.order_summary(scoring.order_profiles(mart(spark, folder)))


@query
def scored_orders(spark: SparkSession, folder: str) -> DataFrame:
    model = training_run(spark, folder).model
    result = scoring.score_orders(scoring.known_orders(mart(spark, folder)), model)
    return result.select("order_id", "score", "verdict", "action", "risk_band", "risk_factor_count")


# --- Streaming


@query
def stream_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Orders scored by a stream over stored profiles."""
    model = training_run(spark, folder).model
    base = staged_path(spark)
    profiles = save_stage(scoring.known_orders(mart(spark, folder)), f"{base}/profiles")
    arriving = jobs.read_order_stream(spark, f"{base}/profiles", profiles.schema)
    flat = jobs.score_stream(arriving, model).select(
        "order_id", "score", "verdict", "action", "risk_band", "risk_factor_count"
    )
    jobs.write_stream(flat, f"{base}/scores", f"{base}/progress").awaitTermination()
    return spark.read.schema(flat.schema).parquet(f"{base}/scores")


@query
def stream_late_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Late counts per 30-day window, from a stream over the stored orders in several batches."""
    base = staged_path(spark)
    orders = save_stage(delivery_tables(spark, folder)["orders"], f"{base}/orders")
    arriving = jobs.read_order_stream(spark, f"{base}/orders", orders.schema)
    windows = jobs.late_windows(arriving)
    jobs.write_totals(windows, f"{base}/windows", f"{base}/progress").awaitTermination()
    return rounded(spark.read.schema(windows.schema).parquet(f"{base}/windows"))


def arriving_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Raw orders, items and payments with a time of arrival: items by the hour after the purchase, payments
    half an hour before it."""
    tables = delivery_tables(spark, folder)
    bought = tables["orders"].select("order_id", F.col("order_purchase_timestamp").alias("bought_at"))
    after = F.expr("bought_at + make_dt_interval(0, order_item_id)")
    before = F.expr("bought_at - INTERVAL 30 minutes")
    items = tables["order_items"].join(bought, "order_id").withColumn("arrived_at", after)
    payments = tables["payments"].join(bought, "order_id").withColumn("arrived_at", before)
    return {**tables, "order_items": items.drop("bought_at"), "payments": payments.drop("bought_at")}


@query
def incoming_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Raw orders with the parts that came in time, as the scoring stream gathers them."""
    tables = arriving_tables(spark, folder)
    arrival = incoming.Arrival(early="1 hour", wait="3 hours")
    rows = incoming.incoming_orders(tables["orders"], tables["order_items"], tables["payments"], tables, arrival)
    return rounded(scoring.known_orders(rows))
