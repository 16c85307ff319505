"""Multi-step reports and the staged run from raw tables to stored results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontide.contract import CORRELATION_COLUMNS
from ontide.operators import profile as prof
from ontide.operators import rates
from ontide.operators.correlation import correlation_matrix, correlation_with_target
from ontide.operators.evaluate import (
    business_impact,
    classification_report,
    confusion_counts,
    threshold_analysis,
)
from ontide.operators.features import Preprocessor, feature_matrix, fit_preprocessor
from ontide.operators.mart import order_mart
from ontide.operators.quantiles import quantile_bins
from ontide.operators.train import (
    TrainingRun,
    feature_importance,
    metrics_document,
    model_deltas,
    train_risk_model,
)
from ontide.plans import kpis
from ontide.session import stage, stage_scope
from ontide.sources.sinks import save_json, save_report, save_stage, save_text

FINDING_DIMENSIONS = {
    "customer_state": "worst_customer_state",
    "main_seller_state": "worst_seller_state",
    "main_product_category": "worst_category",
}


def key_findings(mart: DataFrame) -> DataFrame:
    """Totals, the worst value of each ranking and the strongest correlation, as one row."""
    measures = ["order_id", "delivery_delay_days", "delivery_days_actual"]
    needed = dict.fromkeys([*measures, *FINDING_DIMENSIONS, *CORRELATION_COLUMNS])
    data = stage(mart.select(*needed))
    totals = data.agg(
        F.count(F.lit(1)).alias("delivered_orders"),
        F.sum("is_late").alias("late_orders"),
    ).select(
        "delivered_orders",
        "late_orders",
        (F.col("delivered_orders") - F.col("late_orders")).alias("on_time_orders"),
        F.round(F.col("late_orders") / F.col("delivered_orders") * 100, 2).alias("late_pct"),
        F.round(100 - F.col("late_orders") / F.col("delivered_orders") * 100, 2).alias(
            "on_time_pct"
        ),
    )
    # One pass over the mart serves the three rankings.
    ranked = rates.late_rate_all(data, list(FINDING_DIMENSIONS))
    worst = ranked.groupBy().agg(
        *[
            F.coalesce(
                # of equal rates the smallest value
                F.min_by(
                    "value",
                    F.when(F.col("dimension") == d, F.struct(-F.col("late_rate_pct"), "value")),
                ),
                F.lit("N/A"),
            ).alias(alias)
            for d, alias in FINDING_DIMENSIONS.items()
        ]
    )
    strongest = (
        correlation_with_target(data)
        .limit(1)
        .select(
            F.col("feature").alias("strongest_feature"),
            F.col("correlation_with_late_delivery").alias("strongest_correlation"),
        )
    )
    return totals.join(F.broadcast(worst), how="cross").join(F.broadcast(strongest), how="cross")


def findings_text(findings: DataFrame) -> DataFrame:
    """The findings as lines of text."""
    lines = [
        ("Delivered orders with valid dates: %d", ["delivered_orders"]),
        ("Late orders: %d (%.2f%%)", ["late_orders", "late_pct"]),
        ("On-time or early orders: %d (%.2f%%)", ["on_time_orders", "on_time_pct"]),
        ("Accuracy of calling every order on time: %.2f%%", ["on_time_pct"]),
        ("Worst customer state: %s", ["worst_customer_state"]),
        ("Worst seller state: %s", ["worst_seller_state"]),
        ("Worst product category: %s", ["worst_category"]),
        (
            "Strongest numeric correlation with lateness: %s (%.4f)",
            ["strongest_feature", "strongest_correlation"],
        ),
    ]
    return findings.select(
        F.explode(F.array(*[F.format_string(text, *columns) for text, columns in lines])).alias(
            "value"
        )
    )


# Reports over the mart, by the name they are stored under.
MART_REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "baseline_summary": rates.baseline_summary,
    # all dimensions in one pass
    "late_by_dimension": lambda mart: rates.late_rate_all(mart, list(rates.RATE_DIMENSIONS)),
    "late_by_weekday": rates.late_rate_weekdays,
    "late_by_month": rates.late_rate_months,
    "review_by_outcome": rates.review_by_outcome,
    "delivery_histogram": lambda mart: rates.delivery_histogram(mart, 1, 100, 80),
    "delay_distribution": rates.delay_distribution,
    "top_categories": rates.top_categories,
    "state_map": lambda mart: rates.state_map(mart, rates.state_centres(mart.sparkSession)),
    "late_by_price_quartile": lambda mart: quantile_bins(mart, "total_price", "is_late"),
    "late_by_freight_quartile": lambda mart: quantile_bins(mart, "total_freight", "is_late"),
    "correlation_matrix": correlation_matrix,
    "correlation_with_target": correlation_with_target,
    "delivery_summary": kpis.delivery_summary,
    "state_late_rates": kpis.state_late_rates,
    "seller_state_ranking": kpis.seller_state_ranking,
    "worst_route_pairs": kpis.worst_route_pairs,
    "monthly_trend": kpis.monthly_trend,
}

# Reports over the raw tables.
TABLE_REPORTS: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = {
    "table_overview": prof.table_overview,
    "missing_values": prof.missing_values,
    "describe_tables": prof.describe_tables,
    "join_key_counts": prof.join_key_counts,
    "orphan_keys": prof.orphan_keys,
}

# Reports over the feature matrix.
MATRIX_REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "overall_kpis": kpis.overall_kpis,
    "route_segments": kpis.route_segments,
    "monthly_late_rate": kpis.monthly_late_rate,
    "monthly_rolling_average": kpis.monthly_rolling_average,
    "cross_state_comparison": kpis.cross_state_comparison,
}


def build_order_mart(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Store the mart by year and month, so that a report on a period reads that period.

    Rows of a month are brought together first, or every task would write a file per month;
    a large month is split by size.
    """
    keys = ["purchase_year", "purchase_month_num"]
    return save_stage(order_mart(tables).hint("rebalance", *keys), path, keys)


def run_model(mart: DataFrame, output: str, **options) -> TrainingRun:
    """Train on a stored mart, and store the model, its metrics and the reports on it."""
    spark = mart.sparkSession
    run = train_risk_model(mart, **options)
    run.model.save(spark, f"{output}/model")
    save_json(metrics_document(spark, run), f"{output}/model_metrics")
    scores = run.scored_test
    confusion = confusion_counts(scores, run.model.threshold)
    features = run.model.preprocessor.features
    reports = {
        "feature_importance": feature_importance(spark, run.model.trees, features),
        "model_deltas": model_deltas(spark, run),
        "threshold_analysis": threshold_analysis(scores),
        "business_impact": business_impact(confusion),
        "classification_report": classification_report(confusion),
    }
    for name, report in reports.items():
        save_report(report, f"{output}/reports/{name}")
    return run


def run_reports(
    tables: dict[str, DataFrame], output: str, profile: bool = True
) -> tuple[DataFrame, DataFrame, Preprocessor]:
    """Raw tables to stored mart, feature matrix and CSV reports.

    The mart and the matrix are written once; every report reads only its columns of them. What
    the operators stage on the way is removed at the end.
    """
    spark = tables["orders"].sparkSession
    with stage_scope(spark):
        if profile:
            for name, report in TABLE_REPORTS.items():
                save_report(report(tables), f"{output}/reports/{name}")
        mart = build_order_mart(tables, f"{output}/order_mart")
        fitted = fit_preprocessor(mart, stable=True)
        matrix = save_stage(feature_matrix(mart, fitted), f"{output}/feature_matrix")
        for name, report in MART_REPORTS.items():
            save_report(report(mart), f"{output}/reports/{name}")
        for name, report in MATRIX_REPORTS.items():
            save_report(report(matrix), f"{output}/reports/{name}")
        save_report(
            prof.feature_report(matrix, fitted.features), f"{output}/reports/feature_report"
        )
        save_text(findings_text(key_findings(mart)), f"{output}/reports/key_findings")
    return mart, matrix, fitted
