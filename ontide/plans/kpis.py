"""KPI queries over the order mart and the feature matrix, rounded for presentation.

Each query lists its keys and measures; the measures are defined once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontide.contract import (
    MIN_ORDERS_RANKING,
    MIN_ORDERS_REPORT,
    TOP_ROUTES,
    TOP_STATES,
)
from ontide.functions.columns import rate_pct

PRESENTATION_DIGITS = 2


def _mean(column: str) -> Column:
    return F.round(F.avg(column), PRESENTATION_DIGITS)


def _measures(*names: str) -> list[Column]:
    late = F.sum("is_late")
    orders = F.count(F.lit(1))
    known = {
        "total_orders": orders,
        "total_delivered_orders": orders,
        "late_orders": late,
        "on_time_orders": orders - late,
        "late_rate_pct": F.round(rate_pct("is_late"), PRESENTATION_DIGITS),
        "on_time_rate_pct": F.round((1 - F.avg("is_late")) * 100, PRESENTATION_DIGITS),
        "cross_state_rate_pct": F.round(rate_pct("cross_state"), PRESENTATION_DIGITS),
        "avg_estimated_delivery_days": _mean("delivery_days_estimated"),
        "avg_estimated_days": _mean("delivery_days_estimated"),
        "avg_actual_delivery_days": _mean("delivery_days_actual"),
        "avg_delay_days": _mean("delivery_delay_days"),
        "avg_order_value": _mean("total_price"),
        "avg_freight_value": _mean("total_freight"),
        "avg_freight": _mean("total_freight"),
    }
    return [known[name].alias(name) for name in names]


def _worst_first(report: DataFrame, *keys: str) -> DataFrame:
    """Keys break ties, so that a following limit is repeatable."""
    return report.orderBy(F.desc("late_rate_pct"), *keys)


def overall_kpis(matrix: DataFrame) -> DataFrame:
    return matrix.agg(
        *_measures(
            "total_orders",
            "late_orders",
            "on_time_orders",
            "late_rate_pct",
            "avg_estimated_delivery_days",
            "avg_order_value",
            "avg_freight_value",
            "cross_state_rate_pct",
        )
    )


_PLACE_MEASURES = (
    "total_orders",
    "late_orders",
    "late_rate_pct",
    "avg_actual_delivery_days",
    "avg_delay_days",
)


def state_late_rates(
    mart: DataFrame, min_orders: int = MIN_ORDERS_REPORT, size: int = TOP_STATES
) -> DataFrame:
    """Customer states by late rate."""
    report = (
        mart.filter(F.col("customer_state").isNotNull())
        .groupBy("customer_state")
        .agg(*_measures(*_PLACE_MEASURES))
        .filter(F.col("total_orders") >= min_orders)
    )
    return _worst_first(report, "customer_state").limit(size)


def seller_state_ranking(
    mart: DataFrame, min_orders: int = MIN_ORDERS_RANKING, size: int = TOP_STATES
) -> DataFrame:
    """Seller states by late rate."""
    report = (
        mart.filter(F.col("main_seller_state").isNotNull())
        .groupBy(F.col("main_seller_state").alias("seller_state"))
        .agg(*_measures(*_PLACE_MEASURES))
        .filter(F.col("total_orders") >= min_orders)
    )
    return _worst_first(report, "seller_state").limit(size)


def worst_route_pairs(
    mart: DataFrame, min_orders: int = MIN_ORDERS_RANKING, size: int = TOP_ROUTES
) -> DataFrame:
    """Seller state to customer state routes by late rate."""
    seller, customer = F.col("main_seller_state"), F.col("customer_state")
    report = (
        mart.filter(seller.isNotNull() & customer.isNotNull())
        .groupBy(seller.alias("seller_state"), customer)
        .agg(*_measures(*_PLACE_MEASURES))
        .filter(F.col("total_orders") >= min_orders)
        .withColumn("route_pair", F.concat_ws(" → ", "seller_state", "customer_state"))
    )
    ranked = _worst_first(report, "seller_state", "customer_state").limit(size)
    return ranked.select("seller_state", "customer_state", "route_pair", *_PLACE_MEASURES)


def route_segments(matrix: DataFrame) -> DataFrame:
    """Route type by seller complexity."""
    route = F.when(F.col("cross_state") == 1, "Cross-state").otherwise("Same-state")
    sellers = F.when(F.col("seller_count") >= 2, "Multi-seller").otherwise("Single-seller")
    report = matrix.groupBy(route.alias("route_type"), sellers.alias("seller_complexity")).agg(
        *_measures(
            "total_orders", "late_orders", "late_rate_pct", "avg_freight", "avg_estimated_days"
        )
    )
    return _worst_first(report, "route_type", "seller_complexity")


def cross_state_comparison(matrix: DataFrame) -> DataFrame:
    label = F.when(F.col("cross_state") == 1, "Cross-state shipment").otherwise(
        "Same-state shipment"
    )
    report = matrix.groupBy(label.alias("shipment_type")).agg(
        *_measures(
            "total_orders",
            "late_orders",
            "late_rate_pct",
            "avg_freight_value",
            "avg_estimated_delivery_days",
        )
    )
    return _worst_first(report, "shipment_type")


_MONTH_MEASURES = ("total_orders", "late_orders", "late_rate_pct", "avg_freight_value")


def monthly_late_rate(matrix: DataFrame) -> DataFrame:
    """Rate per month number; the same month of several years falls together."""
    return (
        matrix.groupBy("purchase_month_num")
        .agg(*_measures(*_MONTH_MEASURES))
        .orderBy("purchase_month_num")
    )


def monthly_rolling_average(matrix: DataFrame, months: int = 3) -> DataFrame:
    """Rolling mean of the presented monthly rates.

    The window has no partition: it runs over at most twelve aggregated rows.
    """
    frame = Window.orderBy("purchase_month_num").rowsBetween(1 - months, Window.currentRow)
    return monthly_late_rate(matrix).withColumn(
        f"rolling_{months}_month_late_rate_pct",
        F.round(F.avg("late_rate_pct").over(frame), PRESENTATION_DIGITS),
    )


def monthly_trend(mart: DataFrame, months: int = 3) -> DataFrame:
    """The rolling rate along the calendar, one row per year and month."""
    frame = Window.orderBy("purchase_year", "purchase_month_num").rowsBetween(
        1 - months, Window.currentRow
    )
    return (
        mart.groupBy("purchase_year", "purchase_month_num")
        .agg(*_measures("total_orders", "late_orders", "late_rate_pct"))
        .withColumn(
            f"rolling_{months}_month_late_rate_pct",
            F.round(F.avg("late_rate_pct").over(frame), PRESENTATION_DIGITS),
        )
        .orderBy("purchase_year", "purchase_month_num")
    )


def delivery_summary(mart: DataFrame) -> DataFrame:
    return mart.agg(
        *_measures(
            "total_delivered_orders",
            "late_orders",
            "on_time_orders",
            "on_time_rate_pct",
            "late_rate_pct",
            "avg_actual_delivery_days",
            "avg_delay_days",
        )
    )
