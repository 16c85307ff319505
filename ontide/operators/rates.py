"""Late-rate aggregations over the order mart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontide.contract import (
    LATE_LABEL,
    MIN_ORDERS_MAP,
    MIN_ORDERS_REPORT,
    MISSING_LABEL,
    ON_TIME_LABEL,
    STATE_CENTRES,
    TOP_CATEGORIES,
    TOP_CHART,
)
from ontide.functions.columns import rate_pct
from ontide.operators.quantiles import exact_quantiles
from ontide.session import stage

RATE_DIMENSIONS = [
    "customer_state",
    "main_seller_state",
    "main_payment_type",
    "main_product_category",
    "purchase_day_of_week",
    "purchase_month",
]


def outcome(on_time_label: str = ON_TIME_LABEL) -> Column:
    return F.when(F.col("is_late") == 1, LATE_LABEL).otherwise(on_time_label)


def _rate_measures() -> list[Column]:
    return [
        F.count("order_id").alias("orders"),
        F.sum("is_late").alias("late_orders"),
        F.avg("is_late").alias("late_rate"),
        F.avg("delivery_delay_days").alias("avg_delay_days"),
        F.avg("delivery_days_actual").alias("avg_delivery_days"),
        rate_pct("is_late").alias("late_rate_pct"),
    ]


def late_rate_by(
    mart: DataFrame, dimension: str, min_orders: int = MIN_ORDERS_REPORT
) -> DataFrame:
    """Late rate per value of one dimension, worst first; null counts as "missing"."""
    value = F.coalesce(F.col(dimension), F.lit(MISSING_LABEL)).alias(dimension)
    return (
        mart.groupBy(value)
        .agg(*_rate_measures())
        .filter(F.col("orders") >= min_orders)
        .orderBy(F.desc("late_rate_pct"), dimension)
    )


def late_rate_all(
    mart: DataFrame,
    dimensions: Sequence[str] = RATE_DIMENSIONS,
    min_orders: int = MIN_ORDERS_REPORT,
) -> DataFrame:
    """`late_rate_by` for several dimensions in one pass over the mart.

    Grouping sets expand each row once per dimension; the expanded rows combine before
    the shuffle, which carries one row per task and value.
    """
    named = mart.withColumns(
        {d: F.coalesce(F.col(d), F.lit(MISSING_LABEL)) for d in dimensions}
    )
    grouped = named.groupingSets([[F.col(d)] for d in dimensions], *dimensions).agg(
        *_rate_measures(), *[F.grouping(d).alias(f"absent_{d}") for d in dimensions]
    )
    which = F.coalesce(*[F.when(F.col(f"absent_{d}") == 0, d) for d in dimensions])
    value = F.coalesce(*[F.when(F.col(f"absent_{d}") == 0, F.col(d)) for d in dimensions])
    return (
        grouped.filter(F.col("orders") >= min_orders)
        .select(
            which.alias("dimension"),
            value.alias("value"),
            "orders",
            "late_orders",
            "late_rate",
            "avg_delay_days",
            "avg_delivery_days",
            "late_rate_pct",
        )
        .orderBy("dimension", F.desc("late_rate_pct"), "value")
    )


def top_chart_rows(mart: DataFrame, dimension: str, size: int = TOP_CHART) -> DataFrame:
    return late_rate_by(mart, dimension).limit(size)


def baseline_summary(mart: DataFrame) -> DataFrame:
    """Totals, rates, and mean and median durations."""
    durations = ["delivery_days_actual", "delivery_delay_days"]
    data = stage(mart.select("is_late", *durations))
    medians = exact_quantiles(data, durations, [0.5], stable=True)
    late = F.sum("is_late")
    return data.agg(
        F.count(F.lit(1)).alias("delivered_orders_with_valid_dates"),
        late.alias("late_orders"),
        (F.count(F.lit(1)) - late).alias("on_time_orders"),
        F.round(rate_pct("is_late"), 2).alias("late_rate_pct"),
        F.round(F.lit(100) - rate_pct("is_late"), 2).alias("on_time_rate_pct"),
        F.round(F.lit(100) - rate_pct("is_late"), 2).alias(
            "baseline_accuracy_if_predict_all_on_time"
        ),
        F.round(F.avg("delivery_days_actual"), 2).alias("avg_delivery_days"),
        F.round(F.lit(medians["delivery_days_actual"][0]).cast("double"), 2).alias(
            "median_delivery_days"
        ),
        F.round(F.avg("delivery_delay_days"), 2).alias("avg_delay_days"),
        F.round(F.lit(medians["delivery_delay_days"][0]).cast("double"), 2).alias(
            "median_delay_days"
        ),
    )


def _rate_and_count(mart: DataFrame, *keys: Column | str) -> DataFrame:
    return mart.groupBy(*keys).agg(
        F.avg("is_late").alias("late_rate"),
        F.count("is_late").alias("order_count"),
        rate_pct("is_late").alias("late_rate_pct"),
    )


def late_rate_weekdays(mart: DataFrame) -> DataFrame:
    """Rate per weekday in week order, Monday first."""
    number = F.weekday("order_purchase_timestamp").alias("weekday_num")
    return _rate_and_count(mart, number, "purchase_day_of_week").orderBy("weekday_num")


def late_rate_months(mart: DataFrame) -> DataFrame:
    """Rate per month name in calendar order; years fall together."""
    return _rate_and_count(mart, "purchase_month_num", "purchase_month").orderBy(
        "purchase_month_num"
    )


def review_by_outcome(mart: DataFrame) -> DataFrame:
    """Mean review score of reviewed orders per outcome."""
    return (
        mart.filter(F.col("avg_review_score").isNotNull())
        .groupBy("is_late")
        .agg(
            F.avg("avg_review_score").alias("avg_review_score"),
            F.count("order_id").alias("orders"),
        )
        .select(outcome().alias("outcome"), "avg_review_score", "orders")
        .orderBy("outcome")
    )


def delivery_histogram(
    mart: DataFrame, low: float, high: float, bins: int, on_time_label: str = ON_TIME_LABEL
) -> DataFrame:
    """Orders per delivery-time bin and outcome, for times in [low, high].

    Bins have equal width and are closed on the left; the last one also on the right.
    """
    width = (high - low) / bins
    days = F.col("delivery_days_actual")
    index = F.least(F.floor((days - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return (
        mart.filter(days.between(low, high))
        .groupBy(index.alias("bin_index"), outcome(on_time_label).alias("outcome"))
        .agg(F.count(F.lit(1)).alias("orders"))
        .withColumns(
            {
                "bin_start": F.lit(low) + F.col("bin_index") * F.lit(width),
                "bin_end": F.lit(low) + (F.col("bin_index") + 1) * F.lit(width),
            }
        )
        .orderBy("bin_index", "outcome")
    )


def delay_distribution(mart: DataFrame, low: float = -60, high: float = 60) -> DataFrame:
    """Five-number summary of the delay per outcome, for delays in [low, high]."""
    delay = F.col("delivery_delay_days")
    data = stage(mart.filter(delay.between(low, high)).select("is_late", "delivery_delay_days"))
    parts = {
        "late": F.when(F.col("is_late") == 1, delay),
        "on_time": F.when(F.col("is_late") == 0, delay),
    }
    found = exact_quantiles(data, parts, [0.25, 0.5, 0.75], stable=True)
    late = F.col("is_late") == 1
    quartiles = {
        name: F.when(late, F.lit(found["late"][i]).cast("double")).otherwise(
            F.lit(found["on_time"][i]).cast("double")
        )
        for i, name in enumerate(["p25_delay", "median_delay", "p75_delay"])
    }
    return (
        data.groupBy("is_late")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.min("delivery_delay_days").alias("min_delay"),
            F.max("delivery_delay_days").alias("max_delay"),
        )
        .select(
            outcome().alias("outcome"),
            "orders",
            "min_delay",
            *[v.alias(k) for k, v in quartiles.items()],
            "max_delay",
        )
        .orderBy("outcome")
    )


def top_categories(
    mart: DataFrame, size: int = TOP_CATEGORIES, min_orders: int = MIN_ORDERS_REPORT
) -> DataFrame:
    """Riskiest known product categories."""
    return (
        _rate_and_count(
            mart.filter(F.col("main_product_category").isNotNull()), "main_product_category"
        )
        .filter(F.col("order_count") >= min_orders)
        .orderBy(F.desc("late_rate_pct"), "main_product_category")
        .limit(size)
    )


def state_centres(spark, centres: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    rows = [(state, lat, lon) for state, (lat, lon) in (centres or STATE_CENTRES).items()]
    return spark.createDataFrame(rows, "state string, lat double, lon double")


def state_map(
    mart: DataFrame,
    centres: DataFrame,
    state_column: str = "customer_state",
    min_orders: int = MIN_ORDERS_MAP,
) -> DataFrame:
    """Rate and orders per state with coordinates; unknown states are left out."""
    rates = mart.groupBy(F.col(state_column).alias("state")).agg(
        F.avg("is_late").alias("late_rate"),
        F.count("is_late").alias("orders"),
        rate_pct("is_late").alias("late_rate_pct"),
    )
    # The centres are a constant table of states.
    return (
        rates.filter(F.col("orders") >= min_orders)
        .join(F.broadcast(centres), "state", "left")
        .dropna(subset=["lat", "lon"])
        .orderBy("state")
    )


def state_ranking(states: DataFrame) -> DataFrame:
    return states.select(
        F.col("state").alias("State"),
        F.col("orders").alias("Orders"),
        F.round("late_rate_pct", 1).alias("Late %"),
    ).orderBy(F.desc("Late %"), "State")


def category_list(mart: DataFrame) -> DataFrame:
    return (
        mart.select("main_product_category")
        .filter(F.col("main_product_category").isNotNull())
        .distinct()
        .orderBy("main_product_category")
    )
