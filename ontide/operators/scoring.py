"""Scoring of order tables: probability, verdict, action, band and risk factors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontide.contract import (
    BAND_EDGES,
    CATEGORICAL_COLUMNS,
    ESCALATE_FROM,
    FREIGHT_RATIO_MAX,
    RISK_FREIGHT_RATIO,
    RISK_INSTALLMENTS,
    RISK_LONG_WINDOW_DAYS,
    RISK_WEEKDAYS,
    RISK_WEIGHT_DEFAULT_G,
    RISK_WEIGHT_FACTOR,
    SCORING_DEFAULTS,
    WATCH_FROM,
    WEEKEND_DAYS,
)
from ontide.functions.columns import clip, flag
from ontide.operators.features import (
    Preprocessor,
    build_derived_features,
    freight_ratio,
    price_per_item,
)
from ontide.operators.train import RiskModel

# Counts that a bare profile has no attribute for.
SINGLE_COUNTS = ["product_count", "seller_count", "payment_count"]

PROFILE_COLUMNS = [
    "delivery_days_estimated",
    "total_price",
    "total_freight",
    "item_count",
    "avg_product_weight_g",
    "main_seller_state",
    "customer_state",
    "main_product_category",
    "main_payment_type",
    "installments",
    "purchase_day_of_week",
    "purchase_month_num",
    "purchase_hour",
]


# What a stored order knows beside its profile.
KNOWN_COLUMNS = [
    "product_count",
    "seller_count",
    "payment_count",
    "avg_product_length_cm",
    "avg_product_height_cm",
    "avg_product_width_cm",
    "avg_product_volume_cm3",
    "total_payment_value",
    "approval_time_hours",
]


def order_profiles(mart: DataFrame, columns: Sequence[str] = PROFILE_COLUMNS) -> DataFrame:
    """The thirteen attributes that describe an incoming order, or those asked for."""
    return mart.withColumnRenamed("max_payment_installments", "installments").select("order_id", *columns)


def known_orders(
    mart: DataFrame, columns: Sequence[str] = (*PROFILE_COLUMNS, *KNOWN_COLUMNS)
) -> DataFrame:
    """Stored orders with all that is known of them: the profile and the model's other sources."""
    derived = build_derived_features(mart)
    return derived.withColumnRenamed("max_payment_installments", "installments").select("order_id", *columns)


def scoring_inputs(profiles: DataFrame, fitted: Preprocessor) -> DataFrame:
    """Model inputs for order profiles.

    A bare profile counts as one product, one seller and one payment. Any other column the
    profile lacks takes its learned fill value, else its default, else 0. A null in a column that it has takes
    the learned fill value, as in training. Categories keep their text for the pipeline's encoder.
    """
    price, freight = F.col("total_price"), F.col("total_freight")
    built = {
        "max_payment_installments": F.col("installments"),
        "is_weekend": flag(F.col("purchase_day_of_week").isin(WEEKEND_DAYS)),
        "cross_state": flag(F.col("customer_state") != F.col("main_seller_state")),
        "freight_ratio": clip(freight_ratio(freight, price), upper=FREIGHT_RATIO_MAX),
        "price_per_item": price_per_item(price, F.col("item_count")),
        "total_payment_value": price + freight,
        **{name: F.lit(SCORING_DEFAULTS[name]) for name in SINGLE_COUNTS},
    }
    # What the caller knows beats what can be derived from the profile.
    derived = profiles.withColumns(
        {name: value for name, value in built.items() if name not in profiles.columns}
    )
    complete = {}
    for name in fitted.features:
        if name.endswith("_encoded"):
            continue
        default = F.lit(float(fitted.numeric_fill.get(name, SCORING_DEFAULTS.get(name, 0.0))))
        value = F.col(name).cast("double") if name in derived.columns else F.lit(None)
        complete[name] = F.coalesce(value, default)
    for name in CATEGORICAL_COLUMNS:
        if name not in fitted.labels:
            continue
        if name not in derived.columns:
            complete[name] = F.lit(None).cast("string")
        elif name in fitted.text_fill:
            complete[name] = F.coalesce(F.col(name).cast("string"), F.lit(fitted.text_fill[name]))
    return derived.withColumns(complete)


def verdict(probability: Column, threshold: float) -> Column:
    return F.when(probability >= threshold, "HIGH RISK").otherwise("LOW RISK")


def action_tier(probability: Column, threshold: float) -> Column:
    """Escalation comes first: a threshold above its limit does not block it."""
    return (
        F.when(probability >= ESCALATE_FROM, "escalate")
        .when(probability >= threshold, "monitor")
        .when(probability >= WATCH_FROM, "watch")
        .otherwise("standard")
    )


def risk_band(probability: Column) -> Column:
    low, high = BAND_EDGES
    return F.when(probability < low, "low").when(probability < high, "medium").otherwise("high")


def risk_factors(profiles: DataFrame, fitted: Preprocessor) -> DataFrame:
    """Add `risk_factors`, the rules an order meets, and their number.

    An unknown attribute meets no rule.
    """
    weight_limit = RISK_WEIGHT_FACTOR * fitted.numeric_fill.get(
        "avg_product_weight_g", RISK_WEIGHT_DEFAULT_G
    )
    ratio = freight_ratio(F.col("total_freight"), F.col("total_price"))
    rules = [
        (F.col("delivery_days_estimated") > RISK_LONG_WINDOW_DAYS, "long_promised_window"),
        (F.col("customer_state") != F.col("main_seller_state"), "cross_state_shipment"),
        (ratio > RISK_FREIGHT_RATIO, "high_freight_ratio"),
        (F.col("purchase_day_of_week").isin(RISK_WEEKDAYS), "weekend_order"),
        (F.col("avg_product_weight_g") > weight_limit, "heavy_product"),
        (F.col("installments") > RISK_INSTALLMENTS, "many_installments"),
    ]
    met = F.array_compact(F.array(*[F.when(rule, name) for rule, name in rules]))
    return profiles.withColumn("risk_factors", met).withColumn(
        "risk_factor_count", F.size("risk_factors")
    )


def describe_factors(with_factors: DataFrame) -> DataFrame:
    """One readable line per order and risk factor."""

    def text(template: str, value: Column) -> Column:
        return F.format_string(template, value)

    factor = F.col("factor")
    line = (
        F.when(
            factor == "long_promised_window",
            text("promised window of %.1f days", F.col("delivery_days_estimated")),
        )
        .when(
            factor == "cross_state_shipment",
            F.concat(F.lit("ships from "), "main_seller_state", F.lit(" to "), "customer_state"),
        )
        .when(
            factor == "high_freight_ratio",
            text("freight is %.2f of the price", freight_ratio(F.col("total_freight"), F.col("total_price"))),
        )
        .when(factor == "weekend_order", F.concat(F.lit("ordered on a "), "purchase_day_of_week"))
        .when(
            factor == "heavy_product",
            text("mean product weight of %.1f kg", F.col("avg_product_weight_g") / 1000),
        )
        .otherwise(text("%d installments", F.col("installments").cast("int")))
    )
    return with_factors.withColumn("factor", F.explode("risk_factors")).select(
        "order_id", "factor", line.alias("explanation")
    )


def with_decisions(scored: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    probability = F.col(score)
    return scored.withColumns(
        {
            "verdict": verdict(probability, threshold),
            "action": action_tier(probability, threshold),
            "risk_band": risk_band(probability),
        }
    )


def score_orders(profiles: DataFrame, model: RiskModel) -> DataFrame:
    """Probability, decisions and risk factors per order. Works on tables and streams."""
    factors = risk_factors(profiles, model.preprocessor).select(
        "*", F.struct(*PROFILE_COLUMNS).alias("profile")
    )
    scored = model.pipeline.transform(scoring_inputs(factors, model.preprocessor))
    result = scored.select(
        "order_id",
        "profile",
        vector_to_array("probability")[1].alias("score"),
        "risk_factors",
        "risk_factor_count",
    )
    return with_decisions(result, model.threshold)


def order_summary(profiles: DataFrame) -> DataFrame:
    """One row per order and attribute, the value as text."""
    price, freight = F.col("total_price"), F.col("total_freight")
    attributes = {
        "delivery_days_estimated": F.round("delivery_days_estimated", 4),
        "total_price": F.round(price, 2),
        "total_freight": F.round(freight, 2),
        "freight_ratio": F.round(clip(freight_ratio(freight, price), upper=FREIGHT_RATIO_MAX), 3),
        "price_per_item": F.round(price_per_item(price, F.col("item_count")), 2),
        "avg_product_weight_g": F.round("avg_product_weight_g", 2),
        "is_weekend": flag(F.col("purchase_day_of_week").isin(WEEKEND_DAYS)),
        "cross_state": flag(F.col("customer_state") != F.col("main_seller_state")),
        "seller_state": F.col("main_seller_state"),
        "customer_state": F.col("customer_state"),
        "product_category": F.col("main_product_category"),
        "payment_type": F.col("main_payment_type"),
        "installments": F.col("installments"),
        "purchase_hour": F.col("purchase_hour"),
        "purchase_month_num": F.col("purchase_month_num"),
        "purchase_day_of_week": F.col("purchase_day_of_week"),
    }
    types = {name: kind for name, kind in profiles.select(*[v.alias(k) for k, v in attributes.items()]).dtypes}
    entries = []
    for name, value in attributes.items():
        if types[name] == "double":
            # A fixed number of digits: text of a double differs between engines.
            value = F.format_string("%.4f", value)
            value = F.when(attributes[name].isNotNull(), value)
        entries.append(
            F.struct(F.lit(name).alias("attribute"), value.cast("string").alias("value"))
        )
    return profiles.select("order_id", F.inline(F.array(*entries)))


def kpi_row(metrics: DataFrame) -> DataFrame:
    """Headline figures of a metrics document."""
    best = F.col("at_optimal_threshold")
    return metrics.select(
        F.col("n_train").alias("training_orders"),
        F.round((1 - F.col("late_rate_train")) * 100, 1).alias("on_time_baseline_pct"),
        best["auc_roc"].alias("auc_roc"),
        (best["auc_roc"] - 0.5).alias("auc_gain_over_random"),
        (best["recall"] * 100).alias("late_orders_caught_pct"),
        F.col("optimal_threshold").alias("threshold"),
    )


def threshold_comparison(metrics: DataFrame) -> DataFrame:
    """Each metric at the chosen and at the default threshold."""
    names = ["auc_roc", "recall", "precision", "f1", "tp", "fp"]
    entries = [
        F.struct(
            F.lit(name).alias("metric"),
            F.col("at_optimal_threshold")[name].cast("double").alias("at_optimal"),
            F.col("at_default_threshold")[name].cast("double").alias("at_default"),
        )
        for name in names
    ]
    for name in ("n_train", "n_features"):
        entries.append(
            F.struct(
                F.lit(name).alias("metric"),
                F.col(name).cast("double").alias("at_optimal"),
                F.lit(None).cast("double").alias("at_default"),
            )
        )
    return metrics.select(F.inline(F.array(*entries)))
