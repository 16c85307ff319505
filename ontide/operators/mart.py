"""The order mart: one wide row per delivered order."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontide.contract import DELIVERED_STATUS
from ontide.functions.aggregates import count_where, money_sum, most_common
from ontide.functions.columns import days_between, flag
from ontide.operators.joins import Lookup, lookup_join, sized_lookups

LABEL_DATES = [
    "order_purchase_timestamp",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
]

ITEM_FEATURE_COLUMNS = [
    "total_price",
    "total_freight",
    "item_count",
    "product_count",
    "seller_count",
    "avg_product_weight_g",
    "avg_product_length_cm",
    "avg_product_height_cm",
    "avg_product_width_cm",
    "avg_product_volume_cm3",
    "main_product_category",
    "main_seller_state",
    "main_seller_city",
]

MART_COLUMNS = [
    "order_id",
    "customer_id",
    "order_status",
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
    "delivery_days_actual",
    "delivery_days_estimated",
    "delivery_delay_days",
    "is_late",
    "purchase_year",
    "purchase_month_num",
    "purchase_month",
    "purchase_day_of_week",
    "purchase_hour",
    "customer_city",
    "customer_state",
    *ITEM_FEATURE_COLUMNS,
    "total_payment_value",
    "max_payment_installments",
    "payment_count",
    "main_payment_type",
    "avg_review_score",
    "review_count",
]


def is_delivered() -> Column:
    return F.col("order_status") == DELIVERED_STATUS


def delivered_orders(orders: DataFrame) -> DataFrame:
    """Delivered orders whose lateness can be decided."""
    return orders.filter(is_delivered()).dropna(subset=LABEL_DATES)


def dropped_orders(orders: DataFrame) -> DataFrame:
    """How many delivered orders the date filter removes."""
    dated = F.lit(True)
    for column in LABEL_DATES:
        dated = dated & F.col(column).isNotNull()
    return orders.agg(
        count_where(is_delivered()).alias("delivered_orders"),
        count_where(is_delivered() & dated).alias("kept_orders"),
    ).withColumn("dropped_orders", F.col("delivered_orders") - F.col("kept_orders"))


def with_durations(orders: DataFrame, by_date: bool = False) -> DataFrame:
    """Three durations in days and the late label.

    The label compares full timestamps; `by_date` compares calendar days instead.
    """
    timed = orders.withColumns(
        {
            "delivery_days_actual": days_between(
                "order_purchase_timestamp", "order_delivered_customer_date"
            ),
            "delivery_days_estimated": days_between(
                "order_purchase_timestamp", "order_estimated_delivery_date"
            ),
            "delivery_delay_days": days_between(
                "order_estimated_delivery_date", "order_delivered_customer_date"
            ),
        }
    )
    if by_date:
        late = F.to_date("order_delivered_customer_date") > F.to_date(
            "order_estimated_delivery_date"
        )
    else:
        late = F.col("delivery_delay_days") > 0
    return timed.withColumn("is_late", flag(late))


def with_time_parts(orders: DataFrame) -> DataFrame:
    bought = F.col("order_purchase_timestamp")
    return orders.withColumns(
        {
            "purchase_year": F.year(bought),
            "purchase_month_num": F.month(bought),
            "purchase_month": F.date_format(F.to_date(bought), "MMMM"),
            "purchase_day_of_week": F.date_format(F.to_date(bought), "EEEE"),
            "purchase_hour": F.hour(bought),
        }
    )


def with_volume(products: DataFrame) -> DataFrame:
    return products.withColumn(
        "product_volume_cm3",
        F.col("product_length_cm") * F.col("product_height_cm") * F.col("product_width_cm"),
    )


def enrich_items(
    items: DataFrame, products: DataFrame, translation: DataFrame, sellers: DataFrame
) -> DataFrame:
    """Items with product measures, translated category and seller place.

    The narrow translation is joined to the products first: that touches each product
    once instead of each item.
    """
    lookups = sized_lookups(
        {"products": products, "category_translation": translation, "sellers": sellers}
    )
    return _enrich(items, lookups)


def described_products(lookups: Mapping[str, Lookup]) -> Lookup:
    """Products with their volume and translated category."""
    described = lookup_join(
        with_volume(lookups["products"].table),
        lookups["category_translation"],
        "product_category_name",
    )
    return lookups["products"].extended(described)


def seller_places(lookups: Mapping[str, Lookup]) -> Lookup:
    places = lookups["sellers"].table.select("seller_id", "seller_city", "seller_state")
    return lookups["sellers"].extended(places)


def _enrich(items: DataFrame, lookups: Mapping[str, Lookup]) -> DataFrame:
    with_products = lookup_join(items, described_products(lookups), "product_id")
    return lookup_join(with_products, seller_places(lookups), "seller_id")


def _gathered(enriched: DataFrame, lookups: Mapping[str, Lookup]) -> DataFrame:
    """Items next to those of their order, if a lookup has dealt them out by its own key.

    Spread over all tasks they would be aggregated one by one before they move, which costs more than the move.
    """
    spread = [each for each in (described_products(lookups), seller_places(lookups)) if not each.is_small()]
    return enriched.repartition("order_id") if spread else enriched


def item_aggregates() -> dict[str, Column]:
    """All item features of a group of enriched items.

    The distinct counts are sizes of sets. A set holds the products of one order, and a task
    has what it holds of it already reduced before the shuffle.
    """

    def distinct(column: str) -> Column:
        return F.size(F.collect_set(column)).cast("bigint")

    return {
        "total_price": money_sum("price"),
        "total_freight": money_sum("freight_value"),
        "item_count": F.count("order_item_id"),
        "product_count": distinct("product_id"),
        "seller_count": distinct("seller_id"),
        "avg_product_weight_g": F.avg("product_weight_g"),
        "avg_product_length_cm": F.avg("product_length_cm"),
        "avg_product_height_cm": F.avg("product_height_cm"),
        "avg_product_width_cm": F.avg("product_width_cm"),
        "avg_product_volume_cm3": F.avg("product_volume_cm3"),
        "main_product_category": most_common("product_category_name_english"),
        "main_seller_state": most_common("seller_state"),
        "main_seller_city": most_common("seller_city"),
    }


def payment_aggregates() -> dict[str, Column]:
    """All payment features of a group of payments."""
    return {
        "total_payment_value": money_sum("payment_value"),
        "max_payment_installments": F.max("payment_installments"),
        "payment_count": F.count("payment_sequential"),
        "main_payment_type": most_common("payment_type"),
    }


def named(columns: dict[str, Column]) -> list[Column]:
    return [column.alias(name) for name, column in columns.items()]


def item_measures(enriched: DataFrame) -> DataFrame:
    """All item features per order, in one aggregate that combines before the shuffle."""
    return enriched.groupBy("order_id").agg(*named(item_aggregates()))


def item_features(
    items: DataFrame, products: DataFrame, translation: DataFrame, sellers: DataFrame
) -> DataFrame:
    """Item aggregates per order, from one scan and one exchange of the items."""
    return _per_order(enrich_items(items, products, translation, sellers))


def _per_order(enriched: DataFrame) -> DataFrame:
    return item_measures(enriched).select("order_id", *ITEM_FEATURE_COLUMNS)


def payment_features(payments: DataFrame) -> DataFrame:
    return payments.groupBy("order_id").agg(*named(payment_aggregates()))


def review_features(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("order_id").agg(
        F.avg("review_score").alias("avg_review_score"),
        F.count("review_id").alias("review_count"),
    )


def order_mart(tables: dict[str, DataFrame], by_date: bool = False) -> DataFrame:
    """One row per delivered order with label, time parts and per-order features.

    Items, payments and reviews are reduced to one row per order before the joins, which
    prevents fan-out. The customer join comes first, while rows are narrow; the three
    order_id joins then share one partitioning. A report that uses none of the features
    of a side does not read that side: the optimizer drops a left join against a side
    that is unique on the key.
    """
    orders = with_time_parts(with_durations(delivered_orders(tables["orders"]), by_date))
    lookups = sized_lookups(
        {n: tables[n] for n in ("customers", "products", "category_translation", "sellers")}
    )
    places = lookups["customers"].table.select("customer_id", "customer_city", "customer_state")
    items = tables["order_items"]
    return (
        lookup_join(orders, lookups["customers"].extended(places), "customer_id")
        .join(_per_order(_gathered(_enrich(items, lookups), lookups)), "order_id", "left")
        .join(payment_features(tables["payments"]), "order_id", "left")
        .join(review_features(tables["reviews"]), "order_id", "left")
        .select(*MART_COLUMNS)
    )
