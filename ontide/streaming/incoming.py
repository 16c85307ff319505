"""Scoring of raw orders as they come in: orders, items and payments as three streams.

Items and payments follow their order, or run ahead of it, by some time. They are one stream of parts, joined
to the orders on the id within `wait` of the purchase; both sides are kept in state until the
watermark has passed that time. The joined rows are reduced to one row per order by an aggregate with
the mart's own expressions, which is final once no part can come any more. So an order is scored
once, with all that came in time. Products, sellers, customers and the translation are stored tables.

The same functions work on stored tables, where every part counts that lies within the time.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontide.functions.columns import days_between
from ontide.operators.joins import Lookup, lookup_join, sized_lookups
from ontide.operators.mart import (
    ITEM_FEATURE_COLUMNS,
    described_products,
    item_aggregates,
    named,
    payment_aggregates,
    seller_places,
    with_time_parts,
)
from ontide.operators.scoring import known_orders, score_orders
from ontide.operators.train import RiskModel

ORDER_COLUMNS = [
    "order_id",
    "order_purchase_timestamp",
    "order_approved_at",
    "order_estimated_delivery_date",
    "customer_city",
    "customer_state",
]


@dataclass(frozen=True)
class Arrival:
    """How far parts may lie from the purchase, and how far a stream may run behind its newest event."""

    early: str = "1 hour"
    wait: str = "2 days"
    lateness: str = "1 day"


def incoming_parts(items: DataFrame, payments: DataFrame, known: Mapping[str, Lookup]) -> DataFrame:
    """Items, with the lookups `known` by their key, and payments, as rows of one stream with `arrived_at`."""
    for key, lookup in known.items():
        items = lookup_join(items, lookup, key)
    parts = items.withColumn("part", F.lit("item")).unionByName(
        payments.withColumn("part", F.lit("payment")), allowMissingColumns=True
    )
    return parts.withColumnRenamed("order_id", "part_of").withColumn(
        "arrived_at", F.col("arrived_at").cast("timestamp")
    )


def incoming_orders(
    orders: DataFrame,
    items: DataFrame,
    payments: DataFrame,
    lookups: Mapping[str, DataFrame],
    arrival: Arrival = Arrival(),
) -> DataFrame:
    """One row per order with the sources of all model features. An order without items or without
    payments has null there, as in the mart; a part without an order gives nothing.

    Products and sellers that are broadcast meet the parts after these have moved to their orders, so what
    moves and is kept in state stays narrow."""
    names = ("customers", "products", "category_translation", "sellers")
    sized = sized_lookups({name: lookups[name] for name in names})
    places = lookups["customers"].select("customer_id", "customer_city", "customer_state")
    bought = lookup_join(orders, sized["customers"].extended(places), "customer_id").select(
        *ORDER_COLUMNS, F.col("order_purchase_timestamp").cast("timestamp").alias("purchased_at")
    )
    known = {"product_id": described_products(sized), "seller_id": seller_places(sized)}
    parts = incoming_parts(items, payments, {k: v for k, v in known.items() if not v.is_small()})
    if orders.isStreaming:
        bought = bought.withWatermark("purchased_at", arrival.lateness)
        parts = parts.withWatermark("arrived_at", arrival.lateness)
    together = F.expr(
        f"""order_id = part_of AND arrived_at >= purchased_at - INTERVAL {arrival.early}
        AND arrived_at <= purchased_at + INTERVAL {arrival.wait}"""
    )
    joined = bought.join(parts, together, "left_outer")
    for key, lookup in known.items():
        if lookup.is_small():
            joined = lookup_join(joined, lookup, key)
    grouped = joined.groupBy(*ORDER_COLUMNS, "purchased_at").agg(
        *named(item_aggregates()),
        *named(payment_aggregates()),
        F.count_if(F.coalesce(F.col("part") == "item", F.lit(False))).alias("item_rows"),
        F.count_if(F.coalesce(F.col("part") == "payment", F.lit(False))).alias("payment_rows"),
    )
    absent = {
        **{name: F.when(F.col("item_rows") > 0, F.col(name)) for name in ITEM_FEATURE_COLUMNS},
        **{name: F.when(F.col("payment_rows") > 0, F.col(name)) for name in payment_aggregates()},
    }
    window = days_between("order_purchase_timestamp", "order_estimated_delivery_date")
    return with_time_parts(grouped.withColumns(absent)).withColumn("delivery_days_estimated", window)


def score_incoming(
    orders: DataFrame,
    items: DataFrame,
    payments: DataFrame,
    lookups: Mapping[str, DataFrame],
    model: RiskModel,
    arrival: Arrival = Arrival(),
) -> DataFrame:
    """Probability, decisions and risk factors of incoming orders."""
    return score_orders(known_orders(incoming_orders(orders, items, payments, lookups, arrival)), model)
