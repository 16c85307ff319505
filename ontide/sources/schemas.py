"""Logical tables: file name pattern and column types.

Types cover the columns the engine computes on. A CSV file may hold further columns;
they are read as strings and reach the profiling reports.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TableSpec:
    """`pattern` matches the CSV file below the root folder."""

    name: str
    pattern: str
    types: dict[str, str]
    multiline: bool = False


_TS = "timestamp_ntz"

# The nine tables, their file patterns and column types.
TABLES: dict[str, TableSpec] = {
    spec.name: spec
    for spec in (
        TableSpec(
            "orders",
            "*orders_dataset.csv",
            {
                "order_id": "string",
                "customer_id": "string",
                "order_status": "string",
                "order_purchase_timestamp": _TS,
                "order_approved_at": _TS,
                "order_delivered_carrier_date": _TS,
                "order_delivered_customer_date": _TS,
                "order_estimated_delivery_date": _TS,
            },
        ),
        TableSpec(
            "customers",
            "*customers_dataset.csv",
            {"customer_id": "string", "customer_city": "string", "customer_state": "string"},
        ),
        TableSpec(
            "order_items",
            "*order_items_dataset.csv",
            {
                "order_id": "string",
                "order_item_id": "int",
                "product_id": "string",
                "seller_id": "string",
                "shipping_limit_date": _TS,
                "price": "double",
                "freight_value": "double",
            },
        ),
        TableSpec(
            "payments",
            "*order_payments_dataset.csv",
            {
                "order_id": "string",
                "payment_sequential": "int",
                "payment_type": "string",
                "payment_installments": "int",
                "payment_value": "double",
            },
        ),
        TableSpec(
            "reviews",
            "*order_reviews_dataset.csv",
            {
                "review_id": "string",
                "order_id": "string",
                "review_score": "int",
                "review_creation_date": _TS,
                "review_answer_timestamp": _TS,
            },
            # Free-text comments contain line breaks.
            multiline=True,
        ),
        TableSpec(
            "products",
            "*products_dataset.csv",
            {
                "product_id": "string",
                "product_category_name": "string",
                "product_weight_g": "double",
                "product_length_cm": "double",
                "product_height_cm": "double",
                "product_width_cm": "double",
            },
        ),
        TableSpec(
            "sellers",
            "*sellers_dataset.csv",
            {"seller_id": "string", "seller_city": "string", "seller_state": "string"},
        ),
        TableSpec(
            "geolocation",
            "*geolocation_dataset.csv",
            {
                "geolocation_zip_code_prefix": "int",
                "geolocation_lat": "double",
                "geolocation_lng": "double",
                "geolocation_city": "string",
                "geolocation_state": "string",
            },
        ),
        TableSpec(
            "category_translation",
            "*product_category_name_translation.csv",
            {
                "product_category_name": "string",
                "product_category_name_english": "string",
            },
        ),
    )
}
