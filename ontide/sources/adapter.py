"""Delivery tables as views over a TPC-H-like star schema.

Each view is one SQL text in the common subset of Spark and ANSI SQL. `{name}` stands
for a source table: a DataFrame in Spark, a plain table name in another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PURCHASE_HOUR = "(o_orderkey * 7) % 24"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "orders": (
        ("orders",),
        f"""
        SELECT o_orderkey AS order_id,
               o_custkey AS customer_id,
               CASE o_orderstatus WHEN 'P' THEN 'canceled' ELSE 'delivered' END AS order_status,
               o_orderdate + INTERVAL '1' HOUR * ({_PURCHASE_HOUR})
                 AS order_purchase_timestamp,
               CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE
                 o_orderdate + INTERVAL '1' HOUR * ({_PURCHASE_HOUR} + (o_orderkey * 13) % 97)
               END AS order_approved_at,
               CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE
                 o_orderdate + INTERVAL '1' HOUR * ({_PURCHASE_HOUR} + 48)
               END AS order_delivered_carrier_date,
               CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE
                 o_orderdate + INTERVAL '1' HOUR * ({_PURCHASE_HOUR}
                   + 24 * (3 + (o_orderkey * 7919 + o_custkey * 31) % 19)
                   + CASE WHEN extract(month FROM o_orderdate) IN (2, 3, 11) THEN 72 ELSE 0 END)
               END AS order_delivered_customer_date,
               o_orderdate + INTERVAL '1' DAY * (15 + (o_orderkey * 31) % 14)
                 AS order_estimated_delivery_date
        FROM {{orders}}
        """,
    ),
    "customers": (
        ("customer", "nation", "region"),
        """
        SELECT c_custkey AS customer_id, n_name AS customer_city, r_name AS customer_state
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
        JOIN {region} ON n_regionkey = r_regionkey
        """,
    ),
    "sellers": (
        ("supplier", "nation", "region"),
        """
        SELECT s_suppkey AS seller_id, n_name AS seller_city, r_name AS seller_state
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
        JOIN {region} ON n_regionkey = r_regionkey
        """,
    ),
    "products": (
        ("part",),
        """
        SELECT p_partkey AS product_id,
               CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE lower(p_type) END
                 AS product_category_name,
               CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE CAST(p_size * 100 AS DOUBLE) END
                 AS product_weight_g,
               CAST(p_size + 10 AS DOUBLE) AS product_length_cm,
               CAST(p_size % 7 + 2 AS DOUBLE) AS product_height_cm,
               CASE WHEN p_partkey % 43 = 0 THEN NULL ELSE CAST(p_size % 11 + 5 AS DOUBLE) END
                 AS product_width_cm
        FROM {part}
        """,
    ),
    "category_translation": (
        ("part",),
        """
        SELECT DISTINCT lower(p_type) AS product_category_name,
               concat('cat_', lower(p_type)) AS product_category_name_english
        FROM {part} WHERE p_type <> 'PROMO'
        """,
    ),
    "order_items": (
        ("lineitem",),
        """
        SELECT l_orderkey AS order_id, l_linenumber AS order_item_id,
               l_partkey AS product_id, l_suppkey AS seller_id,
               l_extendedprice AS price,
               round(l_quantity * (0.5 + l_discount), 2) AS freight_value
        FROM {lineitem}
        """,
    ),
    "payments": (
        ("orders",),
        """
        SELECT o_orderkey AS order_id, 1 AS payment_sequential,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'boleto'
                    WHEN '2-HIGH' THEN 'debit_card' ELSE 'credit_card' END AS payment_type,
               CAST(1 + o_orderkey % 10 AS INT) AS payment_installments,
               o_totalprice AS payment_value
        FROM {orders} WHERE o_orderkey % 211 <> 0
        UNION ALL
        SELECT o_orderkey, 2, 'voucher', 1, CAST(10 + o_orderkey % 50 AS DOUBLE)
        FROM {orders} WHERE o_orderkey % 9 = 0
        """,
    ),
    "reviews": (
        ("orders",),
        """
        SELECT o_orderkey * 2 AS review_id, o_orderkey AS order_id,
               CAST(1 + (o_orderkey + o_custkey) % 5 AS INT) AS review_score
        FROM {orders} WHERE o_orderkey % 53 <> 0
        """,
    ),
}

# Portable stand-in for a model score: 19 tied values that rise with the planted delay.
PORTABLE_SCORE = "CAST((order_id * 7919 + customer_id * 31) % 19 AS DOUBLE) / 18"
PORTABLE_TEST_ROWS = "(order_id * 7919) % 100 < 20"


def delivery_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All mapped tables, lazily. Each source file is opened once."""
    sources = {name for needed, _ in VIEWS.values() for name in needed}
    opened = {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in sorted(sources)}
    return {
        name: spark.sql(text, **{source: opened[source] for source in needed})
        for name, (needed, text) in VIEWS.items()
    }


def view_ctes(names: tuple[str, ...] | None = None, prefix: str = "dl_") -> str:
    """The same views as common table expressions for another SQL engine."""
    parts = []
    for name in names or tuple(VIEWS):
        sources, text = VIEWS[name]
        parts.append(f"{prefix}{name} AS ({text.format(**{s: s for s in sources})})")
    return ",\n".join(parts)
