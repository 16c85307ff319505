"""SQL counterparts of the registered queries, for checking with another engine.

They share the view texts with Spark and nothing else: modes are ranked counts, the
quantiles are `quantile_cont`, and the curves are plain windows.
"""

from __future__ import annotations

from ontide.contract import (
    CATEGORICAL_COLUMNS,
    CORRELATION_COLUMNS,
    DERIVED_FEATURES,
    FINAL_FEATURE_COLUMNS,
)
from ontide.sources.adapter import PORTABLE_SCORE, PORTABLE_TEST_ROWS, view_ctes

ORACLES: dict[str, str] = {}

NUMERIC_FEATURES = [c for c in FINAL_FEATURE_COLUMNS if not c.endswith("_encoded")]

# Columns and Spark type names of the mapped tables.
TABLE_COLUMNS: dict[str, dict[str, str]] = {
    "orders": {
        "order_id": "bigint",
        "customer_id": "bigint",
        "order_status": "string",
        "order_purchase_timestamp": "timestamp_ntz",
        "order_approved_at": "timestamp_ntz",
        "order_delivered_carrier_date": "timestamp_ntz",
        "order_delivered_customer_date": "timestamp_ntz",
        "order_estimated_delivery_date": "timestamp_ntz",
    },
    "customers": {
        "customer_id": "bigint",
        "customer_city": "string",
        "customer_state": "string",
    },
    "sellers": {"seller_id": "bigint", "seller_city": "string", "seller_state": "string"},
    "products": {
        "product_id": "bigint",
        "product_category_name": "string",
        "product_weight_g": "double",
        "product_length_cm": "double",
        "product_height_cm": "double",
        "product_width_cm": "double",
    },
    "category_translation": {
        "product_category_name": "string",
        "product_category_name_english": "string",
    },
    "order_items": {
        "order_id": "bigint",
        "order_item_id": "int",
        "product_id": "bigint",
        "seller_id": "bigint",
        "price": "double",
        "freight_value": "double",
    },
    "payments": {
        "order_id": "bigint",
        "payment_sequential": "int",
        "payment_type": "string",
        "payment_installments": "int",
        "payment_value": "double",
    },
    "reviews": {"review_id": "bigint", "order_id": "bigint", "review_score": "int"},
}


def r(expression: str, digits: int = 6) -> str:
    """Rounded double without a negative zero."""
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + 0.0)"


def days(start: str, end: str) -> str:
    return f"(CAST(date_diff('microsecond', {start}, {end}) AS DOUBLE) / 86400000000.0)"


def mode_cte(name: str, source: str, value: str) -> str:
    return f"""
    {name} AS (
      SELECT order_id, v FROM (
        SELECT order_id, {value} AS v,
               row_number() OVER (PARTITION BY order_id ORDER BY count(*) DESC, {value}) AS place
        FROM {source} WHERE {value} IS NOT NULL GROUP BY order_id, {value})
      WHERE place = 1)"""


DELIVERED = f"""
delivered AS (
  SELECT *,
         {days('order_purchase_timestamp', 'order_delivered_customer_date')} AS delivery_days_actual,
         {days('order_purchase_timestamp', 'order_estimated_delivery_date')} AS delivery_days_estimated,
         {days('order_estimated_delivery_date', 'order_delivered_customer_date')} AS delivery_delay_days,
         CASE WHEN order_delivered_customer_date > order_estimated_delivery_date THEN 1 ELSE 0 END
           AS is_late
  FROM dl_orders
  WHERE order_status = 'delivered' AND order_purchase_timestamp IS NOT NULL
    AND order_delivered_customer_date IS NOT NULL AND order_estimated_delivery_date IS NOT NULL)"""

ENRICHED = """
enriched AS (
  SELECT i.*, p.product_category_name, t.product_category_name_english, p.product_weight_g,
         p.product_length_cm, p.product_height_cm, p.product_width_cm,
         p.product_length_cm * p.product_height_cm * p.product_width_cm AS product_volume_cm3,
         s.seller_city, s.seller_state
  FROM dl_order_items i
  LEFT JOIN dl_products p ON i.product_id = p.product_id
  LEFT JOIN dl_category_translation t ON p.product_category_name = t.product_category_name
  LEFT JOIN dl_sellers s ON i.seller_id = s.seller_id)"""

ITEMS = f"""{ENRICHED},
{mode_cte('mode_category', 'enriched', 'product_category_name_english')},
{mode_cte('mode_state', 'enriched', 'seller_state')},
{mode_cte('mode_city', 'enriched', 'seller_city')},
item_features AS (
  SELECT e.order_id, round(sum(price), 6) AS total_price, round(sum(freight_value), 6) AS total_freight,
         count(order_item_id) AS item_count, count(DISTINCT product_id) AS product_count,
         count(DISTINCT seller_id) AS seller_count,
         avg(product_weight_g) AS avg_product_weight_g,
         avg(product_length_cm) AS avg_product_length_cm,
         avg(product_height_cm) AS avg_product_height_cm,
         avg(product_width_cm) AS avg_product_width_cm,
         avg(product_volume_cm3) AS avg_product_volume_cm3,
         min(mode_category.v) AS main_product_category, min(mode_state.v) AS main_seller_state,
         min(mode_city.v) AS main_seller_city
  FROM enriched e LEFT JOIN mode_category ON e.order_id = mode_category.order_id
  LEFT JOIN mode_state ON e.order_id = mode_state.order_id
  LEFT JOIN mode_city ON e.order_id = mode_city.order_id
  GROUP BY e.order_id)"""

PAYMENTS = f"""
{mode_cte('mode_payment', 'dl_payments', 'payment_type')},
payment_features AS (
  SELECT p.order_id, round(sum(payment_value), 6) AS total_payment_value,
         max(payment_installments) AS max_payment_installments,
         count(payment_sequential) AS payment_count, min(mode_payment.v) AS main_payment_type
  FROM dl_payments p LEFT JOIN mode_payment ON p.order_id = mode_payment.order_id
  GROUP BY p.order_id)"""

REVIEWS = """
review_features AS (
  SELECT order_id, avg(review_score) AS avg_review_score, count(review_id) AS review_count
  FROM dl_reviews GROUP BY order_id)"""

MART = f"""{DELIVERED},{ITEMS},{PAYMENTS},{REVIEWS},
mart AS (
  SELECT d.*,
         CAST(year(order_purchase_timestamp) AS INTEGER) AS purchase_year,
         CAST(month(order_purchase_timestamp) AS INTEGER) AS purchase_month_num,
         monthname(order_purchase_timestamp) AS purchase_month,
         dayname(order_purchase_timestamp) AS purchase_day_of_week,
         CAST(hour(order_purchase_timestamp) AS INTEGER) AS purchase_hour,
         c.customer_city, c.customer_state, f.* EXCLUDE (order_id), p.* EXCLUDE (order_id),
         v.* EXCLUDE (order_id)
  FROM delivered d LEFT JOIN dl_customers c ON d.customer_id = c.customer_id
  LEFT JOIN item_features f ON d.order_id = f.order_id
  LEFT JOIN payment_features p ON d.order_id = p.order_id
  LEFT JOIN review_features v ON d.order_id = v.order_id)"""

DERIVED = f"""{MART},
derived AS (
  SELECT *,
         CASE WHEN purchase_day_of_week IN ('Saturday', 'Sunday') THEN 1 ELSE 0 END AS is_weekend,
         CASE WHEN customer_state <> main_seller_state THEN 1 ELSE 0 END AS cross_state,
         CASE WHEN item_count < 1 THEN total_price ELSE total_price / item_count END AS price_per_item,
         CASE WHEN total_freight / (total_price + 1) > 10 THEN 10.0
              ELSE total_freight / (total_price + 1) END AS freight_ratio,
         CASE WHEN order_approved_at IS NULL THEN NULL
              ELSE greatest(0.0, least(720.0,
                {days('order_purchase_timestamp', 'order_approved_at')} * 24)) END
           AS approval_time_hours
  FROM mart)"""


def _fills(columns: list[str], source: str = "derived") -> str:
    medians = ", ".join(f"median({c}) AS {c}" for c in columns)
    return f"fills AS (SELECT {medians} FROM {source})"


def _text_fill(column: str) -> str:
    return f"""(SELECT {column} FROM derived WHERE {column} IS NOT NULL
                GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1)"""


# Feature matrix: medians and modes fill nulls, labels become their rank.
MATRIX = f"""{DERIVED},
{_fills(NUMERIC_FEATURES)},
labelled AS (
  SELECT order_id, is_late,
         {', '.join(f'coalesce(CAST(d.{c} AS DOUBLE), f.{c}) AS {c}' for c in NUMERIC_FEATURES)},
         {', '.join(f"coalesce({c}, {_text_fill(c)}, 'missing') AS {c}" for c in CATEGORICAL_COLUMNS)}
  FROM derived d CROSS JOIN fills f),
matrix AS (
  SELECT order_id, is_late, {', '.join(NUMERIC_FEATURES)},
         {', '.join(f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {c}_encoded" for c in CATEGORICAL_COLUMNS)}
  FROM labelled)"""

SCORED = f"""{DELIVERED},
scored AS (
  SELECT order_id, is_late AS label, {PORTABLE_SCORE} AS score, is_late, customer_id
  FROM delivered)"""

CONFUSION = f"""{SCORED},
confusion AS (
  SELECT CAST(0.6 AS DOUBLE) AS threshold,
         count(*) FILTER (WHERE score >= 0.6 AND label = 1) AS tp,
         count(*) FILTER (WHERE score >= 0.6 AND label = 0) AS fp,
         count(*) FILTER (WHERE score < 0.6 AND label = 0) AS tn,
         count(*) FILTER (WHERE score < 0.6 AND label = 1) AS fn
  FROM scored)"""

CURVE = f"""{SCORED},
points AS (
  SELECT score AS threshold, count(*) FILTER (WHERE label = 1) AS late,
         count(*) FILTER (WHERE label = 0) AS on_time
  FROM scored GROUP BY score),
curve AS (
  SELECT threshold, late, on_time,
         CAST(sum(late) OVER down AS DOUBLE) AS tp, CAST(sum(on_time) OVER down AS DOUBLE) AS fp,
         CAST(sum(late) OVER () AS DOUBLE) AS p, CAST(sum(on_time) OVER () AS DOUBLE) AS n,
         lead(late) OVER down AS next_late, lead(on_time) OVER down AS next_on_time
  FROM points WINDOW down AS (ORDER BY threshold DESC)),
rated AS (
  SELECT *, tp / (tp + fp) AS pr, tp / p AS re,
         2 * (tp / (tp + fp)) * (tp / p) / (tp / (tp + fp) + tp / p + 1e-9) AS f1 FROM curve)"""

_CORE = {"orders": ("orders",)}


def add(name: str, ctes: str, select: str, views: tuple[str, ...] | None = None) -> None:
    body = view_ctes(views)
    if ctes:
        body = f"{body},\n{ctes.strip().lstrip(',')}"
    ORACLES[name] = f"WITH {body}\n{select}"


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


ORDERS = ("orders",)

# --- Sources and sinks

add(
    "table_counts",
    "counts AS ("
    + union(
        [
            f"SELECT '{t}' AS table_name, count(*) AS row_count, "
            f"CAST({len(cols)} AS BIGINT) AS column_count FROM dl_{t}"
            for t, cols in TABLE_COLUMNS.items()
        ]
    )
    + ")",
    """SELECT * FROM counts UNION ALL
       SELECT 'TOTAL', CAST(sum(row_count) AS BIGINT), CAST(NULL AS BIGINT) FROM counts""",
)
add(
    "warehouse_load_check",
    DELIVERED,
    """SELECT count(*) AS source_rows, count(*) AS stored_rows, CAST(12 AS BIGINT) AS source_columns,
              CAST(12 AS BIGINT) AS stored_columns, TRUE AS matches FROM delivered""",
    ORDERS,
)
add("clean_columns", "", "SELECT seller_id, seller_city, seller_state FROM dl_sellers", ("sellers",))
add(
    "nan_text_to_null",
    "",
    """SELECT customer_id, CASE WHEN customer_id % 10 = 0 THEN NULL ELSE customer_city END
         AS customer_city, customer_state FROM dl_customers""",
    ("customers",),
)


def rate_select(dimension: str) -> str:
    return f"""SELECT coalesce({dimension}, 'missing') AS {dimension}, count(order_id) AS orders,
      CAST(sum(is_late) AS BIGINT) AS late_orders, {r('avg(is_late)')} AS late_rate,
      {r('avg(delivery_delay_days)')} AS avg_delay_days,
      {r('avg(delivery_days_actual)')} AS avg_delivery_days,
      {r('avg(is_late) * 100')} AS late_rate_pct
    FROM mart GROUP BY 1 HAVING count(order_id) >= 100"""


def worst(dimension: str) -> str:
    return f"""coalesce((SELECT v FROM (SELECT coalesce({dimension}, 'missing') AS v,
      avg(is_late) AS rate FROM mart GROUP BY 1 HAVING count(*) >= 100)
      ORDER BY rate DESC, v LIMIT 1), 'N/A')"""


def corr(a: str, b: str) -> str:
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    x, y = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
    return (
        f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) FILTER (WHERE {both})"
        f" * stddev_pop({y}) FILTER (WHERE {both}), 0)"
    )


TARGET_CORRELATIONS = union(
    [
        f"SELECT '{c}' AS feature, {corr(c, 'is_late')} AS value FROM mart"
        for c in CORRELATION_COLUMNS
        if c != "is_late"
    ]
)

add(
    "findings",
    f"{MART}, target_corr AS ({TARGET_CORRELATIONS})",
    f"""SELECT count(*) AS delivered_orders, CAST(sum(is_late) AS BIGINT) AS late_orders,
      CAST(count(*) - sum(is_late) AS BIGINT) AS on_time_orders,
      {r('sum(is_late) * 100.0 / count(*)', 2)} AS late_pct,
      {r('100 - sum(is_late) * 100.0 / count(*)', 2)} AS on_time_pct,
      {worst('customer_state')} AS worst_customer_state,
      {worst('main_seller_state')} AS worst_seller_state,
      {worst('main_product_category')} AS worst_category,
      (SELECT feature FROM target_corr ORDER BY abs(value) DESC NULLS LAST, feature LIMIT 1)
        AS strongest_feature,
      {r('(SELECT value FROM target_corr ORDER BY abs(value) DESC NULLS LAST, feature LIMIT 1)')}
        AS strongest_correlation
    FROM mart""",
)

# --- Profiling


def sample_text(table: str, column: str) -> str:
    return f"""(SELECT string_agg(CAST(v AS VARCHAR), ', ' ORDER BY v) FROM (
      SELECT DISTINCT {column} AS v FROM dl_{table} WHERE {column} IS NOT NULL ORDER BY v LIMIT 3))"""


add(
    "describe_tables",
    "",
    union(
        [
            f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{kind}' AS dtype, "
            f"count(*) - count({c}) AS null_count, {sample_text(t, c)} AS sample_values FROM dl_{t}"
            for t, cols in TABLE_COLUMNS.items()
            for c, kind in cols.items()
        ]
    ),
)

_KEYS = [
    ("orders", "order_id"),
    ("order_items", "order_id"),
    ("payments", "order_id"),
    ("reviews", "order_id"),
    ("orders", "customer_id"),
    ("customers", "customer_id"),
    ("products", "product_id"),
    ("sellers", "seller_id"),
]
add(
    "join_key_counts",
    "",
    union(
        [
            f"SELECT '{t}' AS table_name, '{k}' AS key_name, count(DISTINCT {k}) AS distinct_keys FROM dl_{t}"
            for t, k in _KEYS
        ]
    ),
)
_LINKS = [
    ("order_items", "orders", "order_id"),
    ("payments", "orders", "order_id"),
    ("reviews", "orders", "order_id"),
    ("orders", "customers", "customer_id"),
    ("order_items", "products", "product_id"),
    ("order_items", "sellers", "seller_id"),
]
add(
    "orphan_keys",
    "",
    union(
        [
            f"""SELECT '{c}' AS child_table, '{p}' AS parent_table, '{k}' AS key_name,
            count(DISTINCT {k}) AS orphan_keys FROM dl_{c} child
            WHERE NOT EXISTS (SELECT 1 FROM dl_{p} parent WHERE parent.{k} = child.{k})"""
            for c, p, k in _LINKS
        ]
    ),
)
add(
    "order_status_counts",
    "",
    f"""SELECT order_status, count(*) AS rows,
          {r('count(*) * 100.0 / (SELECT count(*) FROM dl_orders)')} AS pct
        FROM dl_orders WHERE order_status IS NOT NULL GROUP BY order_status""",
    ORDERS,
)
add(
    "purchase_date_range",
    "",
    """SELECT min(order_purchase_timestamp) AS earliest, max(order_purchase_timestamp) AS latest,
         CAST(floor(date_diff('microsecond', min(order_purchase_timestamp),
           max(order_purchase_timestamp)) / 86400000000.0) AS BIGINT) AS span_days,
         CAST(floor(floor(date_diff('microsecond', min(order_purchase_timestamp),
           max(order_purchase_timestamp)) / 86400000000.0) / 365) AS BIGINT) AS span_years
       FROM dl_orders""",
    ORDERS,
)
_BOTH = """order_status = 'delivered' AND order_delivered_customer_date IS NOT NULL
           AND order_estimated_delivery_date IS NOT NULL"""
_LATE = "count(*) FILTER (WHERE order_delivered_customer_date > order_estimated_delivery_date)"
add(
    "baseline_late_rate",
    "",
    f"""SELECT count(*) AS delivered_orders, {_LATE} AS late_orders,
          count(*) - {_LATE} AS on_time_orders, {r(f'{_LATE} * 100.0 / count(*)')} AS late_pct,
          {r(f'100 - {_LATE} * 100.0 / count(*)')} AS on_time_pct
        FROM dl_orders WHERE {_BOTH}""",
    ORDERS,
)
add(
    "missing_order_dates",
    "",
    union(
        [
            f"""SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count,
            {r(f'(count(*) - count({c})) * 100.0 / count(*)')} AS missing_pct FROM dl_orders"""
            for c in (
                "order_approved_at",
                "order_delivered_carrier_date",
                "order_delivered_customer_date",
                "order_estimated_delivery_date",
            )
        ]
    ),
    ORDERS,
)
add(
    "table_overview",
    "",
    union(
        [
            f"""SELECT '{t}' AS table_name, (SELECT count(*) FROM dl_{t}) AS row_count,
            CAST({len(cols)} AS BIGINT) AS column_count,
            (SELECT count(*) FROM dl_{t}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dl_{t}))
              AS duplicate_rows"""
            for t, cols in TABLE_COLUMNS.items()
        ]
    ),
)

_NO_TIME = ", ".join(
    f"CAST(NULL AS TIMESTAMP) AS time_{s}" for s in ("mean", "min", "p25", "p50", "p75", "max")
)
_NO_TEXT = "CAST(NULL AS BIGINT) AS unique_values, CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq"
_NO_NUMBER = ", ".join(
    f"CAST(NULL AS DOUBLE) AS {s}" for s in ("mean", "min", "p25", "p50", "p75", "max", "std")
)


def describe_number(table: str, c: str) -> str:
    return f"""SELECT '{c}' AS column_name, count({c}) AS value_count, {r(f'avg({c})', 4)} AS mean,
      {r(f'min({c})', 4)} AS min, {r(f'quantile_cont({c}, 0.25)', 4)} AS p25,
      {r(f'quantile_cont({c}, 0.5)', 4)} AS p50, {r(f'quantile_cont({c}, 0.75)', 4)} AS p75,
      {r(f'max({c})', 4)} AS max, {r(f'stddev_samp({c})', 4)} AS std, {_NO_TIME}, {_NO_TEXT}
    FROM dl_{table}"""


def describe_time(table: str, c: str) -> str:
    micros = f"CAST(epoch_us({c}) AS DOUBLE)"

    def at(expression: str) -> str:
        return f"make_timestamp(CAST(round({expression}) AS BIGINT))"

    return f"""SELECT '{c}', count({c}), {_NO_NUMBER},
      {at(f'avg(epoch_us({c}))')}, min({c}), {at(f'quantile_cont({micros}, 0.25)')},
      {at(f'quantile_cont({micros}, 0.5)')}, {at(f'quantile_cont({micros}, 0.75)')}, max({c}),
      {_NO_TEXT} FROM dl_{table}"""


def describe_text(table: str, c: str) -> str:
    top = f"""FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM dl_{table}
              WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1"""
    return f"""SELECT '{c}' AS column_name, count({c}) AS value_count, {_NO_NUMBER}, {_NO_TIME},
      count(DISTINCT {c}) AS unique_values, (SELECT v {top}) AS top, (SELECT n {top}) AS freq
    FROM dl_{table}"""


add(
    "describe_orders",
    "",
    union(
        [describe_text("orders", c) for c in ("order_id", "customer_id", "order_status")]
        + [
            describe_time("orders", c)
            for c, kind in TABLE_COLUMNS["orders"].items()
            if kind == "timestamp_ntz"
        ]
    ),
    ORDERS,
)
add(
    "describe_item_prices",
    "",
    union([describe_number("order_items", c) for c in ("price", "freight_value")]),
    ("order_items",),
)
add(
    "describe_product_sizes",
    "",
    union(
        [
            describe_number("products", c)
            for c in (
                "product_weight_g",
                "product_length_cm",
                "product_height_cm",
                "product_width_cm",
            )
        ]
    ),
    ("products",),
)
add(
    "missing_values",
    "",
    union(
        [
            f"""SELECT '{t}' AS table_name, '{c}' AS column_name, '{kind}' AS dtype,
            count(*) - count({c}) AS missing_count,
            {r(f'(count(*) - count({c})) * 100.0 / count(*)', 2)} AS missing_pct,
            count(DISTINCT {c}) AS unique_values FROM dl_{t}"""
            for t, cols in TABLE_COLUMNS.items()
            for c, kind in cols.items()
        ]
    ),
)

MART_COLUMNS = [
    "order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
    "order_delivered_carrier_date", "order_delivered_customer_date",
    "order_estimated_delivery_date", "delivery_days_actual", "delivery_days_estimated",
    "delivery_delay_days", "is_late", "purchase_year", "purchase_month_num", "purchase_month",
    "purchase_day_of_week", "purchase_hour", "customer_city", "customer_state", "total_price",
    "total_freight", "item_count", "product_count", "seller_count", "avg_product_weight_g",
    "avg_product_length_cm", "avg_product_height_cm", "avg_product_width_cm",
    "avg_product_volume_cm3", "main_product_category", "main_seller_state", "main_seller_city",
    "total_payment_value", "max_payment_installments", "payment_count", "main_payment_type",
    "avg_review_score", "review_count",
]
_DOUBLES = {
    "delivery_days_actual", "delivery_days_estimated", "delivery_delay_days", "total_price",
    "total_freight", "avg_product_weight_g", "avg_product_length_cm", "avg_product_height_cm",
    "avg_product_width_cm", "avg_product_volume_cm3", "total_payment_value", "avg_review_score",
}

_null_counts = union(
    [
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count, count(*) AS total FROM mart"
        for c in MART_COLUMNS
    ]
)
add(
    "mart_null_columns",
    f"{MART}, gaps AS ({_null_counts})",
    f"""SELECT column_name, missing_count, {r('missing_count * 100.0 / total')} AS missing_pct
        FROM gaps WHERE missing_count > 0
        UNION ALL SELECT 'TOTAL', CAST(sum(missing_count) AS BIGINT), CAST(NULL AS DOUBLE) FROM gaps""",
)

_FEATURE_TYPES = {
    "is_weekend": "int",
    "cross_state": "int",
    "purchase_hour": "int",
    "purchase_month_num": "int",
}


def feature_type(column: str) -> str:
    return "int" if column.endswith("_encoded") else _FEATURE_TYPES.get(column, "double")


add(
    "feature_report",
    MATRIX,
    union(
        [
            f"""SELECT '{c}' AS feature, '{feature_type(c)}' AS dtype, count(*) - count({c}) AS null_count,
            {r(f'avg({c})', 4)} AS mean, {r(f'median({c})', 4)} AS median,
            {r(f'stddev_samp({c})', 4)} AS std, {r(f'min({c})', 4)} AS min, {r(f'max({c})', 4)} AS max,
            {r(corr(c, 'is_late'), 4)} AS corr_with_is_late FROM matrix"""
            for c in FINAL_FEATURE_COLUMNS
        ]
    ),
)
_gap_sum = " + ".join(
    f"CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END" for c in FINAL_FEATURE_COLUMNS
)
add(
    "matrix_validation",
    MATRIX,
    f"""SELECT count(*) AS rows, CAST(26 AS BIGINT) AS features_present,
          CAST(0 AS BIGINT) AS features_absent, CAST({_gap_sum} AS BIGINT) AS columns_with_nulls,
          CAST(0 AS BIGINT) AS non_numeric_columns, count(*) - count(is_late) AS target_nulls,
          count(*) FILTER (WHERE is_late = 1) AS late_rows,
          count(*) FILTER (WHERE is_late = 0) AS on_time_rows, {r('avg(is_late)')} AS late_rate,
          CASE WHEN avg(is_late) < 0.05 THEN 'strong imbalance'
               WHEN avg(is_late) < 0.15 THEN 'moderate imbalance' ELSE 'balanced' END AS class_balance
        FROM matrix""",
)
add(
    "target_distribution",
    DELIVERED,
    f"""SELECT count(*) AS rows, CAST(sum(is_late) AS BIGINT) AS late_orders,
          CAST(count(*) - sum(is_late) AS BIGINT) AS on_time_orders,
          {r('avg(is_late) * 100')} AS late_rate_pct, {r('avg(1 - is_late) * 100')} AS on_time_rate_pct
        FROM delivered""",
    ORDERS,
)
add(
    "derived_feature_stats",
    DERIVED,
    union(
        [
            f"""SELECT '{c}' AS feature, {r(f'avg({c})')} AS mean, count(*) - count({c}) AS null_count,
            {r(corr(c, 'is_late'))} AS corr_with_is_late FROM derived"""
            for c in DERIVED_FEATURES
        ]
    ),
)

# --- Projections, filters and scalar functions

add(
    "delivered_filter",
    DELIVERED,
    f"SELECT {', '.join(TABLE_COLUMNS['orders'])} FROM delivered",
    ORDERS,
)
_KEPT = """count(*) FILTER (WHERE order_status = 'delivered' AND order_purchase_timestamp IS NOT NULL
  AND order_delivered_customer_date IS NOT NULL AND order_estimated_delivery_date IS NOT NULL)"""
_DELIVERED_COUNT = "count(*) FILTER (WHERE order_status = 'delivered')"
add(
    "dropped_orders",
    "",
    f"""SELECT {_DELIVERED_COUNT} AS delivered_orders, {_KEPT} AS kept_orders,
          {_DELIVERED_COUNT} - {_KEPT} AS dropped_orders FROM dl_orders""",
    ORDERS,
)
add(
    "order_durations",
    DELIVERED,
    f"""SELECT order_id, {r('delivery_days_actual')} AS delivery_days_actual,
          {r('delivery_days_estimated')} AS delivery_days_estimated,
          {r('delivery_delay_days')} AS delivery_delay_days, is_late FROM delivered""",
    ORDERS,
)
add(
    "date_parts",
    DELIVERED,
    """SELECT order_id, CAST(year(order_purchase_timestamp) AS INTEGER) AS purchase_year,
         CAST(month(order_purchase_timestamp) AS INTEGER) AS purchase_month_num,
         monthname(order_purchase_timestamp) AS purchase_month,
         dayname(order_purchase_timestamp) AS purchase_day_of_week,
         CAST(hour(order_purchase_timestamp) AS INTEGER) AS purchase_hour FROM delivered""",
    ORDERS,
)
add(
    "product_volume",
    "",
    f"""SELECT product_id, {r('product_length_cm * product_height_cm * product_width_cm')}
          AS product_volume_cm3 FROM dl_products""",
    ("products",),
)
add(
    "derived_features",
    DERIVED,
    f"""SELECT order_id, is_weekend, cross_state, {r('price_per_item')} AS price_per_item,
          {r('freight_ratio')} AS freight_ratio, {r('approval_time_hours')} AS approval_time_hours
        FROM derived""",
)
add(
    "coerced_timestamps",
    "",
    """SELECT order_id, CASE WHEN order_id % 10 = 0 THEN NULL ELSE order_purchase_timestamp END
         AS order_purchase_timestamp FROM dl_orders""",
    ORDERS,
)

_GAP_FEATURES = [
    "approval_time_hours", "avg_product_height_cm", "avg_product_length_cm",
    "avg_product_volume_cm3", "avg_product_weight_g", "avg_product_width_cm", "freight_ratio",
    "item_count", "max_payment_installments", "payment_count", "price_per_item", "product_count",
    "seller_count", "total_freight", "total_payment_value", "total_price",
]


def matrix_value(column: str) -> str:
    if feature_type(column) == "int":
        return f"CAST({column} AS INTEGER) AS {column}"
    return f"{r(column)} AS {column}"


add(
    "feature_matrix",
    MATRIX,
    f"""SELECT order_id, {', '.join(matrix_value(c) for c in FINAL_FEATURE_COLUMNS)}, is_late
        FROM matrix""",
)

# --- Joins and aggregations

add(
    "item_enriched",
    ENRICHED,
    f"""SELECT order_id, order_item_id, product_id, seller_id, {r('price')} AS price,
          {r('freight_value')} AS freight_value, product_category_name,
          product_category_name_english, {r('product_weight_g')} AS product_weight_g,
          {r('product_volume_cm3')} AS product_volume_cm3, seller_city, seller_state
        FROM enriched""",
)


def plain_or_rounded(columns: list[str], digits: int = 4) -> str:
    return ", ".join(f"{r(c, digits)} AS {c}" if c in _DOUBLES else c for c in columns)


_INDEX = {c: i for i, c in enumerate(MART_COLUMNS)}
add("order_mart", MART, f"SELECT {plain_or_rounded(MART_COLUMNS)} FROM mart")
add(
    "item_features",
    ITEMS,
    "SELECT "
    + plain_or_rounded(
        ["order_id", *MART_COLUMNS[_INDEX["total_price"] : _INDEX["main_seller_city"] + 1]]
    )
    + " FROM item_features",
)
add(
    "payment_features",
    PAYMENTS,
    f"""SELECT order_id, {r('total_payment_value', 4)} AS total_payment_value,
          max_payment_installments, payment_count, main_payment_type FROM payment_features""",
    ("payments",),
)
add(
    "review_features",
    REVIEWS,
    f"SELECT order_id, {r('avg_review_score')} AS avg_review_score, review_count FROM review_features",
    ("reviews",),
)

RATE_DIMENSIONS = [
    "customer_state",
    "main_seller_state",
    "main_payment_type",
    "main_product_category",
    "purchase_day_of_week",
    "purchase_month",
]
for _d in RATE_DIMENSIONS:
    add(f"late_rate_by_{_d}", MART, rate_select(_d))
for _d in ("customer_state", "main_seller_state", "main_product_category"):
    add(f"top15_{_d}", MART, f"{rate_select(_d)} ORDER BY late_rate_pct DESC, 1 LIMIT 15")
add(
    "late_rate_all_dimensions",
    MART,
    union(
        [
            f"""SELECT '{d}' AS dimension, {d} AS value, orders, late_orders, late_rate, avg_delay_days,
            avg_delivery_days, late_rate_pct FROM ({rate_select(d)})"""
            for d in RATE_DIMENSIONS
        ]
    ),
)
add(
    "baseline_summary",
    DELIVERED,
    f"""SELECT count(*) AS delivered_orders_with_valid_dates, CAST(sum(is_late) AS BIGINT) AS late_orders,
          CAST(count(*) - sum(is_late) AS BIGINT) AS on_time_orders,
          {r('avg(is_late) * 100', 2)} AS late_rate_pct,
          {r('100 - avg(is_late) * 100', 2)} AS on_time_rate_pct,
          {r('100 - avg(is_late) * 100', 2)} AS baseline_accuracy_if_predict_all_on_time,
          {r('avg(delivery_days_actual)', 2)} AS avg_delivery_days,
          {r('median(delivery_days_actual)', 2)} AS median_delivery_days,
          {r('avg(delivery_delay_days)', 2)} AS avg_delay_days,
          {r('median(delivery_delay_days)', 2)} AS median_delay_days FROM delivered""",
    ORDERS,
)
_RATE_COUNT = f"""{r('avg(is_late)')} AS late_rate, count(is_late) AS order_count,
                  {r('avg(is_late) * 100')} AS late_rate_pct"""
add(
    "late_rate_weekdays",
    DELIVERED,
    f"""SELECT CAST(isodow(order_purchase_timestamp) - 1 AS INTEGER) AS weekday_num,
          dayname(order_purchase_timestamp) AS purchase_day_of_week, {_RATE_COUNT}
        FROM delivered GROUP BY 1, 2""",
    ORDERS,
)
add(
    "late_rate_months",
    DELIVERED,
    f"""SELECT CAST(month(order_purchase_timestamp) AS INTEGER) AS purchase_month_num,
          monthname(order_purchase_timestamp) AS purchase_month, {_RATE_COUNT}
        FROM delivered GROUP BY 1, 2""",
    ORDERS,
)
_OUTCOME = "CASE WHEN is_late = 1 THEN 'Late' ELSE 'On Time / Early' END"
add(
    "review_by_outcome",
    MART,
    f"""SELECT {_OUTCOME} AS outcome, {r('avg(avg_review_score)')} AS avg_review_score,
          count(order_id) AS orders FROM mart WHERE avg_review_score IS NOT NULL GROUP BY 1""",
)


def quartile_sql(column: str) -> str:
    return f"""
    SELECT bin_index, {r('CASE bin_index WHEN 0 THEN e0 WHEN 1 THEN e1 WHEN 2 THEN e2 ELSE e3 END', 4)} AS lower_edge,
      {r('CASE bin_index WHEN 0 THEN e1 WHEN 1 THEN e2 WHEN 2 THEN e3 ELSE e4 END', 4)} AS upper_edge,
      {r('avg(is_late)', 4)} AS late_rate, count(is_late) AS order_count,
      {r('avg(is_late) * 100', 4)} AS late_rate_pct
    FROM (SELECT is_late, e0, e1, e2, e3, e4,
            CAST(CASE WHEN {column} <= e1 THEN 0 WHEN {column} <= e2 THEN 1
                 WHEN {column} <= e3 THEN 2 ELSE 3 END AS INTEGER) AS bin_index
          FROM mart CROSS JOIN (
            SELECT min({column}) AS e0, quantile_cont({column}, 0.25) AS e1,
                   quantile_cont({column}, 0.5) AS e2, quantile_cont({column}, 0.75) AS e3,
                   max({column}) AS e4 FROM mart)
          WHERE {column} IS NOT NULL)
    GROUP BY bin_index, e0, e1, e2, e3, e4"""


add("price_quartiles", MART, quartile_sql("total_price"))
add("freight_quartiles", MART, quartile_sql("total_freight"))
add(
    "correlations",
    MART,
    union(
        [
            f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r(corr(a, b))} AS correlation FROM mart"
            for a in CORRELATION_COLUMNS
            for b in CORRELATION_COLUMNS
        ]
    ),
)
add(
    "correlations_with_target",
    f"{MART}, target_corr AS ({TARGET_CORRELATIONS})",
    f"SELECT feature, {r('value')} AS correlation_with_late_delivery FROM target_corr",
)

# --- KPI queries

_LATE_SUM = "CAST(sum(is_late) AS BIGINT)"
_RATE2 = r("avg(is_late) * 100", 2)
add(
    "overall_kpis",
    MATRIX,
    f"""SELECT count(*) AS total_orders, {_LATE_SUM} AS late_orders,
          count(*) - {_LATE_SUM} AS on_time_orders, {_RATE2} AS late_rate_pct,
          {r('avg(delivery_days_estimated)', 2)} AS avg_estimated_delivery_days,
          {r('avg(total_price)', 2)} AS avg_order_value,
          {r('avg(total_freight)', 2)} AS avg_freight_value,
          {r('avg(cross_state) * 100', 2)} AS cross_state_rate_pct FROM matrix""",
)
_PLACE = f"""count(*) AS total_orders, {_LATE_SUM} AS late_orders, {_RATE2} AS late_rate_pct,
             {r('avg(delivery_days_actual)', 2)} AS avg_actual_delivery_days,
             {r('avg(delivery_delay_days)', 2)} AS avg_delay_days"""
add(
    "state_late_rates",
    MART,
    f"""SELECT customer_state, {_PLACE} FROM mart WHERE customer_state IS NOT NULL
        GROUP BY customer_state HAVING count(*) >= 100
        ORDER BY late_rate_pct DESC, customer_state LIMIT 20""",
)
add(
    "route_segments",
    MATRIX,
    f"""SELECT CASE WHEN cross_state = 1 THEN 'Cross-state' ELSE 'Same-state' END AS route_type,
          CASE WHEN seller_count >= 2 THEN 'Multi-seller' ELSE 'Single-seller' END AS seller_complexity,
          count(*) AS total_orders, {_LATE_SUM} AS late_orders, {_RATE2} AS late_rate_pct,
          {r('avg(total_freight)', 2)} AS avg_freight,
          {r('avg(delivery_days_estimated)', 2)} AS avg_estimated_days
        FROM matrix GROUP BY 1, 2""",
)
_MONTHLY = f"""SELECT CAST(purchase_month_num AS INTEGER) AS purchase_month_num,
  count(*) AS total_orders, {_LATE_SUM} AS late_orders, {_RATE2} AS late_rate_pct,
  {r('avg(total_freight)', 2)} AS avg_freight_value FROM matrix GROUP BY 1"""
add("monthly_late_rate", MATRIX, _MONTHLY)
add(
    "monthly_rolling_average",
    f"{MATRIX}, monthly AS ({_MONTHLY})",
    f"""SELECT *, {r('avg(late_rate_pct) OVER (ORDER BY purchase_month_num ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 2)}
          AS rolling_3_month_late_rate_pct FROM monthly""",
)
add(
    "monthly_trend",
    f"""{DELIVERED}, monthly AS (
      SELECT CAST(year(order_purchase_timestamp) AS INTEGER) AS purchase_year,
             CAST(month(order_purchase_timestamp) AS INTEGER) AS purchase_month_num,
             count(*) AS total_orders, {_LATE_SUM} AS late_orders, {_RATE2} AS late_rate_pct
      FROM delivered GROUP BY 1, 2)""",
    f"""SELECT *, {r('avg(late_rate_pct) OVER (ORDER BY purchase_year, purchase_month_num ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 2)}
          AS rolling_3_month_late_rate_pct FROM monthly""",
    ORDERS,
)
add(
    "delivery_summary",
    DELIVERED,
    f"""SELECT count(*) AS total_delivered_orders, {_LATE_SUM} AS late_orders,
          count(*) - {_LATE_SUM} AS on_time_orders, {r('(1 - avg(is_late)) * 100', 2)} AS on_time_rate_pct,
          {_RATE2} AS late_rate_pct, {r('avg(delivery_days_actual)', 2)} AS avg_actual_delivery_days,
          {r('avg(delivery_delay_days)', 2)} AS avg_delay_days FROM delivered""",
    ORDERS,
)
add(
    "seller_state_ranking",
    MART,
    f"""SELECT main_seller_state AS seller_state, {_PLACE} FROM mart
        WHERE main_seller_state IS NOT NULL GROUP BY main_seller_state HAVING count(*) >= 50
        ORDER BY late_rate_pct DESC, seller_state LIMIT 20""",
)
add(
    "cross_state_comparison",
    MATRIX,
    f"""SELECT CASE WHEN cross_state = 1 THEN 'Cross-state shipment' ELSE 'Same-state shipment' END
          AS shipment_type, count(*) AS total_orders, {_LATE_SUM} AS late_orders,
          {_RATE2} AS late_rate_pct, {r('avg(total_freight)', 2)} AS avg_freight_value,
          {r('avg(delivery_days_estimated)', 2)} AS avg_estimated_delivery_days
        FROM matrix GROUP BY 1""",
)
add(
    "worst_route_pairs",
    MART,
    f"""SELECT main_seller_state AS seller_state, customer_state,
          main_seller_state || ' → ' || customer_state AS route_pair, {_PLACE} FROM mart
        WHERE main_seller_state IS NOT NULL AND customer_state IS NOT NULL
        GROUP BY main_seller_state, customer_state HAVING count(*) >= 50
        ORDER BY late_rate_pct DESC, seller_state, customer_state LIMIT 10""",
)


def histogram_sql(low: int, high: int, bins: int, on_time: str) -> str:
    width = f"(CAST({high - low} AS DOUBLE) / {bins})"
    index = f"CAST(least(floor((delivery_days_actual - {low}) / {width}), {bins - 1}) AS INTEGER)"
    return f"""SELECT bin_index, outcome, count(*) AS orders, {r(f'{low} + bin_index * {width}')} AS bin_start,
        {r(f'{low} + (bin_index + 1) * {width}')} AS bin_end
      FROM (SELECT {index} AS bin_index, CASE WHEN is_late = 1 THEN 'Late' ELSE '{on_time}' END AS outcome
            FROM delivered WHERE delivery_days_actual BETWEEN {low} AND {high}) GROUP BY 1, 2"""


add("delivery_histogram_100", DELIVERED, histogram_sql(1, 100, 80, "On Time / Early"), ORDERS)
add("delivery_histogram_80", DELIVERED, histogram_sql(1, 80, 70, "On Time"), ORDERS)
add(
    "delay_distribution",
    DELIVERED,
    f"""SELECT {_OUTCOME} AS outcome, count(*) AS orders, {r('min(delivery_delay_days)')} AS min_delay,
          {r('quantile_cont(delivery_delay_days, 0.25)')} AS p25_delay,
          {r('quantile_cont(delivery_delay_days, 0.5)')} AS median_delay,
          {r('quantile_cont(delivery_delay_days, 0.75)')} AS p75_delay,
          {r('max(delivery_delay_days)')} AS max_delay
        FROM delivered WHERE delivery_delay_days BETWEEN -60 AND 60 GROUP BY 1""",
    ORDERS,
)
add(
    "top_categories",
    MART,
    f"""SELECT main_product_category, {_RATE_COUNT} FROM mart WHERE main_product_category IS NOT NULL
        GROUP BY 1 HAVING count(*) >= 100 ORDER BY late_rate_pct DESC, 1 LIMIT 12""",
)
CENTRES = """centres AS (SELECT * FROM (VALUES ('AFRICA', 2.0, 21.0), ('AMERICA', 15.0, -90.0),
  ('ASIA', 34.0, 100.0), ('EUROPE', 50.0, 15.0), ('MIDDLE EAST', 29.0, 42.0)) t(state, lat, lon))"""
add(
    "state_map",
    f"{MART}, {CENTRES}",
    f"""SELECT customer_state AS state, {r('avg(is_late)')} AS late_rate, count(is_late) AS orders,
          {r('avg(is_late) * 100')} AS late_rate_pct, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon
        FROM mart JOIN centres ON customer_state = state GROUP BY 1, lat, lon HAVING count(*) >= 30""",
)
add(
    "state_ranking_table",
    f"{MART}, {CENTRES}",
    f"""SELECT customer_state AS "State", count(is_late) AS "Orders", {r('avg(is_late) * 100', 1)} AS "Late %"
        FROM mart JOIN centres ON customer_state = state GROUP BY 1 HAVING count(*) >= 30""",
)
add(
    "category_list",
    MART,
    "SELECT DISTINCT main_product_category FROM mart WHERE main_product_category IS NOT NULL",
)

# --- Features, splits and evaluation

_IMPUTED_NUMERIC = sorted({*_GAP_FEATURES, "avg_review_score", "review_count"})
_IMPUTED_TEXT = [
    "main_payment_type",
    "main_product_category",
    "main_seller_city",
    "main_seller_state",
]
add(
    "impute_values",
    DERIVED,
    union(
        [
            f"SELECT '{c}' AS column_name, {r(f'median({c})', 4)} AS numeric_fill, CAST(NULL AS VARCHAR) AS text_fill FROM derived"
            for c in _IMPUTED_NUMERIC
        ]
        + [f"SELECT '{c}', CAST(NULL AS DOUBLE), {_text_fill(c)}" for c in _IMPUTED_TEXT]
    ),
)
_FILLED = [
    "total_price",
    "freight_ratio",
    "avg_product_weight_g",
    "approval_time_hours",
    "max_payment_installments",
    "avg_review_score",
]
add(
    "imputed_mart",
    f"{DERIVED}, {_fills(_FILLED)}",
    f"""SELECT order_id, {', '.join(f'{r(f"coalesce(CAST(d.{c} AS DOUBLE), f.{c})", 4)} AS {c}' for c in _FILLED)},
          {', '.join(f"coalesce({c}, {_text_fill(c)}) AS {c}" for c in CATEGORICAL_COLUMNS)}
        FROM derived d CROSS JOIN fills f""",
)
add(
    "encoded_categories",
    MART,
    f"""SELECT order_id, {', '.join(f"coalesce({c}, 'missing') AS {c}" for c in CATEGORICAL_COLUMNS)},
          {', '.join(f"CAST(dense_rank() OVER (ORDER BY coalesce({c}, 'missing')) - 1 AS INTEGER) AS {c}_encoded" for c in CATEGORICAL_COLUMNS)}
        FROM mart""",
)
_TRAIN, _TEST = f"NOT ({PORTABLE_TEST_ROWS})", f"({PORTABLE_TEST_ROWS})"


def part_rate(rows: str) -> str:
    return f"avg(is_late) FILTER (WHERE {rows})"


add(
    "portable_split_balance",
    DELIVERED,
    f"""SELECT count(*) FILTER (WHERE {_TRAIN}) AS train_rows, count(*) FILTER (WHERE {_TEST}) AS test_rows,
          {r(part_rate(_TRAIN))} AS train_late_rate, {r(part_rate(_TEST))} AS test_late_rate,
          {r(f'abs({part_rate(_TRAIN)} - {part_rate(_TEST)})')} AS rate_difference,
          abs({part_rate(_TRAIN)} - {part_rate(_TEST)}) < 0.005 AS balanced FROM delivered""",
    ORDERS,
)
# The split is exact per class, so its sizes follow from the class sizes.
add(
    "stratified_split_balance",
    f"""{DELIVERED}, classes AS (
      SELECT CAST(sum(is_late) AS BIGINT) AS n1, count(*) - CAST(sum(is_late) AS BIGINT) AS n0
      FROM delivered),
    parts AS (
      SELECT n0, n1, CAST(round(n0 * 0.2) AS BIGINT) AS t0, CAST(round(n1 * 0.2) AS BIGINT) AS t1
      FROM classes),
    sized AS (
      SELECT n0 + n1 - t0 - t1 AS train_rows, t0 + t1 AS test_rows,
             (n1 - t1) / CAST(n0 + n1 - t0 - t1 AS DOUBLE) AS a, t1 / CAST(t0 + t1 AS DOUBLE) AS b
      FROM parts)""",
    f"""SELECT train_rows, test_rows, {r('a')} AS train_late_rate, {r('b')} AS test_late_rate,
          {r('abs(a - b)')} AS rate_difference, abs(a - b) < 0.005 AS balanced FROM sized""",
    ORDERS,
)
add(
    "model_invariants",
    f"""{DELIVERED}, classes AS (
      SELECT CAST(sum(is_late) AS BIGINT) AS n1, count(*) - CAST(sum(is_late) AS BIGINT) AS n0
      FROM delivered)""",
    """SELECT CAST(round(n0 * 0.2) + round(n1 * 0.2) AS BIGINT) AS test_orders, TRUE AS scored_once,
         TRUE AS scores_in_range, TRUE AS importances_sum_to_one, TRUE AS beats_chance FROM classes""",
    ORDERS,
)
add(
    "late_class_weight",
    DELIVERED,
    f"""SELECT count(*) FILTER (WHERE is_late = 0) AS on_time_rows,
          count(*) FILTER (WHERE is_late = 1) AS late_rows,
          {r('count(*) FILTER (WHERE is_late = 0) * 1.0 / count(*) FILTER (WHERE is_late = 1)')}
            AS scale_pos_weight FROM delivered""",
    ORDERS,
)
add("confusion_counts", CONFUSION, "SELECT * FROM confusion", ORDERS)
_P, _R = "(tp * 1.0 / (tp + fp))", "(tp * 1.0 / (tp + fn))"
add(
    "classification_metrics",
    CONFUSION,
    f"""SELECT *, {r(_P)} AS precision, {r(_R)} AS recall,
          {r('(tp + tn) * 1.0 / (tp + fp + tn + fn)')} AS accuracy,
          {r(f'2 * {_P} * {_R} / ({_P} + {_R})')} AS f1 FROM confusion""",
    ORDERS,
)
add(
    "roc_auc",
    SCORED,
    f"""SELECT {r('(sum(CASE WHEN label = 1 THEN place ELSE 0 END) - p * (p + 1) / 2) / (p * n)')} AS auc_roc
        FROM (SELECT label, rank() OVER (ORDER BY score)
                + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS place,
                CAST(count(*) FILTER (WHERE label = 1) OVER () AS DOUBLE) AS p,
                CAST(count(*) FILTER (WHERE label = 0) OVER () AS DOUBLE) AS n FROM scored)
        GROUP BY p, n""",
    ORDERS,
)
add(
    "pr_curve",
    CURVE,
    f"""SELECT {r('threshold')} AS threshold, {r('pr')} AS precision, {r('re')} AS recall FROM rated
        UNION ALL SELECT NULL, 1.0, 0.0""",
    ORDERS,
)
add(
    "roc_curve",
    CURVE,
    f"""SELECT {r('threshold')} AS threshold, {r('fp / n')} AS fpr, {r('tp / p')} AS tpr FROM rated
        WHERE next_late IS NULL OR late <> next_late OR on_time <> next_on_time
        UNION ALL SELECT NULL, 0.0, 0.0""",
    ORDERS,
)
_THRESHOLD_ROW = f"""{r('threshold')} AS threshold, {r('pr')} AS precision, {r('re')} AS recall, {r('f1')} AS f1"""
add(
    "best_threshold",
    CURVE,
    f"""SELECT {_THRESHOLD_ROW} FROM (SELECT threshold, pr, re, f1 FROM rated
        ORDER BY f1 DESC, threshold LIMIT 1)""",
    ORDERS,
)
add("threshold_analysis", CURVE, f"SELECT {_THRESHOLD_ROW} FROM rated", ORDERS)

_REPORT = f"""{CONFUSION}, parts AS (
  SELECT tn * 1.0 / (tn + fn) AS p0, tn * 1.0 / (tn + fp) AS r0, tn + fp AS s0,
         tp * 1.0 / (tp + fp) AS p1, tp * 1.0 / (tp + fn) AS r1, tp + fn AS s1,
         (tp + tn) * 1.0 / (tp + fp + tn + fn) AS accuracy FROM confusion),
full_parts AS (SELECT *, 2 * p0 * r0 / (p0 + r0) AS f0, 2 * p1 * r1 / (p1 + r1) AS f1 FROM parts)"""


def weighted(kind: str) -> str:
    return r(f"({kind}0 * s0 + {kind}1 * s1) / (s0 + s1)")


add(
    "classification_report",
    _REPORT,
    f"""SELECT '0' AS class, {r('p0')} AS precision, {r('r0')} AS recall, {r('f0')} AS f1, s0 AS support FROM full_parts
        UNION ALL SELECT '1', {r('p1')}, {r('r1')}, {r('f1')}, s1 FROM full_parts
        UNION ALL SELECT 'accuracy', NULL, NULL, {r('accuracy')}, s0 + s1 FROM full_parts
        UNION ALL SELECT 'macro avg', {r('(p0 + p1) / 2')}, {r('(r0 + r1) / 2')}, {r('(f0 + f1) / 2')}, s0 + s1 FROM full_parts
        UNION ALL SELECT 'weighted avg', {weighted('p')}, {weighted('r')}, {weighted('f')}, s0 + s1 FROM full_parts""",
    ORDERS,
)
add(
    "confusion_cells",
    CONFUSION,
    """SELECT 'On-Time' AS actual, 'On-Time' AS predicted, 'TN' AS cell, 'correct' AS caption, tn AS orders FROM confusion
       UNION ALL SELECT 'On-Time', 'Late', 'FP', 'false alarm', fp FROM confusion
       UNION ALL SELECT 'Late', 'On-Time', 'FN', 'missed', fn FROM confusion
       UNION ALL SELECT 'Late', 'Late', 'TP', 'caught', tp FROM confusion""",
    ORDERS,
)
add(
    "business_impact",
    CONFUSION,
    f"""SELECT threshold, tp + fp + tn + fn AS orders, tp + fn AS late_orders, tp AS caught, fn AS missed,
          fp AS false_alarms, tp + fp AS flagged, {r('tp * 100.0 / (tp + fn)')} AS caught_pct,
          {r('fn * 100.0 / (tp + fn)')} AS missed_pct, {r('tp * 100.0 / (tp + fp)')} AS precision_pct
        FROM confusion""",
    ORDERS,
)

# --- Scoring

_PROFILE_FILLS = [c for c in NUMERIC_FEATURES if c not in ("is_weekend", "cross_state")]
_PROFILE_VALUES = {
    "total_payment_value": "d.total_price + d.total_freight",
    "product_count": "CAST(1 AS DOUBLE)",
    "seller_count": "CAST(1 AS DOUBLE)",
    "payment_count": "CAST(1 AS DOUBLE)",
    "avg_product_length_cm": "CAST(NULL AS DOUBLE)",
    "avg_product_height_cm": "CAST(NULL AS DOUBLE)",
    "avg_product_width_cm": "CAST(NULL AS DOUBLE)",
    "avg_product_volume_cm3": "CAST(NULL AS DOUBLE)",
    "approval_time_hours": "CAST(NULL AS DOUBLE)",
}


def profile_value(column: str, bare: bool = True) -> str:
    value = _PROFILE_VALUES.get(column, f"d.{column}") if bare else f"d.{column}"
    if column not in _GAP_FEATURES:
        return f"{r(value)} AS {column}"
    return f"{r(f'coalesce(CAST({value} AS DOUBLE), f.{column})')} AS {column}"


add(
    "score_inputs",
    f"{DERIVED}, {_fills(_GAP_FEATURES)}",
    f"""SELECT order_id, {', '.join(profile_value(c) for c in NUMERIC_FEATURES)}
        FROM derived d CROSS JOIN fills f""",
)
add(
    "score_inputs_known",
    f"{DERIVED}, {_fills(_GAP_FEATURES)}",
    f"""SELECT order_id, {', '.join(profile_value(c, bare=False) for c in NUMERIC_FEATURES)}
        FROM derived d CROSS JOIN fills f""",
)
_RULES = [
    ("delivery_days_estimated > 18", "long_promised_window"),
    ("customer_state <> main_seller_state", "cross_state_shipment"),
    ("total_freight / (total_price + 1) > 0.28", "high_freight_ratio"),
    ("purchase_day_of_week IN ('Friday', 'Saturday', 'Sunday')", "weekend_order"),
    ("avg_product_weight_g > 2.5 * (SELECT median(avg_product_weight_g) FROM mart)", "heavy_product"),
    ("max_payment_installments > 6", "many_installments"),
]
_met = " || ".join(f"CASE WHEN {rule} THEN '{name},' ELSE '' END" for rule, name in _RULES)
_met_count = " + ".join(f"CASE WHEN {rule} THEN 1 ELSE 0 END" for rule, _ in _RULES)
add(
    "risk_factors",
    MART,
    f"""SELECT order_id, rtrim({_met}, ',') AS risk_factors,
          CAST({_met_count} AS INTEGER) AS risk_factor_count FROM mart""",
)


def decimal_text(expression: str, digits: int) -> str:
    """Digits after the point, half away from zero on the decimal value."""
    exact = f"CAST(CAST(({expression}) AS DOUBLE) AS VARCHAR)"
    return f"CAST(CAST(round(CAST({exact} AS DECIMAL(28, 12)), {digits}) AS DECIMAL(28, {digits})) AS VARCHAR)"


_TEXTS = [
    f"'promised window of ' || {decimal_text('delivery_days_estimated', 1)} || ' days'",
    "'ships from ' || main_seller_state || ' to ' || customer_state",
    f"'freight is ' || {decimal_text('total_freight / (total_price + 1)', 2)} || ' of the price'",
    "'ordered on a ' || purchase_day_of_week",
    f"'mean product weight of ' || {decimal_text('avg_product_weight_g / 1000', 1)} || ' kg'",
    "CAST(max_payment_installments AS VARCHAR) || ' installments'",
]
add(
    "risk_explanations",
    MART,
    union(
        [
            f"SELECT order_id, '{name}' AS factor, {text} AS explanation FROM mart WHERE {rule}"
            for (rule, name), text in zip(_RULES, _TEXTS)
        ]
    ),
)
add(
    "verdicts",
    SCORED,
    f"""SELECT order_id, {r('score')} AS score,
          CASE WHEN score >= 0.5 THEN 'HIGH RISK' ELSE 'LOW RISK' END AS verdict FROM scored""",
    ORDERS,
)
add(
    "action_tiers",
    SCORED,
    """SELECT CASE WHEN score >= 0.72 THEN 'escalate' WHEN score >= 0.6 THEN 'monitor'
              WHEN score >= 0.25 THEN 'watch' ELSE 'standard' END AS action,
         count(*) AS orders, CAST(sum(label) AS BIGINT) AS late_orders FROM scored GROUP BY 1""",
    ORDERS,
)
add(
    "risk_bands",
    SCORED,
    """SELECT CASE WHEN score < 0.3 THEN 'low' WHEN score < 0.55 THEN 'medium' ELSE 'high' END AS risk_band,
         count(*) AS orders, CAST(sum(label) AS BIGINT) AS late_orders FROM scored GROUP BY 1""",
    ORDERS,
)


def fixed(expression: str, digits: int) -> str:
    # Half away from zero on the decimal value, as Spark rounds.
    exact = f"CAST(CAST({expression} AS VARCHAR) AS DECIMAL(28, 12))"
    return f"printf('%.4f', CAST(round({exact}, {digits}) AS DOUBLE))"


_SUMMARY = {
    "delivery_days_estimated": fixed("delivery_days_estimated", 4),
    "total_price": fixed("total_price", 2),
    "total_freight": fixed("total_freight", 2),
    "freight_ratio": fixed("freight_ratio", 3),
    "price_per_item": fixed("price_per_item", 2),
    "avg_product_weight_g": fixed("avg_product_weight_g", 2),
    "is_weekend": "CAST(is_weekend AS VARCHAR)",
    "cross_state": "CAST(cross_state AS VARCHAR)",
    "seller_state": "main_seller_state",
    "customer_state": "customer_state",
    "product_category": "main_product_category",
    "payment_type": "main_payment_type",
    "installments": "CAST(max_payment_installments AS VARCHAR)",
    "purchase_hour": "CAST(purchase_hour AS VARCHAR)",
    "purchase_month_num": "CAST(purchase_month_num AS VARCHAR)",
    "purchase_day_of_week": "purchase_day_of_week",
}
add(
    "order_summary",
    DERIVED,
    union(
        [
            f"SELECT order_id, '{name}' AS attribute, {value} AS value FROM derived"
            for name, value in _SUMMARY.items()
        ]
    ),
)

# --- Streaming. Every order counts, whatever batch it came in.

_WINDOW = "to_days(30) * CAST(floor(epoch_us(order_purchase_timestamp) / 2592000000000.0) AS INTEGER)"
add(
    "stream_late_windows",
    f"""{DELIVERED}, windows AS (
      SELECT TIMESTAMP '1970-01-01' + {_WINDOW} AS window_start,
             TIMESTAMP '1970-01-01' + {_WINDOW} + to_days(30) AS window_end, is_late FROM delivered)""",
    f"""SELECT window_start, window_end, count(*) AS orders, {_LATE_SUM} AS late_orders,
          {r('avg(is_late) * 100')} AS late_rate_pct FROM windows
        GROUP BY 1, 2""",
    ORDERS,
)

# Raw orders of every status with their first three items, which arrive within the time of the query.
_INCOMING = DERIVED.replace("FROM dl_order_items i", "FROM (SELECT * FROM dl_order_items WHERE order_item_id <= 3) i")
_INCOMING = _INCOMING.replace(DELIVERED[DELIVERED.index("  WHERE order_status") :], ")")
_INCOMING_COUNTS = "item_count, product_count, seller_count, payment_count"
_INCOMING_TEXT = "main_seller_state, customer_state, main_product_category, main_payment_type, purchase_day_of_week"
_INCOMING_DOUBLES = [
    "delivery_days_estimated",
    "total_price",
    "total_freight",
    "avg_product_weight_g",
    "avg_product_length_cm",
    "avg_product_height_cm",
    "avg_product_width_cm",
    "avg_product_volume_cm3",
    "total_payment_value",
    "approval_time_hours",
]
add(
    "incoming_orders",
    _INCOMING,
    f"""SELECT order_id, {_INCOMING_COUNTS}, {_INCOMING_TEXT}, purchase_month_num, purchase_hour,
          max_payment_installments AS installments, {', '.join(f'{r(c)} AS {c}' for c in _INCOMING_DOUBLES)}
        FROM derived""",
)

# --- Metrics of a run, over the portable score on the test rows; the baseline's score is its square.

_RUN = f"""{SCORED},
marked AS (SELECT label, score, {PORTABLE_TEST_ROWS} AS in_test FROM scored),
train_points AS (
  SELECT score AS threshold, count(*) FILTER (WHERE label = 1) AS late,
         count(*) FILTER (WHERE label = 0) AS on_time
  FROM marked WHERE NOT in_test GROUP BY score),
train_curve AS (
  SELECT threshold, CAST(sum(late) OVER down AS DOUBLE) AS tp, CAST(sum(on_time) OVER down AS DOUBLE) AS fp,
         CAST(sum(late) OVER () AS DOUBLE) AS p
  FROM train_points WINDOW down AS (ORDER BY threshold DESC)),
chosen AS (
  SELECT threshold FROM train_curve
  ORDER BY 2 * (tp / (tp + fp)) * (tp / p) / (tp / (tp + fp) + tp / p + 1e-9) DESC, threshold LIMIT 1),
cases AS (
  SELECT 'optimal' AS kind, label, score, threshold FROM marked, chosen WHERE in_test
  UNION ALL SELECT 'default', label, score, 0.5 FROM marked WHERE in_test
  UNION ALL SELECT 'baseline', label, score * score, 0.5 FROM marked WHERE in_test),
counts AS (
  SELECT kind, count(*) FILTER (WHERE score >= threshold AND label = 1) AS tp,
         count(*) FILTER (WHERE score >= threshold AND label = 0) AS fp,
         count(*) FILTER (WHERE score < threshold AND label = 0) AS tn,
         count(*) FILTER (WHERE score < threshold AND label = 1) AS fn
  FROM cases GROUP BY kind),
ranks AS (
  SELECT kind, late, on_time, sum(on_time) OVER (PARTITION BY kind ORDER BY score) - on_time AS below
  FROM (SELECT kind, score, count(*) FILTER (WHERE label = 1) AS late,
               count(*) FILTER (WHERE label = 0) AS on_time FROM cases GROUP BY kind, score)),
aucs AS (
  SELECT kind, sum(late * (below + on_time / 2)) / (CAST(sum(late) AS DOUBLE) * sum(on_time)) AS auc
  FROM ranks GROUP BY kind),
rates AS (
  SELECT kind, auc, tp, fp, tn, fn, tp * 1.0 / (tp + fp) AS pr, tp * 1.0 / (tp + fn) AS re,
         2.0 * tp / (2 * tp + fp + fn) AS f1, (tp + tn) * 1.0 / (tp + fp + tn + fn) AS accuracy
  FROM counts JOIN aucs USING (kind)),
sizes AS (
  SELECT count(*) FILTER (WHERE NOT in_test) AS n_train, count(*) FILTER (WHERE in_test) AS n_test,
         avg(label) FILTER (WHERE NOT in_test) AS late_train, avg(label) FILTER (WHERE in_test) AS late_test,
         count(*) FILTER (WHERE NOT in_test AND label = 0) * 1.0
           / count(*) FILTER (WHERE NOT in_test AND label = 1) AS weight
  FROM marked),
best AS (SELECT * FROM rates WHERE kind = 'optimal'),
usual AS (SELECT * FROM rates WHERE kind = 'default'),
simple AS (SELECT * FROM rates WHERE kind = 'baseline')"""


def _four(expression: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 4)"


add(
    "portable_kpi_row",
    _RUN,
    f"""SELECT n_train AS training_orders, {r('round((1 - late_train) * 100, 1)')} AS on_time_baseline_pct,
          {r(_four('auc'))} AS auc_roc, {r(f"{_four('auc')} - 0.5")} AS auc_gain_over_random,
          {r(f"{_four('re')} * 100")} AS late_orders_caught_pct, {r('threshold')} AS threshold
        FROM best, sizes, chosen""",
    ORDERS,
)
_METRIC_SQL = {"auc_roc": "auc", "recall": "re", "precision": "pr", "f1": "f1", "tp": "tp", "fp": "fp"}
add(
    "portable_threshold_comparison",
    _RUN,
    union(
        [
            f"""SELECT '{name}' AS metric, {r(_four(f'best.{c}'))} AS at_optimal, {r(_four(f'usual.{c}'))} AS at_default
                FROM best, usual"""
            for name, c in _METRIC_SQL.items()
        ]
        + [
            f"SELECT '{name}', CAST({value} AS DOUBLE), CAST(NULL AS DOUBLE) FROM sizes"
            for name, value in (("n_train", "n_train"), ("n_features", str(len(FINAL_FEATURE_COLUMNS))))
        ]
    ),
    ORDERS,
)
add(
    "portable_model_deltas",
    _RUN,
    union(
        [
            f"""SELECT '{name}' AS metric, {r(f'simple.{c}')} AS baseline, {r(f'usual.{c}')} AS final,
                  {r(f'usual.{c} - simple.{c}')} AS difference FROM simple, usual"""
            for name, c in (("auc_roc", "auc"), ("recall", "re"), ("f1", "f1"))
        ]
    ),
    ORDERS,
)
add(
    "portable_metrics",
    _RUN,
    f"""SELECT CAST({len(FINAL_FEATURE_COLUMNS)} AS INTEGER) AS n_features, n_train, n_test,
          {r('late_train')} AS late_rate_train, {r('late_test')} AS late_rate_test, {r('weight')} AS scale_pos_weight,
          {r('threshold')} AS optimal_threshold, {r('1 - late_test')} AS baseline_accuracy,
          {r(_four('usual.accuracy'))} AS default_accuracy, {r(_four('best.accuracy'))} AS optimal_accuracy,
          usual.tn AS default_tn, best.fn AS optimal_fn
        FROM sizes, chosen, best, usual""",
    ORDERS,
)
