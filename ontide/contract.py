"""Fixed values shared by every stage: column groups, labels, limits.

They are part of the data contract: stages, saved models and reports agree on them
by name, order and value.
"""

from __future__ import annotations

# Columns only known after delivery, never model inputs.
LEAKY_COLUMNS = [
    "order_delivered_customer_date",
    "order_delivered_carrier_date",
    "delivery_days_actual",
    "delivery_delay_days",
    "avg_review_score",
    "review_count",
]

# Identifiers.
ID_COLUMNS = ["order_id", "customer_id"]

# Raw dates, replaced by derived time parts.
RAW_DATE_COLUMNS = [
    "order_purchase_timestamp",
    "order_approved_at",
    "order_estimated_delivery_date",
]

# Columns used by reports only.
EDA_ONLY_COLUMNS = [
    "order_status",
    "purchase_year",
    "purchase_month",
    "customer_city",
    "main_seller_city",
]

# Columns that get an `_encoded` twin.
CATEGORICAL_COLUMNS = [
    "purchase_day_of_week",
    "customer_state",
    "main_seller_state",
    "main_payment_type",
    "main_product_category",
]

# Fixed value: the label.
TARGET_COLUMN = "is_late"

# Model inputs. The order is part of the contract.
FINAL_FEATURE_COLUMNS = [
    "delivery_days_estimated",
    "purchase_hour",
    "purchase_month_num",
    "is_weekend",
    "total_price",
    "total_freight",
    "freight_ratio",
    "price_per_item",
    "item_count",
    "product_count",
    "seller_count",
    "avg_product_weight_g",
    "avg_product_length_cm",
    "avg_product_height_cm",
    "avg_product_width_cm",
    "avg_product_volume_cm3",
    "total_payment_value",
    "max_payment_installments",
    "payment_count",
    "cross_state",
    "purchase_day_of_week_encoded",
    "customer_state_encoded",
    "main_seller_state_encoded",
    "main_payment_type_encoded",
    "main_product_category_encoded",
    "approval_time_hours",
]

# Columns of the correlation report, target first.
CORRELATION_COLUMNS = [
    "is_late",
    "delivery_days_estimated",
    "purchase_month_num",
    "purchase_hour",
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
    "total_payment_value",
    "max_payment_installments",
    "payment_count",
]

# Features built from other columns.
DERIVED_FEATURES = [
    "is_weekend",
    "cross_state",
    "price_per_item",
    "freight_ratio",
    "approval_time_hours",
]

# Order lifecycle and category defaults.
DELIVERED_STATUS = "delivered"
MISSING_LABEL = "missing"
WEEKEND_DAYS = ["Saturday", "Sunday"]
LATE_LABEL = "Late"
ON_TIME_LABEL = "On Time / Early"
ON_TIME_SHORT_LABEL = "On Time"

# Clipping limits of the derived features.
FREIGHT_RATIO_MAX = 10.0
APPROVAL_HOURS_MAX = 720.0

# Report thresholds and sizes.
MIN_ORDERS_REPORT = 100
MIN_ORDERS_RANKING = 50
MIN_ORDERS_MAP = 30
TOP_STATES = 20
TOP_ROUTES = 10
TOP_CHART = 15
TOP_CATEGORIES = 12
TOP_FEATURES = 20

# Risk rules, action tiers and risk bands.
RISK_LONG_WINDOW_DAYS = 18
RISK_FREIGHT_RATIO = 0.28
RISK_WEEKDAYS = ["Friday", "Saturday", "Sunday"]
RISK_WEIGHT_FACTOR = 2.5
RISK_WEIGHT_DEFAULT_G = 2000.0
RISK_INSTALLMENTS = 6
ESCALATE_FROM = 0.72
WATCH_FROM = 0.25
BAND_EDGES = (0.30, 0.55)
DEFAULT_THRESHOLD = 0.5

# Stand-ins for order attributes a caller does not have at scoring time.
SCORING_DEFAULTS = {
    "product_count": 1.0,
    "seller_count": 1.0,
    "payment_count": 1.0,
    "avg_product_length_cm": 30.0,
    "avg_product_height_cm": 15.0,
    "avg_product_width_cm": 20.0,
    "avg_product_volume_cm3": 9000.0,
    "approval_time_hours": 2.0,
}

# Approximate centre (latitude, longitude) of each Brazilian state.
STATE_CENTRES = {
    "AC": (-9.02, -70.81),
    "AL": (-9.57, -36.78),
    "AP": (1.41, -51.77),
    "AM": (-3.42, -65.86),
    "BA": (-12.58, -41.70),
    "CE": (-5.50, -39.32),
    "DF": (-15.78, -47.93),
    "ES": (-19.18, -40.31),
    "GO": (-15.83, -49.84),
    "MA": (-4.96, -45.27),
    "MT": (-12.68, -56.92),
    "MS": (-20.77, -54.79),
    "MG": (-18.51, -44.56),
    "PA": (-3.42, -52.76),
    "PB": (-7.24, -36.78),
    "PR": (-24.89, -51.90),
    "PE": (-8.81, -36.95),
    "PI": (-7.72, -42.73),
    "RJ": (-22.91, -43.17),
    "RN": (-5.81, -36.21),
    "RS": (-30.03, -51.22),
    "RO": (-11.51, -63.58),
    "RR": (2.74, -62.08),
    "SC": (-27.24, -50.22),
    "SP": (-23.55, -46.63),
    "SE": (-10.57, -37.39),
    "TO": (-10.18, -48.30),
}
