"""Derived features, imputation, encoding and the feature matrix.

Fitted state is small (one value per column, one label list per category), so it lives
in a plain dataclass and applies as built-in expressions and MLlib indexers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontide.contract import (
    APPROVAL_HOURS_MAX,
    CATEGORICAL_COLUMNS,
    EDA_ONLY_COLUMNS,
    FINAL_FEATURE_COLUMNS,
    FREIGHT_RATIO_MAX,
    ID_COLUMNS,
    LEAKY_COLUMNS,
    MISSING_LABEL,
    RAW_DATE_COLUMNS,
    TARGET_COLUMN,
    WEEKEND_DAYS,
)
from ontide.functions.columns import clip, flag, hours_between, is_numeric
from ontide.operators.profile import top_values
from ontide.operators.quantiles import exact_quantiles
from ontide.session import stage
from ontide.sources.cleaning import coerce_timestamps


# Mart columns each derived feature needs.
DERIVED_INPUTS = {
    "is_weekend": ["purchase_day_of_week"],
    "cross_state": ["customer_state", "main_seller_state"],
    "price_per_item": ["total_price", "item_count"],
    "freight_ratio": ["total_freight", "total_price"],
    "approval_time_hours": ["order_purchase_timestamp", "order_approved_at"],
}


def matrix_sources(features: Sequence[str] = FINAL_FEATURE_COLUMNS) -> list[str]:
    """Mart columns that the given features, the key and the target are made of."""
    needed = ["order_id"]
    for name in features:
        needed += DERIVED_INPUTS.get(name, [name.removesuffix("_encoded")])
    return list(dict.fromkeys([*needed, TARGET_COLUMN]))


def freight_ratio(freight: Column, price: Column) -> Column:
    return F.try_divide(freight, price + 1)


def price_per_item(price: Column, items: Column) -> Column:
    return F.when(items.isNotNull(), price / F.greatest(items, F.lit(1)))


def build_derived_features(df: DataFrame) -> DataFrame:
    """Add the five derived features. An input column that is absent gives 0 or null."""
    df = coerce_timestamps(df, ["order_purchase_timestamp", "order_approved_at"])

    def available(*columns: str) -> bool:
        return set(columns) <= set(df.columns)

    unknown = F.lit(None).cast("double")
    weekend = cross = F.lit(0)
    per_item = ratio = approval = unknown
    if available("purchase_day_of_week"):
        weekend = flag(F.col("purchase_day_of_week").isin(WEEKEND_DAYS))
    if available("customer_state", "main_seller_state"):
        cross = flag(F.col("customer_state") != F.col("main_seller_state"))
    if available("total_price", "item_count"):
        per_item = price_per_item(F.col("total_price"), F.col("item_count"))
    if available("total_freight", "total_price"):
        ratio = clip(
            freight_ratio(F.col("total_freight"), F.col("total_price")), upper=FREIGHT_RATIO_MAX
        )
    if available("order_purchase_timestamp", "order_approved_at"):
        approval = clip(
            hours_between("order_purchase_timestamp", "order_approved_at"),
            0.0,
            APPROVAL_HOURS_MAX,
        )
    return df.withColumns(
        {
            "is_weekend": weekend,
            "cross_state": cross,
            "price_per_item": per_item,
            "freight_ratio": ratio,
            "approval_time_hours": approval,
        }
    )


def drop_set() -> list[str]:
    """Columns a model must not see, each once, in group order."""
    groups = [LEAKY_COLUMNS, ID_COLUMNS, RAW_DATE_COLUMNS, EDA_ONLY_COLUMNS, CATEGORICAL_COLUMNS]
    return list(dict.fromkeys(column for group in groups for column in group))


def drop_report(df: DataFrame) -> dict[str, list[str]]:
    """Which columns of the drop set `df` has and lacks."""
    present = [c for c in drop_set() if c in df.columns]
    return {"present": present, "absent": [c for c in drop_set() if c not in present]}


def drop_non_features(df: DataFrame) -> DataFrame:
    return df.drop(*drop_set())


def feature_columns(df: DataFrame) -> list[str]:
    """The contract's features that `df` has, in contract order."""
    return [c for c in FINAL_FEATURE_COLUMNS if c in df.columns]


def absent_features(df: DataFrame) -> list[str]:
    return [c for c in FINAL_FEATURE_COLUMNS if c not in df.columns]


def imputable_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric and text columns; timestamps are never filled."""
    numeric = [f.name for f in df.schema if is_numeric(f.dataType)]
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return numeric, text


@dataclass
class Preprocessor:
    """Fill values, label lists and feature order learned from training rows."""

    numeric_fill: dict[str, float] = field(default_factory=dict)
    text_fill: dict[str, str] = field(default_factory=dict)
    labels: dict[str, list[str]] = field(default_factory=dict)
    features: list[str] = field(default_factory=lambda: list(FINAL_FEATURE_COLUMNS))
    target: str = TARGET_COLUMN


def fit_fill_values(
    df: DataFrame,
    numeric: Sequence[str] | None = None,
    text: Sequence[str] | None = None,
    stable: bool = False,
) -> tuple[dict[str, float], dict[str, str]]:
    """Median per numeric and most frequent value per text column, for columns with nulls.

    `stable=True` promises that `df` repeats its values exactly, so it is not staged.
    """
    default_numeric, default_text = imputable_columns(df)
    numeric = default_numeric if numeric is None else list(numeric)
    text = default_text if text is None else list(text)
    data = df.select(*numeric, *text)
    if not stable:
        data = stage(data)
    nulls = data.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"known_{c}") for c in numeric + text]
    ).first()
    gaps = [c for c in numeric + text if 0 < nulls[f"known_{c}"] < nulls["rows"]]
    numeric_gaps = [c for c in numeric if c in gaps]
    medians = exact_quantiles(data, numeric_gaps, [0.5], stable=True) if numeric_gaps else {}
    text_gaps = [c for c in text if c in gaps]
    modes = (
        {r["column_name"]: r["top"] for r in top_values(data, text_gaps).collect()}
        if text_gaps
        else {}
    )
    return {c: medians[c][0] for c in numeric_gaps}, {c: modes[c] for c in text_gaps}


def apply_fill_values(
    df: DataFrame, numeric_fill: dict[str, float], text_fill: dict[str, str]
) -> DataFrame:
    """Fill nulls of the learned columns that `df` has.

    A filled integer column becomes double: a median may lie between two integers.
    """
    filled = {
        c: F.coalesce(F.col(c).cast("double"), F.lit(v))
        for c, v in numeric_fill.items()
        if c in df.columns
    }
    filled.update(
        {c: F.coalesce(F.col(c), F.lit(v)) for c, v in text_fill.items() if c in df.columns}
    )
    return df.withColumns(filled) if filled else df


def _labelled(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING_LABEL))


def fit_labels(
    df: DataFrame, columns: Sequence[str] = CATEGORICAL_COLUMNS
) -> dict[str, list[str]]:
    """Sorted distinct labels per column; null is the label "missing".

    One pass for all columns. The list is what the saved indexer of a model holds.
    """
    present = [c for c in columns if c in df.columns]
    if not present:
        return {}
    cells = F.posexplode(F.array(*[_labelled(c) for c in present])).alias("at", "label")
    found = df.select(cells).distinct()
    rows = found.collect()
    labels: dict[str, list[str]] = {c: [] for c in present}
    for row in rows:
        labels[present[row["at"]]].append(row["label"])
    return {c: sorted(found) for c, found in labels.items()}


def encoder_stages(labels: dict[str, list[str]]) -> list:
    """Pipeline stages that add `<column>_encoded` codes 0..n-1 in label order.

    A label never seen counts as "missing": its code if it was learned, else n.
    """
    if not labels:
        return []
    columns = list(labels)
    named = ", ".join(
        f"coalesce(CAST({c} AS STRING), '{MISSING_LABEL}') AS {c}__label" for c in columns
    )
    indexer = StringIndexerModel.from_arrays_of_labels(
        [labels[c] for c in columns],
        inputCols=[f"{c}__label" for c in columns],
        outputCols=[f"{c}__index" for c in columns],
        handleInvalid="keep",
    )
    codes = []
    for c in columns:
        code = f"{c}__index"
        if MISSING_LABEL in labels[c]:
            known = labels[c].index(MISSING_LABEL)
            code = f"CASE WHEN {code} = {len(labels[c])} THEN {known} ELSE {code} END"
        codes.append(f"CAST({code} AS INT) AS {c}_encoded")
    return [
        SQLTransformer(statement=f"SELECT *, {named} FROM __THIS__"),
        indexer,
        SQLTransformer(statement=f"SELECT *, {', '.join(codes)} FROM __THIS__"),
    ]


def apply_labels(df: DataFrame, labels: dict[str, list[str]]) -> DataFrame:
    """Encode the columns; the text columns keep their label, null as "missing"."""
    labels = {c: found for c, found in labels.items() if c in df.columns}
    if not labels:
        return df
    encoded = PipelineModel(stages=encoder_stages(labels)).transform(df)
    return encoded.select(
        *[F.col(f"{c}__label").alias(c) if c in labels else F.col(c) for c in df.columns],
        *[f"{c}_encoded" for c in labels],
    )


def fit_preprocessor(
    mart: DataFrame, features: Sequence[str] = FINAL_FEATURE_COLUMNS, stable: bool = False
) -> Preprocessor:
    """Learn fill values and labels from (training) mart rows, for the features asked for.

    `stable=True` promises that `mart` is a stored or staged table.
    """
    derived = build_derived_features(mart)
    numeric = [
        c
        for c in FINAL_FEATURE_COLUMNS
        if c in features and c in derived.columns and is_numeric(derived.schema[c].dataType)
    ]
    text = [c for c in CATEGORICAL_COLUMNS if f"{c}_encoded" in features and c in derived.columns]
    data = derived.select(*numeric, *text)
    if not stable:
        data = stage(data)
    numeric_fill, text_fill = fit_fill_values(data, numeric, text, stable=True)
    labels = fit_labels(apply_fill_values(data, {}, text_fill), text)
    encoded = {f"{c}_encoded" for c in text}
    ordered = [c for c in FINAL_FEATURE_COLUMNS if c in numeric or c in encoded]
    return Preprocessor(numeric_fill, text_fill, labels, ordered)


def feature_matrix(
    mart: DataFrame, fitted: Preprocessor, keep: Sequence[str] = ("order_id",)
) -> DataFrame:
    """Features in contract order next to the key and, if known, the target.

    The key is not a feature; it serves later joins and repeatable splits.
    """
    filled = apply_fill_values(
        build_derived_features(mart), fitted.numeric_fill, fitted.text_fill
    )
    encoded = apply_labels(filled, fitted.labels)
    kept = [c for c in keep if c in encoded.columns]
    target = [fitted.target] if fitted.target in encoded.columns else []
    return encoded.select(*kept, *[c for c in fitted.features if c in encoded.columns], *target)
