"""Profiling and data-quality reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ontide.contract import DERIVED_FEATURES, TARGET_COLUMN
from ontide.functions.aggregates import count_null, count_where, guarded_corr
from ontide.functions.columns import (
    epoch_micros,
    from_epoch_micros,
    is_numeric,
    is_timestamp,
    percent,
)
from ontide.operators.correlation import pair_correlations
from ontide.operators.mart import is_delivered
from ontide.operators.quantiles import exact_quantiles
from ontide.session import stage

JOIN_KEYS = [
    ("orders", "order_id"),
    ("order_items", "order_id"),
    ("payments", "order_id"),
    ("reviews", "order_id"),
    ("orders", "customer_id"),
    ("customers", "customer_id"),
    ("products", "product_id"),
    ("sellers", "seller_id"),
]

FOREIGN_KEYS = [
    ("order_items", "orders", "order_id"),
    ("payments", "orders", "order_id"),
    ("reviews", "orders", "order_id"),
    ("orders", "customers", "customer_id"),
    ("order_items", "products", "product_id"),
    ("order_items", "sellers", "seller_id"),
]

ORDER_DATES = [
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
]


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def _as_text(field: T.StructField) -> Column:
    """A value as text; -0.0 and 0.0 are one value."""
    value = _quoted(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        value = value + F.lit(0.0)
    return value.cast("string")


def value_histogram(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, value, count) of non-null values, as text.

    A value that fills a large share of a column combines before the shuffle, and a
    column of unique values is spread over all tasks.
    """
    columns = list(columns or df.columns)
    cells = df.select(
        F.posexplode(F.array(*[_as_text(df.schema[c]) for c in columns])).alias("at", "value")
    )
    counts = cells.filter(F.col("value").isNotNull()).groupBy("at", "value").count()
    names = F.array(*[F.lit(c) for c in columns])
    return counts.select(
        F.element_at(names, F.col("at") + 1).alias("column_name"), "value", "count"
    )


def describe_table(df: DataFrame, name: str, samples: int = 3) -> DataFrame:
    """Type, null count and the smallest distinct values of each column.

    Each sample is the least value above the one before: a scan with a one-row aggregate
    that compares with the values found so far as constants. No column's values are shuffled
    or collected, and no table is joined.
    """
    fields = list(df.schema)
    nulls: list[int] = []
    texts: list[list[str]] = [[] for _ in fields]
    above: list[Column | None] = [None] * len(fields)
    for step in range(samples):
        smallest = []
        for i, field in enumerate(fields):
            value = _quoted(field.name)
            if step and above[i] is None:
                least = F.lit(None).cast(field.dataType)
            else:
                least = F.min(F.when(value > above[i], value) if step else value)
            smallest += [least.alias(f"value_{i}"), least.cast("string").alias(f"text_{i}")]
        counts = [count_null(_quoted(f.name)).alias(f"nulls_{i}") for i, f in enumerate(fields)]
        row = df.agg(*smallest, *([] if step else counts)).first()
        for i, field in enumerate(fields):
            if not step:
                nulls.append(row[f"nulls_{i}"])
            found = row[f"value_{i}"]
            above[i] = None if found is None else F.lit(found).cast(field.dataType)
            if found is not None:
                texts[i].append(row[f"text_{i}"])
    entries = [
        (name, field.name, field.dataType.simpleString(), nulls[i], ", ".join(texts[i]))
        for i, field in enumerate(fields)
    ]
    return df.sparkSession.createDataFrame(
        entries,
        "table_name string, column_name string, dtype string, null_count bigint, sample_values string",
    )


def describe_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    return _union([describe_table(df, name) for name, df in tables.items()])


def join_key_counts(tables: Mapping[str, DataFrame], approx: bool = False) -> DataFrame:
    """Distinct key values per table."""
    count = F.approx_count_distinct if approx else F.count_distinct
    return _union(
        [
            tables[table]
            .agg(count(F.col(key)).alias("distinct_keys"))
            .select(F.lit(table).alias("table_name"), F.lit(key).alias("key_name"), "distinct_keys")
            for table, key in JOIN_KEYS
        ]
    )


def orphan_keys(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Key values of a child table that its parent table lacks.

    Keys are made distinct first, so a key that fills a large part of the child crosses
    the shuffle once per task.
    """
    checks = []
    for child, parent, key in FOREIGN_KEYS:
        keys = tables[child].select(key).filter(F.col(key).isNotNull()).distinct()
        absent = keys.join(tables[parent].select(key), key, "left_anti")
        checks.append(
            absent.agg(F.count(F.lit(1)).alias("orphan_keys")).select(
                F.lit(child).alias("child_table"),
                F.lit(parent).alias("parent_table"),
                F.lit(key).alias("key_name"),
                "orphan_keys",
            )
        )
    return _union(checks)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per known value and their share of all rows, most frequent first."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("total"))
    return (
        counts.join(F.broadcast(total), how="cross")
        .filter(F.col(column).isNotNull())
        .select(column, "rows", percent(F.col("rows"), F.col("total")).alias("pct"))
        .orderBy(F.desc("rows"), column)
    )


def date_range(orders: DataFrame, column: str = "order_purchase_timestamp") -> DataFrame:
    bounds = orders.agg(F.min(column).alias("earliest"), F.max(column).alias("latest"))
    days = F.timestamp_diff("DAY", F.col("earliest"), F.col("latest"))
    return bounds.select(
        "earliest",
        "latest",
        days.cast("long").alias("span_days"),
        F.floor(days / 365).cast("long").alias("span_years"),
    )


def baseline_late_rate(orders: DataFrame) -> DataFrame:
    """Late share of delivered orders that have both dates; the purchase date may lack."""
    delivered = F.col("order_delivered_customer_date")
    promised = F.col("order_estimated_delivery_date")
    total, late = F.count(F.lit(1)), count_where(delivered > promised)
    return (
        orders.filter(is_delivered() & delivered.isNotNull() & promised.isNotNull())
        .agg(total.alias("delivered_orders"), late.alias("late_orders"))
        .select(
            "delivered_orders",
            "late_orders",
            (F.col("delivered_orders") - F.col("late_orders")).alias("on_time_orders"),
            percent(F.col("late_orders"), F.col("delivered_orders")).alias("late_pct"),
            (F.lit(100) - percent(F.col("late_orders"), F.col("delivered_orders"))).alias(
                "on_time_pct"
            ),
        )
    )


def missing_summary(df: DataFrame, columns: Sequence[str] = ORDER_DATES) -> DataFrame:
    """Null count and share of the given columns."""
    summary = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[count_null(_quoted(c)).alias(f"missing_count__{i}") for i, c in enumerate(columns)],
    )
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"missing_count__{i}").alias("missing_count"),
            percent(F.col(f"missing_count__{i}"), F.col("total")).alias("missing_pct"),
        )
        for i, c in enumerate(columns)
    ]
    return summary.select(F.inline(F.array(*entries)))


def columns_with_nulls(df: DataFrame) -> DataFrame:
    """Columns that hold nulls, most first, and a row with the total."""
    counts = missing_summary(df, df.columns)
    total = counts.agg(F.sum("missing_count").alias("missing_count")).select(
        F.lit("TOTAL").alias("column_name"), "missing_count", F.lit(None).cast("double").alias("missing_pct")
    )
    return counts.filter(F.col("missing_count") > 0).unionByName(total).orderBy(
        F.desc("missing_count"), "column_name"
    )


def table_overview(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, columns and repeated rows (all but the first of equal rows) per table."""
    return _union(
        [
            df.groupBy(*[_quoted(c) for c in df.columns])
            .agg(F.count(F.lit(1)).alias("copies"))
            .agg(
                F.coalesce(F.sum("copies"), F.lit(0)).alias("row_count"),
                F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"),
            )
            .select(
                F.lit(name).alias("table_name"),
                "row_count",
                F.lit(len(df.columns)).cast("long").alias("column_count"),
                "duplicate_rows",
            )
            for name, df in tables.items()
        ]
    )


def missing_values(tables: Mapping[str, DataFrame], approx: bool = False) -> DataFrame:
    """Type, null count and share, and distinct values of every column of every table."""
    reports = []
    for name, df in tables.items():
        columns = df.columns
        aggregates = [F.count(F.lit(1)).alias("total")]
        aggregates += [count_null(_quoted(c)).alias(f"missing__{i}") for i, c in enumerate(columns)]
        if approx:
            aggregates += [
                F.approx_count_distinct(_quoted(c)).alias(f"unique__{i}")
                for i, c in enumerate(columns)
            ]
        summary = df.agg(*aggregates)
        entries = [
            F.struct(
                F.lit(name).alias("table_name"),
                F.lit(field.name).alias("column_name"),
                F.lit(field.dataType.simpleString()).alias("dtype"),
                F.col(f"missing__{i}").alias("missing_count"),
                F.round(percent(F.col(f"missing__{i}"), F.col("total")), 2).alias("missing_pct"),
                *([F.col(f"unique__{i}").alias("unique_values")] if approx else []),
            )
            for i, field in enumerate(df.schema)
        ]
        report = summary.select(F.inline(F.array(*entries)))
        if not approx:
            # Distinct (column, value) pairs; several exact counts in one aggregate
            # would expand every row by the number of columns with all columns in it.
            distinct = (
                value_histogram(df)
                .groupBy("column_name")
                .agg(F.count(F.lit(1)).alias("unique_values"))
            )
            report = report.join(F.broadcast(distinct), "column_name", "left").withColumn(
                "unique_values", F.coalesce("unique_values", F.lit(0))
            )
        reports.append(
            report.select(
                "table_name", "column_name", "dtype", "missing_count", "missing_pct", "unique_values"
            )
        )
    return _union(reports).orderBy(
        F.desc("missing_pct"), F.desc("missing_count"), "table_name", "column_name"
    )


def top_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: distinct values, the most frequent one (smallest on a tie), its count.

    One aggregate with a fixed-size buffer per column, also for a column of unique values.
    """
    most_frequent_first = F.struct(-F.col("count"), F.col("value"))
    return (
        value_histogram(df, columns)
        .groupBy("column_name")
        .agg(
            F.count(F.lit(1)).alias("unique_values"),
            F.min_by("value", most_frequent_first).alias("top"),
            F.max("count").alias("freq"),
        )
    )


def describe(df: DataFrame) -> DataFrame:
    """Summary statistics of columns of mixed type, one row per column.

    Numeric columns fill the double statistics, timestamps the `time_` ones, text the
    distinct count, top value and its frequency.
    """
    numeric = [f.name for f in df.schema if is_numeric(f.dataType)]
    times = [f.name for f in df.schema if is_timestamp(f.dataType)]
    texts = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]
    measured = {n: _quoted(n).cast("double") for n in numeric}
    measured.update({n: epoch_micros(_quoted(n)) for n in times})
    data = stage(
        df.select(
            *[measured[n].alias(n) if n in measured else _quoted(n).cast("string").alias(n) for n in df.columns]
        )
    )
    quartiles = (
        exact_quantiles(data, list(measured), [0.25, 0.5, 0.75], stable=True) if measured else {}
    )
    aggregates = [F.count(_quoted(n)).alias(f"count__{i}") for i, n in enumerate(df.columns)]
    for i, n in enumerate(df.columns):
        if n in measured:
            # Microseconds since 1970 overflow the exact range of a double when summed.
            summed = _quoted(n).cast("decimal(20,0)") if n in times else _quoted(n)
            aggregates += [
                F.avg(summed).cast("double").alias(f"mean__{i}"),
                F.stddev_samp(_quoted(n)).alias(f"std__{i}"),
                F.min(_quoted(n)).cast("double").alias(f"min__{i}"),
                F.max(_quoted(n)).cast("double").alias(f"max__{i}"),
            ]
    no_number, no_time = F.lit(None).cast("double"), F.lit(None).cast("timestamp_ntz")
    entries = []
    for i, n in enumerate(df.columns):
        stats = {}
        if n in measured:
            p25, p50, p75 = quartiles[n]
            stats = {
                "mean": F.col(f"mean__{i}"),
                "min": F.col(f"min__{i}"),
                "p25": F.lit(p25).cast("double"),
                "p50": F.lit(p50).cast("double"),
                "p75": F.lit(p75).cast("double"),
                "max": F.col(f"max__{i}"),
            }
        as_number = n in numeric
        entries.append(
            F.struct(
                F.lit(n).alias("column_name"),
                F.col(f"count__{i}").alias("value_count"),
                *[
                    (stats[s] if as_number else no_number).alias(s)
                    for s in ("mean", "min", "p25", "p50", "p75", "max")
                ],
                (F.col(f"std__{i}") if as_number else no_number).alias("std"),
                *[
                    (from_epoch_micros(stats[s]) if n in times else no_time).alias(f"time_{s}")
                    for s in ("mean", "min", "p25", "p50", "p75", "max")
                ],
            )
        )
    report = data.agg(*aggregates).select(F.inline(F.array(*entries)))
    if texts:
        report = report.join(F.broadcast(top_values(data, texts)), "column_name", "left")
    else:
        report = report.withColumns(
            {
                "unique_values": F.lit(None).cast("long"),
                "top": F.lit(None).cast("string"),
                "freq": F.lit(None).cast("long"),
            }
        )
    return report


def feature_report(
    matrix: DataFrame, features: Sequence[str], target: str = TARGET_COLUMN
) -> DataFrame:
    """Nulls, location, spread and target correlation per feature, strongest first."""
    data = stage(
        matrix.select(*[F.col(c).cast("double").alias(c) for c in [*features, target]])
    )
    types = dict(matrix.dtypes)
    medians = exact_quantiles(data, list(features), [0.5], stable=True)
    aggregates = []
    for i, c in enumerate(features):
        aggregates += [
            count_null(c).alias(f"null_count__{i}"),
            F.avg(c).alias(f"mean__{i}"),
            F.stddev_samp(c).alias(f"std__{i}"),
            F.min(c).alias(f"min__{i}"),
            F.max(c).alias(f"max__{i}"),
        ]
    entries = [
        F.struct(
            F.lit(c).alias("feature"),
            F.lit(types[c]).alias("dtype"),
            F.col(f"null_count__{i}").alias("null_count"),
            F.round(f"mean__{i}", 4).alias("mean"),
            F.round(F.lit(medians[c][0]).cast("double"), 4).alias("median"),
            F.round(f"std__{i}", 4).alias("std"),
            F.round(f"min__{i}", 4).alias("min"),
            F.round(f"max__{i}", 4).alias("max"),
        )
        for i, c in enumerate(features)
    ]
    correlations = pair_correlations(data, features, [target], stable=True).select(
        F.col("feature_a").alias("feature"),
        F.round("correlation", 4).alias("corr_with_is_late"),
    )
    return (
        data.agg(*aggregates)
        .select(F.inline(F.array(*entries)))
        .join(F.broadcast(correlations), "feature", "left")
        .orderBy(F.abs("corr_with_is_late").desc_nulls_last(), "feature")
    )


def matrix_validation(
    matrix: DataFrame, features: Sequence[str], target: str = TARGET_COLUMN
) -> DataFrame:
    """Checks before training: nulls, non-numeric columns, class balance."""
    types = {f.name: f.dataType for f in matrix.schema}
    present = [c for c in features if c in types]
    other = [c for c in present if not is_numeric(types[c])]
    null_columns = F.lit(0)
    for i in range(len(present)):
        null_columns = null_columns + (F.col(f"nulls__{i}") > 0).cast("int")
    rate = F.col("late_rows") / F.col("rows")
    return matrix.agg(
        F.count(F.lit(1)).alias("rows"),
        count_where(F.col(target) == 1).alias("late_rows"),
        count_where(F.col(target) == 0).alias("on_time_rows"),
        count_null(target).alias("target_nulls"),
        *[count_null(c).alias(f"nulls__{i}") for i, c in enumerate(present)],
    ).select(
        "rows",
        F.lit(len(present)).cast("long").alias("features_present"),
        F.lit(len(features) - len(present)).cast("long").alias("features_absent"),
        null_columns.cast("long").alias("columns_with_nulls"),
        F.lit(len(other)).cast("long").alias("non_numeric_columns"),
        "target_nulls",
        "late_rows",
        "on_time_rows",
        F.try_divide(F.col("late_rows"), F.col("rows")).alias("late_rate"),
        F.when(F.col("rows") == 0, "empty")
        .when(rate < 0.05, "strong imbalance")
        .when(rate < 0.15, "moderate imbalance")
        .otherwise("balanced")
        .alias("class_balance"),
    )


def target_distribution(df: DataFrame, target: str = TARGET_COLUMN) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        count_where(F.col(target) == 1).alias("late_orders"),
        count_where(F.col(target) == 0).alias("on_time_orders"),
    ).select(
        "rows",
        "late_orders",
        "on_time_orders",
        percent(F.col("late_orders"), F.col("rows")).alias("late_rate_pct"),
        percent(F.col("on_time_orders"), F.col("rows")).alias("on_time_rate_pct"),
    )


def derived_feature_stats(
    df: DataFrame, features: Sequence[str] = DERIVED_FEATURES, target: str = TARGET_COLUMN
) -> DataFrame:
    """Mean, nulls and target correlation of the derived features."""
    target_value = F.col(target).cast("double")
    aggregates = []
    for i, c in enumerate(features):
        x = F.col(c).cast("double")
        aggregates += [
            F.avg(x).alias(f"mean__{i}"),
            count_null(x).alias(f"null_count__{i}"),
            guarded_corr(x, target_value).alias(f"corr__{i}"),
        ]
    entries = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"mean__{i}").alias("mean"),
            F.col(f"null_count__{i}").alias("null_count"),
            F.col(f"corr__{i}").alias("corr_with_is_late"),
        )
        for i, c in enumerate(features)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*entries)))
