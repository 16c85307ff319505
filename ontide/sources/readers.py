"""Table readers: CSV landing files, parquet stages and catalog tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontide.functions.columns import nan_to_null
from ontide.sources.multiline import read_multiline_csv
from ontide.sources.schemas import TABLES, TableSpec


def table_spec(name: str) -> TableSpec:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; known tables: {', '.join(TABLES)}")
    return TABLES[name]


def typed_column(column: str, data_type: str) -> Column:
    """Parse a text column; text that does not parse becomes null."""
    raw = F.col(f"`{column}`")
    if data_type == "string":
        return raw.cast("string").alias(column)
    if data_type == "timestamp_ntz":
        return raw.try_cast("timestamp_ntz").alias(column)
    if data_type == "int":
        # Nullable integer columns may arrive as "3.0"; "3.7" is no whole number.
        value = raw.try_cast("double")
        return F.when(value == F.floor(value), value).try_cast("int").alias(column)
    return nan_to_null(raw.try_cast(data_type)).alias(column)


# Columns that feed no operator, so they may be absent.
OPTIONAL_COLUMNS = {"shipping_limit_date", "review_creation_date", "review_answer_timestamp"}


def typed_table(raw: DataFrame, spec: TableSpec) -> DataFrame:
    """The table with the types of its schema, whichever format it came from.

    A required column that is absent raises; further columns stay as they are.
    """
    absent = set(spec.types) - set(raw.columns) - OPTIONAL_COLUMNS
    if absent:
        raise ValueError(f"table {spec.name!r} lacks columns {sorted(absent)}")
    return raw.select(
        *[typed_column(c, spec.types[c]) if c in spec.types else F.col(f"`{c}`") for c in raw.columns]
    )


def load_table(
    spark: SparkSession, name: str, root: str, fmt: str = "csv", path: str | None = None
) -> DataFrame:
    """One logical table. A missing file raises Spark's PATH_NOT_FOUND error.

    `fmt="parquet"` reads `<root>/<name>.parquet`, `fmt="table"` a catalog table of the
    schema named by `root`.
    """
    spec = table_spec(name)
    if fmt == "table":
        return typed_table(spark.table(path or f"{root}.{name}"), spec)
    if fmt == "parquet":
        return typed_table(spark.read.parquet(path or f"{root}/{name}.parquet"), spec)
    if fmt != "csv":
        raise ValueError(f"unknown format {fmt!r}; use csv, parquet or table")
    source = path or f"{root}/{spec.pattern}"
    if spec.multiline:
        # dealt out by range and record, whatever the keys
        return typed_table(read_multiline_csv(spark, source), spec)
    raw = spark.read.csv(source, header=True, inferSchema=False, escape='"', encoding="UTF-8")
    return typed_table(raw, spec)


def load_all_tables(
    spark: SparkSession, root: str, fmt: str = "csv", names: list[str] | None = None
) -> dict[str, DataFrame]:
    return {name: load_table(spark, name, root, fmt) for name in (names or list(TABLES))}


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns per table plus a total row."""
    counts = None
    for name, df in tables.items():
        row = df.select().agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"),
            "row_count",
            F.lit(len(df.columns)).cast("long").alias("column_count"),
        )
        counts = row if counts is None else counts.unionByName(row)
    if counts is None:
        raise ValueError("no tables given")
    total = counts.agg(F.sum("row_count").alias("row_count")).select(
        F.lit("TOTAL").alias("table_name"), "row_count", F.lit(None).cast("long").alias("column_count")
    )
    return counts.unionByName(total)
