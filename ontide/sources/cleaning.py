"""Column-name and string clean-up before a warehouse load."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean_name(name: str) -> str:
    """Trim, turn space - / . into _, lower-case."""
    return re.sub(r"[ \-/.]", "_", name.strip()).lower()


def clean_column_names(df: DataFrame) -> DataFrame:
    cleaned = [clean_name(c) for c in df.columns]
    duplicates = sorted({c for c in cleaned if cleaned.count(c) > 1})
    if duplicates:
        raise ValueError(f"column names collide after cleaning: {duplicates}")
    return df.toDF(*cleaned)


def nan_strings_to_null(df: DataFrame) -> DataFrame:
    """The literal text "nan" in a string column becomes null."""
    return df.select(
        *[
            F.nullif(F.col(f"`{f.name}`"), F.lit("nan")).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def coerce_timestamps(df: DataFrame, columns: list[str]) -> DataFrame:
    """Parse text columns as timestamps; bad text becomes null, absent columns are skipped."""
    parsed = {}
    for field in df.schema:
        if field.name in columns and isinstance(field.dataType, T.StringType):
            parsed[field.name] = F.col(field.name).try_cast("timestamp_ntz")
    return df.withColumns(parsed) if parsed else df
