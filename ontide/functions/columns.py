"""Column expressions. All of them stay inside built-in Spark functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS_PER_DAY = 86_400e6
MICROS_PER_HOUR = 3_600e6
EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def micros_between(start: Column | str, end: Column | str) -> Column:
    """`end - start` of two timestamp_ntz in microseconds.

    The parts of the interval do not depend on the session time zone, which
    `timestamp_diff` would apply.
    """
    span = _col(end) - _col(start)

    def part(unit: str) -> Column:
        return F.extract(F.lit(unit), span)

    seconds = (part("DAY") * 24 + part("HOUR")) * 3600 + part("MINUTE") * 60
    return seconds.cast("long") * 1_000_000 + (part("SECOND") * 1_000_000).cast("long")


def days_between(start: Column | str, end: Column | str) -> Column:
    """Signed fractional days from `start` to `end`."""
    return micros_between(start, end) / F.lit(MICROS_PER_DAY)


def hours_between(start: Column | str, end: Column | str) -> Column:
    return micros_between(start, end) / F.lit(MICROS_PER_HOUR)


def epoch_micros(column: Column | str) -> Column:
    """A timestamp_ntz as microseconds since 1970, exact in a double until year 2255."""
    return micros_between(F.expr(EPOCH), column)


def from_epoch_micros(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.round(micros).cast("long"), F.expr(EPOCH))


def clip(column: Column, lower: float | None = None, upper: float | None = None) -> Column:
    """Clamp to the given limits. `least`/`greatest` skip nulls, so null is kept by hand."""
    clipped = column
    if upper is not None:
        clipped = F.least(clipped, F.lit(upper))
    if lower is not None:
        clipped = F.greatest(clipped, F.lit(lower))
    return F.when(column.isNotNull(), clipped)


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0; an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double") * 100, whole.cast("double"))


def rate_pct(indicator: Column | str) -> Column:
    """Mean of a 0/1 column in percent."""
    return F.avg(_col(indicator)) * 100


def round_double(column: Column, digits: int) -> Column:
    return F.round(column.cast("double"), digits)


def nan_to_null(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_timestamp(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column; engines differ in the last digits of a sum."""
    return df.select(
        *[
            round_double(F.col(f"`{f.name}`"), digits).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )
