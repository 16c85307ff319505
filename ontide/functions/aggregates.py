"""Aggregate expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def most_common(column: Column | str) -> Column:
    """Most frequent non-null value, the smallest of several; null for an all-null group.

    Its buffer holds one entry per distinct value of the group, so it is for columns
    with few values per group. `operators.profile.value_histogram` serves the others.
    """
    return F.mode(column, True)


def money_sum(column: Column | str) -> Column:
    """Sum of amounts, 0 over a group without values.

    The last digits of a floating-point sum depend on the order in which a shuffle
    delivers the rows. Rounding to a millionth removes them, so equal amounts stay equal
    and every evaluation of a plan gives the same value.
    """
    return F.coalesce(F.round(F.sum(column), 6), F.lit(0.0))


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both are known; null if one is constant."""
    both = x.isNotNull() & y.isNotNull()
    x_known = F.when(both, x.cast("double"))
    y_known = F.when(both, y.cast("double"))
    spread = F.stddev_pop(x_known) * F.stddev_pop(y_known)
    return F.try_divide(F.covar_pop(x_known, y_known), spread)


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def count_null(column: Column | str) -> Column:
    return F.count_if(F.isnull(column))
