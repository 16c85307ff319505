"""Repeatable stratified splits and class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontide.contract import TARGET_COLUMN
from ontide.functions.aggregates import count_where
from ontide.operators.quantiles import order_statistics
from ontide.session import stage

HASH_SPACE = 1 << 52


def split_hash(key: str, seed: int) -> Column:
    """Uniform number below 2^52 that depends only on key and seed."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(HASH_SPACE)).cast("double")


def hash_cutoffs(
    df: DataFrame,
    key: str,
    target: str,
    shares: Sequence[float],
    seed: int,
    classes: Sequence[int] = (0, 1),
) -> dict[int, list[float]]:
    """Hash values below which the given shares of each class lie.

    The cutoff is an exact order statistic, so each class is split to the row, without
    numbering the rows of a class in one task.
    """
    hashes = stage(
        df.select(
            *[
                F.when(F.col(target) == label, split_hash(key, seed)).alias(f"class_{label}")
                for label in classes
            ]
        )
    )
    counts = hashes.agg(
        *[F.count(f"class_{label}").alias(f"rows_{label}") for label in classes],
        *[F.approx_count_distinct(f"class_{label}").alias(f"distinct_{label}") for label in classes],
    ).first()
    ranks: dict[str, list[tuple[int, int]]] = {}
    sizes = {label: [round(s * counts[f"rows_{label}"]) for s in shares] for label in classes}
    for label in classes:
        inner = {n for n in sizes[label] if 0 < n < counts[f"rows_{label}"]}
        if inner:
            ranks[f"class_{label}"] = [(n, n) for n in sorted(inner)]
    counted = {
        f"class_{label}": (counts[f"rows_{label}"], counts[f"distinct_{label}"])
        for label in classes
    }
    found = order_statistics(hashes, ranks, counted)
    cutoffs = {}
    for label in classes:
        cutoffs[label] = [
            0.0
            if n <= 0
            else found.get((f"class_{label}", n), float(HASH_SPACE))
            for n in sizes[label]
        ]
    return cutoffs


def stratified_split(
    df: DataFrame,
    key: str = "order_id",
    target: str = TARGET_COLUMN,
    test_share: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """Add `split` ("train" or "test") with the same class ratio in both parts."""
    cutoffs = hash_cutoffs(df, key, target, [test_share], seed)
    in_test = F.lit(False)
    for label, (cutoff,) in cutoffs.items():
        in_test = in_test | ((F.col(target) == label) & (split_hash(key, seed) < F.lit(cutoff)))
    return df.withColumn("split", F.when(in_test, "test").otherwise("train"))


def stratified_folds(
    df: DataFrame,
    folds: int = 3,
    key: str = "order_id",
    target: str = TARGET_COLUMN,
    seed: int = 42,
) -> DataFrame:
    """Add `fold` 0..folds-1 with the same class ratio in every fold."""
    shares = [i / folds for i in range(1, folds)]
    cutoffs = hash_cutoffs(df, key, target, shares, seed)
    fold = F.lit(0)
    for label, edges in cutoffs.items():
        for edge in edges:
            above = (F.col(target) == label) & (split_hash(key, seed) >= F.lit(edge))
            fold = fold + above.cast("int")
    return df.withColumn("fold", fold)


def split_balance(
    df: DataFrame, split: str = "split", target: str = TARGET_COLUMN, limit: float = 0.005
) -> DataFrame:
    """Rows and late rate per part and whether the two rates are close."""
    train, test = F.col(split) == "train", F.col(split) == "test"
    late = F.col(target) == 1
    return df.agg(
        count_where(train).alias("train_rows"),
        count_where(test).alias("test_rows"),
        F.try_divide(count_where(train & late), count_where(train)).alias("train_late_rate"),
        F.try_divide(count_where(test & late), count_where(test)).alias("test_late_rate"),
    ).select(
        "*",
        F.abs(F.col("train_late_rate") - F.col("test_late_rate")).alias("rate_difference"),
        (F.abs(F.col("train_late_rate") - F.col("test_late_rate")) < limit).alias("balanced"),
    )


def class_weight(df: DataFrame, target: str = TARGET_COLUMN) -> DataFrame:
    """Weight of a late row: on-time rows per late row. Without late rows the query fails."""
    on_time, late = count_where(F.col(target) == 0), count_where(F.col(target) == 1)
    return df.agg(on_time.alias("on_time_rows"), late.alias("late_rows")).select(
        "on_time_rows",
        "late_rows",
        F.when(
            F.col("late_rows") == 0,
            F.raise_error(F.lit("no positive (late) rows in the target")).cast("double"),
        )
        .otherwise(F.try_divide(F.col("on_time_rows"), F.col("late_rows")))
        .alias("scale_pos_weight"),
    )
