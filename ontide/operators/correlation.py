"""Pairwise Pearson correlations from one Gram matrix."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontide.contract import CORRELATION_COLUMNS, TARGET_COLUMN
from ontide.session import stage

# A sum of squared deviations below this share of the sum of squares is rounding: a constant.
_CONSTANT = 1e-12


def pair_correlations(
    df: DataFrame, columns: Sequence[str], others: Sequence[str] | None = None, stable: bool = False
) -> DataFrame:
    """(feature_a, feature_b, correlation) of each column with each of `others`.

    Without `others` it is every pair of `columns` in one order, a column with itself
    included. Each pair uses the rows where both are known; a constant gives null.

    A row becomes a vector of values less the column's mean (0 where unknown), of marks of
    what is known, and of squares. The products of these vectors, summed over the rows, hold all
    counts and sums that the pairs need. Each task adds them up in one small matrix, so no rows
    multiply and nothing but those matrices is exchanged. Two passes read the columns, which are staged,
    so `df` is computed once; `stable=True` promises that it is a stored or staged table.
    """
    mirrored = others is None
    others = list(columns) if others is None else list(others)
    names = list(dict.fromkeys([*columns, *others]))
    n = len(names)
    at = {name: i for i, name in enumerate(names)}
    known = df.select(*[F.col(c).cast("double").alias(f"c{i}") for c, i in at.items()])
    if not stable:
        known = stage(known)
    means = known.agg(*[F.avg(f"c{i}").alias(f"c{i}") for i in range(n)]).first()
    deviations = [F.coalesce(F.col(f"c{i}") - F.lit(means[i] or 0.0), F.lit(0.0)) for i in range(n)]
    marks = [F.col(f"c{i}").isNotNull().cast("double") for i in range(n)]
    squares = [d * d for d in deviations]
    vectors = known.select(array_to_vector(F.array(*deviations, *marks, *squares)).alias("v"))
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v"), 0, 3 * n)
    sums = gram.computeGramianMatrix().toArray() if any(m is not None for m in means) else None

    def correlation(i: int, j: int) -> float | None:
        if sums is None:
            return None
        rows, product = sums[n + i, n + j], sums[i, j]
        a, b = sums[i, n + j], sums[j, n + i]
        aa, bb = sums[2 * n + i, n + j], sums[2 * n + j, n + i]
        spread_a, spread_b = rows * aa - a * a, rows * bb - b * b
        if spread_a <= _CONSTANT * rows * aa or spread_b <= _CONSTANT * rows * bb:
            return None
        return float((rows * product - a * b) / (math.sqrt(spread_a) * math.sqrt(spread_b)))

    pairs = [
        (first, second, correlation(at[first], at[second]))
        for i, first in enumerate(columns)
        for j, second in enumerate(others)
        if not mirrored or i <= j
    ]
    return df.sparkSession.createDataFrame(
        pairs, "feature_a string, feature_b string, correlation double"
    )


def correlation_matrix(
    df: DataFrame, columns: Sequence[str] = CORRELATION_COLUMNS
) -> DataFrame:
    """The full symmetric matrix in long form; absent columns are skipped."""
    present = [c for c in columns if c in df.columns]
    half = pair_correlations(df, present)
    # The half matrix is a few rows per column, so it is mirrored without a second pass.
    cells = F.array(
        F.struct(F.col("feature_a").alias("feature_a"), F.col("feature_b").alias("feature_b")),
        F.struct(F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b")),
    )
    return (
        half.withColumn("cell", F.explode(F.array_distinct(cells)))
        .select("cell.feature_a", "cell.feature_b", "correlation")
        .orderBy("feature_a", "feature_b")
    )


def correlation_with_target(
    df: DataFrame,
    columns: Sequence[str] = CORRELATION_COLUMNS,
    target: str = TARGET_COLUMN,
) -> DataFrame:
    """Correlation of each column with the target, strongest first."""
    present = [c for c in columns if c in df.columns and c != target]
    return (
        pair_correlations(df, present, [target])
        .select(
            F.col("feature_a").alias("feature"),
            F.col("correlation").alias("correlation_with_late_delivery"),
        )
        .orderBy(F.abs("correlation_with_late_delivery").desc_nulls_last(), "feature")
    )
