"""Exact order statistics, quantiles and quantile bins of large columns.

Spark's `percentile` keeps every distinct value of a column in one task. Here a column
with many distinct values is first narrowed: an approximate sketch of fixed size gives a
bracket around each wanted rank, one counting pass makes the rank relative to that
bracket, and the bracket is narrowed again until few distinct values are left. Every
pass is a scan with a one-row aggregate; no pass moves the data.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontide.session import stage

MAX_CANDIDATES = 200_000
SKETCH_ACCURACY = 1_000


@dataclass(frozen=True)
class Bracket:
    """Values in [lower, upper] hold the ranks [first, last] (counted from 0) of a column.

    `below` rows lie under the bracket, `rows` inside it.
    """

    column: str
    first: int
    last: int
    lower: float | None = None
    upper: float | None = None
    below: int = 0
    rows: int = 0
    distinct: int = 0

    def contains(self) -> Column:
        inside = F.col(self.column).isNotNull()
        if self.lower is not None:
            inside = inside & (F.col(self.column) >= F.lit(self.lower))
        if self.upper is not None:
            inside = inside & (F.col(self.column) <= F.lit(self.upper))
        return inside

    def settled(self, limit: int) -> bool:
        return self.distinct <= limit or (self.lower is not None and self.lower == self.upper)


def _measure(df: DataFrame, brackets: list[Bracket]) -> list[Bracket]:
    """Count the rows under and inside each bracket, in one pass."""
    aggregates = []
    for i, bracket in enumerate(brackets):
        inside = bracket.contains()
        under = (
            F.lit(False)
            if bracket.lower is None
            else F.col(bracket.column) < F.lit(bracket.lower)
        )
        aggregates += [
            F.count_if(under).alias(f"below_{i}"),
            F.count_if(inside).alias(f"rows_{i}"),
            F.approx_count_distinct(F.when(inside, F.col(bracket.column))).alias(f"distinct_{i}"),
        ]
    row = df.agg(*aggregates).first()
    return [
        replace(b, below=row[f"below_{i}"], rows=row[f"rows_{i}"], distinct=row[f"distinct_{i}"])
        for i, b in enumerate(brackets)
    ]


def _narrow(df: DataFrame, brackets: list[Bracket], accuracy: int) -> list[Bracket]:
    """Tighten each bracket with a sketch of the values inside it."""
    margin = 2.0 / accuracy
    sketches = []
    for i, bracket in enumerate(brackets):
        low = (bracket.first - bracket.below) / bracket.rows - margin
        high = (bracket.last + 1 - bracket.below) / bracket.rows + margin
        sketches.append(
            F.percentile_approx(
                F.when(bracket.contains(), F.col(bracket.column)),
                [min(max(low, 0.0), 1.0), min(max(high, 0.0), 1.0)],
                accuracy,
            ).alias(f"edges_{i}")
        )
    row = df.agg(*sketches).first()
    proposed = [
        replace(b, lower=row[f"edges_{i}"][0], upper=row[f"edges_{i}"][1])
        for i, b in enumerate(brackets)
    ]
    # A bracket is accepted only if the count proves that it holds the wanted ranks.
    return [
        new if new.below <= new.first and new.last < new.below + new.rows else old
        for old, new in zip(brackets, _measure(df, proposed))
    ]


def _pick(df: DataFrame, brackets: list[Bracket]) -> dict[tuple[str, int], float]:
    """Values at the wanted ranks, from the few distinct values inside the brackets."""
    spans: dict[tuple, list[Bracket]] = {}
    for bracket in brackets:
        spans.setdefault((bracket.column, bracket.lower, bracket.upper), []).append(bracket)
    members = list(spans.values())
    wanted = [sorted({r - b.below for b in group for r in (b.first, b.last)}) for group in members]
    inside = [F.when(group[0].contains(), F.col(group[0].column)) for group in members]
    counts = (
        df.select(F.posexplode(F.array(*inside)).alias("span", "value"))
        .filter(F.col("value").isNotNull())
        .groupBy("span", "value")
        .count()
    )
    order = Window.partitionBy("span").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("count").over(order))
    positions = F.element_at(
        F.array(*[F.array(*[F.lit(p) for p in group]) for group in wanted]), F.col("span") + 1
    )
    hits = ranked.filter(
        F.exists(
            positions,
            lambda p: (p < F.col("upto")) & (p >= F.col("upto") - F.col("count")),
        )
    ).collect()
    found = {}
    for hit in hits:
        group = members[hit["span"]]
        for position in wanted[hit["span"]]:
            if hit["upto"] - hit["count"] <= position < hit["upto"]:
                found[group[0].column, position + group[0].below] = hit["value"]
    return found


def order_statistics(
    df: DataFrame,
    ranks: Mapping[str, Sequence[tuple[int, int]]],
    counted: Mapping[str, tuple[int, int]] | None = None,
    max_candidates: int = MAX_CANDIDATES,
    accuracy: int = SKETCH_ACCURACY,
) -> dict[tuple[str, int], float]:
    """Values at 0-based ranks. `ranks` lists (first, last) pairs of near ranks per column.

    `df` must give the same values on every pass: a scan or a staged table.
    """
    brackets = [
        Bracket(name, first, last) for name, pairs in ranks.items() for first, last in pairs
    ]
    if not brackets:
        return {}
    if counted is None:
        brackets = _measure(df, brackets)
    else:
        brackets = [
            replace(b, rows=counted[b.column][0], distinct=counted[b.column][1]) for b in brackets
        ]
    while True:
        wide = [b for b in brackets if not b.settled(max_candidates)]
        if not wide:
            break
        done = [b for b in brackets if b.settled(max_candidates)]
        narrowed = _narrow(df, wide, accuracy)
        if narrowed == wide:
            accuracy *= 4
        brackets = done + narrowed
    found = {
        (b.column, rank): b.lower
        for b in brackets
        if b.lower is not None and b.lower == b.upper
        for rank in (b.first, b.last)
    }
    rest = [b for b in brackets if b.lower is None or b.lower != b.upper]
    if rest:
        found.update(_pick(df, rest))
    return found


def exact_quantiles(
    df: DataFrame,
    columns: Mapping[str, Column] | Sequence[str],
    probabilities: Sequence[float],
    stable: bool = False,
    max_candidates: int = MAX_CANDIDATES,
    accuracy: int = SKETCH_ACCURACY,
) -> dict[str, list[float | None]]:
    """Interpolated quantiles of numeric columns, nulls left out; None for an empty column.

    All columns share the passes. `stable=True` promises that `df` repeats its values
    exactly, so it is not staged.
    """
    if not isinstance(columns, Mapping):
        columns = {name: F.col(name) for name in columns}
    names = list(columns)
    values = df.select(*[columns[n].cast("double").alias(n) for n in names])
    if not stable:
        values = stage(values)
    head = values.agg(
        *[F.count(n).alias(f"rows_{n}") for n in names],
        *[F.approx_count_distinct(n).alias(f"distinct_{n}") for n in names],
    ).first()
    counted = {n: (head[f"rows_{n}"], head[f"distinct_{n}"]) for n in names}
    positions = {
        n: [p * (counted[n][0] - 1) for p in probabilities] for n in names if counted[n][0]
    }
    ranks = {
        n: sorted({(math.floor(at), math.ceil(at)) for at in spots})
        for n, spots in positions.items()
    }
    found = order_statistics(values, ranks, counted, max_candidates, accuracy)
    result: dict[str, list[float | None]] = {n: [None] * len(probabilities) for n in names}
    for name, spots in positions.items():
        for i, at in enumerate(spots):
            low, high = found[name, math.floor(at)], found[name, math.ceil(at)]
            result[name][i] = low + (high - low) * (at - math.floor(at))
    return result


def quantile_bins(
    df: DataFrame, column: str, measure: str, bins: int = 4, max_candidates: int = MAX_CANDIDATES
) -> DataFrame:
    """Mean of `measure` and row count per quantile bin of `column`.

    Bins are closed on the right, the first one also on the left; equal edges merge.
    Rows without a value are left out.
    """
    data = stage(
        df.select(F.col(column).cast("double").alias("value"), F.col(measure).alias("measure"))
        .filter(F.col("value").isNotNull())
    )
    probabilities = [i / bins for i in range(bins + 1)]
    edges = exact_quantiles(
        data, ["value"], probabilities, stable=True, max_candidates=max_candidates
    )["value"]
    edges = sorted({e for e in edges if e is not None})
    if len(edges) < 2:
        # A constant column has no bin.
        index = F.lit(None).cast("int")
    else:
        index = F.lit(0)
        for edge in edges[1:-1]:
            index = index + (F.col("value") > F.lit(edge)).cast("int")
    lower = F.element_at(F.array(*[F.lit(e) for e in edges or [0.0]]), F.col("bin_index") + 1)
    upper = F.element_at(F.array(*[F.lit(e) for e in edges or [0.0]]), F.col("bin_index") + 2)
    return (
        data.withColumn("bin_index", index)
        .filter(F.col("bin_index").isNotNull())
        .groupBy("bin_index")
        .agg(
            F.avg("measure").alias("late_rate"),
            F.count("measure").alias("order_count"),
        )
        .select(
            "bin_index",
            lower.alias("lower_edge"),
            upper.alias("upper_edge"),
            "late_rate",
            "order_count",
            (F.col("late_rate") * 100).alias("late_rate_pct"),
        )
        .orderBy("bin_index")
    )
