"""Running totals over a large ordered table, by a scan of two levels.

A window without partitions would move every row to one task. The rows are dealt into ordered ranges
instead, as many as the rows need; each range is summed on its own and starts from the total of
the ranges before it. Only the ranges' totals, one row each, are ordered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontide.session import stage

ROWS_PER_RANGE = 250_000


def ordered_ranges(df: DataFrame, order_by: Sequence[str], ranges: int) -> DataFrame:
    """The rows stored in ordered ranges, with the range's number in `part`.

    Stored, because the ranges' edges are sampled and each pass must see the same ones.
    """
    if ranges == 1:
        return df.withColumn("part", F.lit(0))
    dealt = df.repartitionByRange(ranges, *order_by)
    return stage(dealt.withColumn("part", F.spark_partition_id()))


def running_totals(
    df: DataFrame,
    order_by: str | Sequence[str],
    measures: Sequence[str],
    descending: bool = False,
    buckets: int | None = None,
    following: bool = False,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add `upto_<measure>`, the inclusive running sum in the order of columns that are unique together.

    `following` also adds `next_<measure>`, the value of the next row in that order. The number
    of ranges follows the rows, unless `buckets` gives it. `df` must give the same rows on every pass.
    """
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    ranges = buckets or max(1, -(-df.count() // rows_per_range))
    cut = ordered_ranges(df, order, ranges)
    if descending:
        cut = cut.withColumn("part", -F.col("part"))
    keys = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    first = F.max_by if descending else F.min_by
    totals = cut.groupBy("part").agg(
        *[F.sum(m).alias(f"sum_{m}") for m in measures],
        *[first(F.col(m), F.struct(*order)).alias(f"first_{m}") for m in measures],
    )
    # One row per range.
    in_order = Window.orderBy("part")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        *[F.coalesce(F.sum(f"sum_{m}").over(before), F.lit(0)).alias(f"offset_{m}") for m in measures],
        *[F.lead(f"first_{m}").over(in_order).alias(f"after_{m}") for m in measures],
    )
    inside = Window.partitionBy("part").orderBy(*keys)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    result = cut.join(F.broadcast(offsets), "part")
    added = {f"upto_{m}": F.col(f"offset_{m}") + F.sum(m).over(upto) for m in measures}
    if following:
        for m in measures:
            added[f"next_{m}"] = F.coalesce(F.lead(m).over(inside), F.col(f"after_{m}"))
    return result.select(*[F.col(c) for c in df.columns], *[v.alias(k) for k, v in added.items()])
