"""Lookup joins whose strategy follows the measured size of the lookup side."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024

# Bytes per value of fixed-width types other than 8.
_WIDTH = {"boolean": 1, "int": 4, "date": 4, "float": 4}


@dataclass(frozen=True)
class Lookup:
    """A table with one row per key, its number of rows, and the measured mean bytes of text columns."""

    table: DataFrame
    rows: int
    text_bytes: Mapping[str, float] = field(default_factory=dict)

    def extended(self, table: DataFrame) -> Lookup:
        """The same rows with other columns."""
        return replace(self, table=table)

    def size(self) -> float:
        """Bytes of the table; a text column that wasn't measured makes it unbounded."""
        width = 16.0
        for name, data_type in self.table.dtypes:
            if data_type == "string":
                width += 8 + self.text_bytes.get(name, math.inf)
            else:
                width += _WIDTH.get(data_type, 8)
        return self.rows * width if self.rows else 0

    def is_small(self, limit_bytes: int = BROADCAST_LIMIT_BYTES) -> bool:
        return self.size() <= limit_bytes


def sized_lookups(tables: Mapping[str, DataFrame]) -> dict[str, Lookup]:
    """Count the rows and text bytes of the lookup tables, in one job.

    The optimizer only knows file sizes: it overestimates a lookup built from joins and
    would shuffle the facts for it. A column has the larger mean where two tables share its name.
    """
    counts, texts = None, {}
    for name, table in tables.items():
        texts[name] = [column for column, data_type in table.dtypes if data_type == "string"]
        sums = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).cast("bigint") for c in texts[name]]
        row = table.agg(
            F.count(F.lit(1)).alias("rows"), F.array(*sums).cast("array<bigint>").alias("bytes")
        ).select(F.lit(name).alias("name"), "rows", "bytes")
        counts = row if counts is None else counts.unionByName(row)
    found = {r["name"]: r for r in counts.collect()}
    means: dict[str, float] = {}
    for name, columns in texts.items():
        for column, total in zip(columns, found[name]["bytes"]):
            mean = total / max(1, found[name]["rows"])
            means[column] = max(mean, means.get(column, 0.0))
    return {name: Lookup(table, found[name]["rows"], means) for name, table in tables.items()}


def lookup_join(
    facts: DataFrame, lookup: Lookup, key: str, limit_bytes: int = BROADCAST_LIMIT_BYTES
) -> DataFrame:
    """Left join on one key.

    A lookup whose measured size is below the limit is broadcast, so the facts do not move. A larger one is
    joined by shuffle; when one key holds a large share of the facts, adaptive execution
    splits its partition, which a left join allows on the fact side.
    """
    table = F.broadcast(lookup.table) if lookup.is_small(limit_bytes) else lookup.table
    return facts.join(table, key, "left")
