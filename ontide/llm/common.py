"""Helpers of the operators: tables, words of a text, Arrow batches in and out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Fixed value: the bytes that part words, space and tab to carriage return. They are the
# white space of bytes.split() too.
SPACES = " \t\n\x0b\x0c\r"
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"

ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

KINDS = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "array<bigint>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
}
SLICE_ROWS = 128


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return column.cast(pa.large_binary() if large else pa.binary()).to_pylist()


def lower_words(text: bytes | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased; a null text has none."""
    return text.translate(ASCII_LOWER).split() if text else []


def parts(fields: str) -> list[tuple[str, str]]:
    """Names and types of a schema such as "doc_id bigint, keys array<bigint>"."""
    return [tuple(field.strip().split(" ", 1)) for field in fields.split(",")]


def batch_of(rows: list[tuple], fields: list[tuple[str, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    arrays = [pa.array(list(c), KINDS[kind]) for c, (_, kind) in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def map_rows(
    df: DataFrame,
    process: Callable[[], Callable[[pa.RecordBatch], Iterable[tuple]]],
    fields: str,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Apply a row function to every partition in small Arrow slices.

    `process` is called once per task and returns the function that turns a slice into
    rows; what it builds (a matcher, a cache) serves the whole task. `carry` names the last columns of
    `df`, which follow each row unchanged; the function then gives one row for each input row.
    """
    kinds, carried = parts(fields), list(carry)
    schema = ", ".join([fields, *(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carried)])
    first = len(df.columns) - len(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = process()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                piece = batch.slice(start, SLICE_ROWS)
                made = batch_of(list(function(piece)), kinds)
                if carried:
                    arrays = [*made.columns, *piece.columns[first:]]
                    made = pa.RecordBatch.from_arrays(arrays, [*made.schema.names, *carried])
                yield made

    return df.mapInArrow(run, schema)


def input_parts(df: DataFrame) -> int:
    """A number of buckets that follows the input: twice its scan tasks, the shuffle setting at least."""
    spark = df.sparkSession
    setting = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(setting, 2 * df.rdd.getNumPartitions())
