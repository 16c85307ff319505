"""CSV files with line breaks inside quotes, read by many tasks.

Spark's reader gives such a file to one task, because a line may lie inside a quoted value. Only the
records' boundaries need the text before: whether a line starts inside quotes is the parity of the
quotes before it. So the files are read as lines in ranges, as many as the scan has splits; each range counts its
quotes, a scan over the ranges' parities tells in which state each one starts, and inside a range a
running count finds the lines that start a record. Records that cross ranges are stitched from their
fragments, at most two a range. The text moves once, by range; parsing stays `from_csv`.

The lines are stored first: the passes must see the same ranges, which follow the number of executors.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ontide.session import stage

OPTIONS = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
RANGE = ["file", "start"]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, line, value, quotes): lines with their range, and their order inside it."""
    lines = spark.read.text(path, lineSep="\n")
    value = F.col("value")
    return stage(
        lines.select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("line"),
            value,
            (F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))).alias("quotes"),
        )
    )


def open_ranges(lines: DataFrame) -> DataFrame:
    """(file, start, opened, returns): whether a range starts inside quotes, and whether the file's lines end with
    a carriage return, as its first line does. One row a range."""
    totals = lines.groupBy(*RANGE).agg(
        F.sum("quotes").alias("quotes"), F.min_by(F.endswith("value", F.lit("\r")), "line").alias("returns")
    )
    in_file = Window.partitionBy("file").orderBy("start")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.coalesce(F.sum("quotes").over(before), F.lit(0))
    return totals.select(*RANGE, (so_far % 2).alias("opened"), F.first("returns").over(in_file).alias("returns"))


def joined_lines(*order: str) -> Column:
    """The group's values in order, parted by line breaks."""
    rows = F.array_sort(F.collect_list(F.struct(*order, "value")))
    return F.array_join(F.transform(rows, lambda row: row["value"]), "\n")


def record_fragments(lines: DataFrame) -> DataFrame:
    """(file, start, record, value, unfinished): the records' parts in each range; record 0 goes on from before."""
    here = Window.partitionBy(*RANGE).orderBy("line")
    above = here.rowsBetween(Window.unboundedPreceding, -1)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    bare = F.when(F.col("returns"), F.regexp_replace("value", "\r$", "")).otherwise(F.col("value"))
    known = lines.join(open_ranges(lines), RANGE).withColumn("value", bare)
    inside = (F.col("opened") + F.coalesce(F.sum("quotes").over(above), F.lit(0))) % 2
    marked = known.withColumn("begins", F.when(inside == 0, 1).otherwise(0))
    counted = marked.withColumn("record", F.sum("begins").over(upto))
    parity = (F.sum("quotes") + F.when(F.col("record") == 0, 1).otherwise(0)) % 2
    return stage(
        counted.groupBy(*RANGE, "record").agg(
            joined_lines("line").alias("value"), (parity == 1).alias("unfinished")
        )
    )


def records(fragments: DataFrame) -> DataFrame:
    """(file, start, record, value): whole records, by the range in which they start."""
    whole = (F.col("record") > 0) & ~F.col("unfinished")
    ranges = fragments.groupBy(*RANGE).agg(F.max("record").alias("last"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.when(F.col("last") > 0, F.struct("start", "last"))
    origins = ranges.select(*RANGE, F.last(begun, ignorenulls=True).over(before).alias("origin"))
    crossing = fragments.filter(~whole).join(origins, RANGE)
    first = F.col("record") > 0
    stitched = crossing.groupBy(
        "file",
        F.when(first, F.col("start")).otherwise(F.col("origin.start")).alias("begin"),
        F.when(first, F.col("record")).otherwise(F.col("origin.last")).alias("number"),
    ).agg(joined_lines("start").alias("value"))
    return fragments.filter(whole).select(*RANGE, "record", "value").unionByName(
        stitched.select("file", F.col("begin").alias("start"), F.col("number").alias("record"), "value")
    )


def read_multiline_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, named by the first file's header; each file's first record is its header."""
    lines = numbered_lines(spark, path)
    whole = records(record_fragments(lines))
    filled = whole.filter(F.trim(F.regexp_replace("value", "[\r\n]", "")) != "")
    # the header is the first record of a file; the ranges before it hold blank lines at most
    place = F.struct("start", "record")
    heads = filled.groupBy("file").agg(F.min_by("value", place).alias("value"), F.min(place).alias("place"))
    head = heads.orderBy("file").first()
    if head is None:
        raise AnalysisException(f"no header in {path}")
    text = head["value"].removeprefix("\ufeff")
    one = spark.range(1)
    kind = one.select(F.schema_of_csv(F.lit(text), {"escape": '"'})).first()[0]
    width = kind.count("_c")
    schema = ", ".join(f"_c{i} string" for i in range(width))
    names = one.select(F.from_csv(F.lit(text), schema, OPTIONS).alias("head")).first()["head"]
    columns = [name if name is not None else f"_c{i}" for i, name in enumerate(names)]
    places = heads.select("file", F.col("place").alias("head"))
    body = filled.join(places, "file").filter(F.struct("start", "record") != F.col("head"))
    parsed = body.select(F.from_csv("value", schema, OPTIONS).alias("row"))
    return parsed.select(*[F.col(f"row._c{i}").alias(name) for i, name in enumerate(columns)])
