"""CSV with line breaks inside quotes, read in ranges, against Spark's one-task reader."""

import random

import pytest
from pyspark.sql import functions as F

from ontide.sources import multiline, readers

HEADER = "review_id,order_id,review_score,review_comment_message,review_creation_date,review_answer_timestamp"


@pytest.fixture
def small_ranges(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "600", "spark.sql.files.openCostInBytes": "1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def one_task(spark, path):
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def same(one, two):
    assert one.columns == two.columns
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def comment(rng, line_break):
    words = [rng.choice(["fine", 'a ""quote""', "late, but ok", "é", "", '""', line_break, line_break * 2]) for _ in range(rng.randint(0, 9))]
    return '"' + " ".join(words) + '"'


@pytest.mark.parametrize("line_break", ["\n", "\r\n"])
def test_ranges_give_the_rows_of_one_task(spark, small_ranges, tmp_path, line_break):
    rng = random.Random(3)
    rows = [f"r{i},o{i % 40},{i % 5},{comment(rng, line_break)},2018-01-18 00:00:00," for i in range(300)]
    path = tmp_path / "x_order_reviews_dataset.csv"
    path.write_bytes((line_break.join([HEADER, *rows]) + line_break).encode())
    lines = multiline.numbered_lines(spark, str(path))
    assert lines.select("start").distinct().count() >= 8
    found = multiline.read_multiline_csv(spark, str(path))
    same(found, one_task(spark, str(path)))
    assert found.count() == 300
    table = readers.load_table(spark, "reviews", str(tmp_path))
    assert table.filter(F.col("review_score") == 3).count() == 60


def test_record_over_several_ranges(spark, small_ranges, tmp_path):
    long = "\n".join(f"line {i} with, commas and \"\"quotes\"\"" for i in range(150))
    path = tmp_path / "long.csv"
    path.write_text(f'a,b\n1,"{long}"\n2,short\n3,"{long}"\n')
    ranges = multiline.numbered_lines(spark, str(path))
    fragments = multiline.record_fragments(ranges)
    assert fragments.filter("record = 0 and unfinished").count() >= 3
    same(multiline.read_multiline_csv(spark, str(path)), one_task(spark, str(path)))


def test_several_files_blank_lines_and_no_last_break(spark, small_ranges, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('a,b,c\n\n1,"x\n\ny",\n2,,""\n\n')
    (tmp_path / "in" / "b.csv").write_text("a,b,c\n" + "".join(f'{i},"p\nq{i}",z\n' for i in range(200)) + "9,last,")
    path = str(tmp_path / "in")
    found = multiline.read_multiline_csv(spark, path)
    same(found, one_task(spark, path))
    assert found.count() == 203


def test_quote_that_never_closes(spark, small_ranges, tmp_path):
    path = tmp_path / "open.csv"
    path.write_text("a,b\n1,x\n" + "2,\"open\n" + "".join(f"{i},text\n" for i in range(300)))
    found = multiline.read_multiline_csv(spark, str(path)).orderBy("a").collect()
    assert [r.a for r in found] == ["1", "2"] and found[1].b.startswith("open\n0,text")


def test_no_single_task_reads_all(spark, small_ranges, tmp_path):
    path = tmp_path / "many.csv"
    path.write_text("a,b\n" + "".join(f'{i},"p\nq"\n' for i in range(2000)))
    spread = multiline.records(multiline.record_fragments(multiline.numbered_lines(spark, str(path))))
    sizes = [r["count"] for r in spread.groupBy("start").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 200 and sum(sizes) == 2001
