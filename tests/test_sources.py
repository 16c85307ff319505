import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ontide.sources import cleaning, readers, sinks

ITEMS = """order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value
a,1,p,s,2017-09-19 09:45:35,58.9,13.29
a,2,p,s,not a date,NaN,
b,1,q,s,2017-09-20 09:45:35,oops,1.5
"""
REVIEWS = '''review_id,order_id,review_score,review_comment_message,review_creation_date,review_answer_timestamp
r1,a,4,"two
lines, and a ""quote""",2018-01-18 00:00:00,2018-01-18 21:46:59
r2,b,,plain,2018-01-19 00:00:00,
'''


@pytest.fixture(scope="module")
def landing(tmp_path_factory):
    folder = tmp_path_factory.mktemp("landing")
    (folder / "shop_order_items_dataset.csv").write_text(ITEMS)
    (folder / "shop_order_reviews_dataset.csv").write_text(REVIEWS)
    return str(folder)


def test_csv_types_and_bad_values(spark, landing):
    df = readers.load_table(spark, "order_items", landing)
    assert dict(df.dtypes)["shipping_limit_date"] == "timestamp_ntz"
    rows = df.orderBy("order_id", "order_item_id").collect()
    assert rows[0].shipping_limit_date == dt.datetime(2017, 9, 19, 9, 45, 35)
    assert rows[1].shipping_limit_date is None
    assert [r.price for r in rows] == [58.9, None, None]
    assert rows[1].freight_value is None


def test_csv_line_breaks_inside_quotes(spark, landing):
    df = readers.load_table(spark, "reviews", landing)
    rows = {r.review_id: r for r in df.collect()}
    assert set(rows) == {"r1", "r2"}
    assert rows["r1"].review_comment_message == 'two\nlines, and a "quote"'
    assert (rows["r1"].review_score, rows["r2"].review_score) == (4, None)


def test_unknown_table_and_missing_file(spark, landing):
    with pytest.raises(ValueError, match="order_items"):
        readers.load_table(spark, "invoices", landing)
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        readers.load_table(spark, "sellers", landing)


def test_row_counts_have_a_total(spark):
    tables = {"a": spark.range(3).toDF("x"), "b": spark.range(4).selectExpr("id x", "id y")}
    rows = {r.table_name: (r.row_count, r.column_count) for r in readers.table_row_counts(tables).collect()}
    assert rows == {"a": (3, 1), "b": (4, 2), "TOTAL": (7, None)}


def test_formats_give_equal_rows(spark, tmp_path):
    rows = [("r1", "o1", "3.0", "2020-01-02 03:04:05"), ("r2", "o2", "3.7", "nan"), ("r3", None, None, None)]
    columns = ["review_id", "order_id", "review_score", "review_creation_date"]
    text = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    text.write.parquet(str(tmp_path / "reviews.parquet"))
    text.write.option("header", True).csv(str(tmp_path / "csv"))
    text.write.mode("overwrite").saveAsTable("typed_reviews")
    found = [
        readers.load_table(spark, "reviews", str(tmp_path), "parquet"),
        readers.load_table(spark, "reviews", "", "table", path="typed_reviews"),
        readers.load_table(spark, "reviews", "", "csv", path=str(tmp_path / "csv")),
    ]
    spark.sql("DROP TABLE typed_reviews")
    kinds = [df.dtypes for df in found]
    assert kinds[0] == kinds[1] == kinds[2]
    assert [r["review_score"] for r in found[0].orderBy("review_id").collect()] == [3, None, None]
    assert found[0].exceptAll(found[2]).isEmpty() and found[2].exceptAll(found[0]).isEmpty()


def test_parquet_lacking_a_column_is_refused(spark, tmp_path):
    spark.range(2).withColumnRenamed("id", "order_id").write.parquet(str(tmp_path / "reviews.parquet"))
    with pytest.raises(ValueError, match="lacks columns"):
        readers.load_table(spark, "reviews", str(tmp_path), "parquet")


def test_clean_column_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], [" Order-ID ", "Price/Unit.x", "a b"])
    assert cleaning.clean_column_names(df).columns == ["order_id", "price_unit_x", "a_b"]
    clash = spark.createDataFrame([(1, 2)], ["a b", "A-B"])
    with pytest.raises(ValueError, match="a_b"):
        cleaning.clean_column_names(clash)


def test_nan_text_becomes_null(spark):
    df = spark.createDataFrame([("nan", 1.0), ("x", 2.0), (None, 3.0)], "s string, n double")
    assert [r.s for r in cleaning.nan_strings_to_null(df).orderBy("n").collect()] == [None, "x", None]


def test_warehouse_load_replaces_and_checks(spark, tmp_path):
    sinks.create_schema(spark, "shop")
    sinks.create_schema(spark, "shop")
    sinks.load_warehouse_table(spark.range(9), "shop.numbers")
    stored = sinks.load_warehouse_table(spark.range(5), "shop.numbers")
    check = sinks.load_check(spark.range(5), stored).first()
    assert (check.source_rows, check.stored_rows, check.matches) == (5, 5, True)
    assert sinks.load_check(spark.range(6), stored).first().matches is False
    result = sinks.run_query_to_csv(spark, "SELECT count(*) AS n FROM shop.numbers", str(tmp_path / "q"))
    assert result.first().n == 5
    assert spark.read.csv(str(tmp_path / "q"), header=True).first().n == "5"
    with pytest.raises(ValueError, match="lacks columns"):
        readers.load_table(spark, "orders", "shop", "table", "shop.numbers")


def test_json_document_round_trip(spark, tmp_path):
    path = str(tmp_path / "metrics")
    assert sinks.load_json(spark, path, "a int, b struct<c: double>") is None
    sinks.save_json(spark.sql("SELECT 1 AS a, named_struct('c', 0.5D) AS b"), path)
    assert sinks.load_json(spark, path, "a int, b struct<c: double>").first().b.c == 0.5


def test_bucketed_tables_join_without_a_shuffle(spark, tables):
    from ontide.operators.mart import payment_features, review_features

    names = ("orders", "payments", "reviews")
    stored = sinks.store_bucketed({n: tables[n] for n in names}, "bucketed", 4)
    setting = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(setting, "-1")
    try:
        joined = (
            stored["orders"]
            .join(payment_features(stored["payments"]), "order_id", "left")
            .join(review_features(stored["reviews"]), "order_id", "left")
        )
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert joined.count() == tables["orders"].count()
    finally:
        spark.conf.unset(setting)


def test_bucketed_items_aggregate_without_a_shuffle(spark, tables):
    from ontide.operators.mart import item_features

    stored = sinks.store_bucketed({"order_items": tables["order_items"]}, "bucketed", 4)
    features = item_features(
        stored["order_items"], tables["products"], tables["category_translation"], tables["sellers"]
    )
    plan = features._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(order_id" in line]
    assert moved == []
    assert features.count() == tables["order_items"].select("order_id").distinct().count()


def test_partitioned_mart_prunes_by_period(spark, tables, tmp_path):
    from ontide.plans.reports import build_order_mart

    stored = build_order_mart(tables, str(tmp_path / "mart"))
    plan = stored.filter("purchase_year = 1996").groupBy("customer_state").agg(F.avg("is_late"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(purchase_year" in text
