import datetime as dt

from pyspark.sql import functions as F

from ontide.functions.aggregates import money_sum, most_common
from ontide.operators import joins
from ontide.operators import mart as mt

ORDER = (
    "order_id string, customer_id string, order_status string, "
    "order_purchase_timestamp timestamp_ntz, order_approved_at timestamp_ntz, "
    "order_delivered_carrier_date timestamp_ntz, order_delivered_customer_date timestamp_ntz, "
    "order_estimated_delivery_date timestamp_ntz"
)


def at(day, hour=0, minute=0, second=0):
    return dt.datetime(2020, 1, day, hour, minute, second)


def orders(spark, *rows):
    return spark.createDataFrame(list(rows), ORDER)


def test_delivered_filter_and_dropped_orders(spark):
    df = orders(
        spark,
        ("a", "c", "delivered", at(1), None, None, at(3), at(5)),
        ("b", "c", "delivered", at(1), None, None, None, at(5)),
        ("d", "c", "canceled", at(1), None, None, at(3), at(5)),
        ("e", "c", None, at(1), None, None, at(3), at(5)),
    )
    assert [r.order_id for r in mt.delivered_orders(df).collect()] == ["a"]
    assert mt.dropped_orders(df).first().asDict() == {
        "delivered_orders": 2,
        "kept_orders": 1,
        "dropped_orders": 1,
    }


def test_durations_keep_seconds_and_sign(spark):
    df = orders(
        spark,
        ("late", "c", "delivered", at(1, 12), None, None, at(5, 0, 0, 1), at(5)),
        ("exact", "c", "delivered", at(1, 12), None, None, at(5), at(5)),
        ("early", "c", "delivered", at(1, 12), None, None, at(3, 18), at(5)),
    )
    rows = {r.order_id: r for r in mt.with_durations(df).collect()}
    assert rows["late"].is_late == 1
    assert abs(rows["late"].delivery_delay_days - 1 / 86400) < 1e-12
    assert rows["exact"].is_late == 0
    assert rows["early"].delivery_delay_days == -1.25
    assert rows["early"].delivery_days_actual == 2.25
    by_date = {r.order_id: r.is_late for r in mt.with_durations(df, by_date=True).collect()}
    assert by_date == {"late": 0, "exact": 0, "early": 0}


def test_durations_do_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2021, 3, 13, 12), dt.datetime(2021, 3, 14, 12))],
        "start timestamp_ntz, end timestamp_ntz",
    )
    from ontide.functions.columns import days_between

    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert df.select(days_between("start", "end")).first()[0] == 1.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_time_parts(spark):
    df = orders(spark, ("a", "c", "delivered", at(4, 23), None, None, at(5), at(6)))
    row = mt.with_time_parts(df).first()
    assert (row.purchase_year, row.purchase_month_num, row.purchase_month) == (2020, 1, "January")
    assert (row.purchase_day_of_week, row.purchase_hour) == ("Saturday", 23)


def test_most_common_ties_nulls_and_single_values(spark):
    df = spark.createDataFrame(
        [("tie", "b"), ("tie", "a"), ("none", None), ("one", "z"), ("nulls", None), ("nulls", "q")],
        "k string, v string",
    )
    found = {r.k: r.m for r in df.groupBy("k").agg(most_common("v").alias("m")).collect()}
    assert found == {"tie": "a", "none": None, "one": "z", "nulls": "q"}


def test_money_sum_is_canonical_and_zero_for_nulls(spark):
    df = spark.createDataFrame([("a", 0.1)] * 3 + [("b", None)], "k string, v double")
    found = {r.k: r.s for r in df.groupBy("k").agg(money_sum("v").alias("s")).collect()}
    assert found == {"a": 0.3, "b": 0.0}


def test_mart_has_one_row_per_delivered_order(spark, tables, mart):
    assert mart.columns == mt.MART_COLUMNS
    delivered = mt.delivered_orders(tables["orders"])
    assert mart.count() == delivered.count() == mart.select("order_id").distinct().count()


def test_orders_without_items_keep_null_features(spark, tables, mart):
    ordered = tables["order_items"].select("order_id").distinct()
    bare = mart.join(ordered, "order_id", "left_anti")
    assert bare.count() > 0
    assert bare.filter(F.col("total_price").isNotNull()).count() == 0


def test_reports_read_only_the_sides_they_use(spark, tables):
    plan = mt.order_mart(tables).groupBy("customer_state").agg(F.avg("is_late"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "l_partkey" not in text and "o_orderpriority" not in text


def test_large_lookups_give_the_same_rows(spark, tables, monkeypatch):
    usual = mt.item_features(*[tables[n] for n in ITEM_TABLES])
    monkeypatch.setattr(joins.Lookup, "is_small", lambda self, limit_bytes=0: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = mt.item_features(*[tables[n] for n in ITEM_TABLES])
        assert "BroadcastHashJoin" not in shuffled._jdf.queryExecution().executedPlan().toString()
        assert shuffled.exceptAll(usual).count() == 0
        assert shuffled.count() == usual.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


ITEM_TABLES = ["order_items", "products", "category_translation", "sellers"]


def test_small_lookups_do_not_move_the_items(spark, tables):
    enriched = mt.enrich_items(*[tables[n] for n in ITEM_TABLES])
    assert "SortMergeJoin" not in enriched._jdf.queryExecution().executedPlan().toString()


def test_hot_product_is_split(spark):
    """A product with a third of all items: adaptive execution splits its partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        items = spark.range(0, 60_000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 997).alias("product_id"),
            F.col("id").alias("order_id"),
        )
        products = spark.range(997).select(
            F.col("id").alias("product_id"), (F.col("id") * 2).alias("size")
        )
        joined = joins.lookup_join(items, joins.Lookup(products, 1 << 40), "product_id")
        totals = joined.groupBy("order_id").agg(F.sum("size").alias("s"))
        assert totals.agg(F.count("s"), F.countDistinct("order_id")).first()[0] == 60_000
        totals.collect()
        plan = totals._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_items_are_scanned_and_dealt_once(spark, tables, tmp_path):
    from ontide.operators.mart import item_features

    names = ["products", "category_translation", "sellers"]
    # a plan's text shortens paths to this length
    spark.conf.set("spark.sql.maxMetadataValueLength", "1000")
    try:
        for rows in (10, 100_000):
            folder = str(tmp_path / str(rows))
            tables["order_items"].limit(rows).write.parquet(folder)
            items = spark.read.parquet(folder)
            features = item_features(items, *(tables[n] for n in names))
            plan = features._jdf.queryExecution().executedPlan().toString()
            assert plan.count(folder) == 1
            assert plan.count("Exchange hashpartitioning(order_id") == 1
    finally:
        spark.conf.unset("spark.sql.maxMetadataValueLength")


def test_spread_items_are_gathered_before_they_are_reduced(spark, tables, mart, monkeypatch):
    from ontide.operators import joins
    from ontide.operators.mart import order_mart

    def gathers(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [order_id")

    def plain(df):
        doubles = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
        return df.select(*doubles)

    assert gathers(order_mart(tables)) == 0
    # every lookup is joined by a shuffle
    monkeypatch.setattr(joins.Lookup, "is_small", lambda self, limit_bytes=0: False)
    found = order_mart(tables)
    assert gathers(found) == 1
    one, two = plain(found), plain(mart)
    assert one.exceptAll(two).count() + two.exceptAll(one).count() == 0
    # items without an order meet none, so they don't gather in one task
    null_key = found.select("total_price")._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(l_orderkey" in null_key


def test_ties_of_rates_go_to_the_smallest_value(spark, mart):
    from ontide.plans.reports import key_findings

    tied = mart.withColumns(
        {
            "is_late": F.lit(1),
            "customer_state": F.when(F.col("order_id") % 2 == 0, "b").otherwise("a"),
        }
    )
    assert key_findings(tied).first()["worst_customer_state"] == "a"
