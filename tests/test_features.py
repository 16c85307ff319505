import datetime as dt

import pytest
from pyspark.sql import functions as F

from ontide.contract import FINAL_FEATURE_COLUMNS
from ontide.operators import features as ft
from ontide.operators import split
from ontide.operators.correlation import correlation_matrix, correlation_with_target
from ontide.operators.profile import describe, matrix_validation, table_overview, top_values

DERIVED = """purchase_day_of_week string, customer_state string, main_seller_state string,
total_price double, total_freight double, item_count long,
order_purchase_timestamp timestamp_ntz, order_approved_at timestamp_ntz"""
START = dt.datetime(2020, 1, 1)


def derive(spark, **values):
    row = {
        "purchase_day_of_week": "Monday",
        "customer_state": "SP",
        "main_seller_state": "SP",
        "total_price": 9.0,
        "total_freight": 1.0,
        "item_count": 2,
        "order_purchase_timestamp": START,
        "order_approved_at": START + dt.timedelta(hours=3),
        **values,
    }
    df = spark.createDataFrame([tuple(row.values())], DERIVED)
    return ft.build_derived_features(df).first()


def test_derived_features(spark):
    row = derive(spark)
    assert (row.is_weekend, row.cross_state) == (0, 0)
    assert (row.price_per_item, row.freight_ratio, row.approval_time_hours) == (4.5, 0.1, 3.0)


def test_derived_features_with_nulls(spark):
    row = derive(
        spark,
        purchase_day_of_week=None,
        customer_state=None,
        total_price=None,
        item_count=None,
        order_approved_at=None,
    )
    assert (row.is_weekend, row.cross_state) == (0, 0)
    assert (row.price_per_item, row.freight_ratio, row.approval_time_hours) == (None, None, None)


def test_derived_features_at_their_limits(spark):
    row = derive(
        spark,
        purchase_day_of_week="Sunday",
        main_seller_state="RJ",
        total_price=0.0,
        total_freight=50.0,
        item_count=0,
        order_approved_at=START - dt.timedelta(hours=1),
    )
    assert (row.is_weekend, row.cross_state) == (1, 1)
    assert (row.price_per_item, row.freight_ratio, row.approval_time_hours) == (0.0, 10.0, 0.0)
    assert derive(spark, order_approved_at=START + dt.timedelta(days=90)).approval_time_hours == 720.0


def test_derived_features_without_inputs(spark):
    row = ft.build_derived_features(spark.range(1)).first()
    assert (row.is_weekend, row.cross_state, row.price_per_item) == (0, 0, None)
    text = spark.createDataFrame(
        [("2020-01-01 00:00:00", "soon")], "order_purchase_timestamp string, order_approved_at string"
    )
    assert ft.build_derived_features(text).first().approval_time_hours is None


def test_fill_values_are_median_and_mode(spark):
    df = spark.createDataFrame(
        [(1, 5, "b", "x"), (2, 5, "a", "x"), (None, 5, None, "x"), (4, 5, "a", "x")],
        "n int, full int, t string, u string",
    )
    numeric, text = ft.fit_fill_values(df)
    assert (numeric, text) == ({"n": 2.0}, {"t": "a"})
    filled = ft.apply_fill_values(df, {**numeric, "absent": 1.0}, text)
    assert filled.filter("n IS NULL OR t IS NULL").count() == 0


def test_labels_sort_by_code_point_and_unseen_counts_as_missing(spark):
    train = spark.createDataFrame([("b",), ("a",), ("B",)], "customer_state string")
    labels = ft.fit_labels(train, ["customer_state"])
    assert labels == {"customer_state": ["B", "a", "b"]}
    rows = spark.createDataFrame([("a",), ("zz",), (None,)], "customer_state string")
    codes = [r.customer_state_encoded for r in ft.apply_labels(rows, labels).collect()]
    assert codes == [1, 3, 3]


def test_unseen_takes_the_code_of_a_learned_missing_label(spark):
    train = spark.createDataFrame([("b",), (None,), ("z",)], "customer_state string")
    labels = ft.fit_labels(train, ["customer_state"])
    assert labels == {"customer_state": ["b", "missing", "z"]}
    rows = spark.createDataFrame([("new",), (None,), ("z",)], "customer_state string")
    assert [r.customer_state_encoded for r in ft.apply_labels(rows, labels).collect()] == [1, 1, 2]


def test_feature_matrix_has_contract_order_and_no_nulls(spark, mart):
    fitted = ft.fit_preprocessor(mart)
    matrix = ft.feature_matrix(mart, fitted)
    assert matrix.columns == ["order_id", *FINAL_FEATURE_COLUMNS, "is_late"]
    check = matrix_validation(matrix, FINAL_FEATURE_COLUMNS).first()
    assert (check.columns_with_nulls, check.non_numeric_columns, check.features_absent) == (0, 0, 0)
    assert ft.absent_features(matrix) == []


def test_drop_set_reports_present_and_absent(spark, mart):
    report = ft.drop_report(mart)
    assert "order_id" in report["present"] and report["absent"] == []
    left = ft.drop_non_features(mart).columns
    assert not set(left) & set(ft.drop_set())
    assert len(ft.drop_set()) == len(set(ft.drop_set()))


def test_stratified_split_is_exact_and_repeatable(spark):
    df = spark.range(0, 1000, 1, 7).select(
        F.col("id").alias("order_id"), (F.col("id") % 10 == 0).cast("int").alias("is_late")
    )
    parts = split.stratified_split(df, test_share=0.2)
    counts = {(r.split, r.is_late): r["count"] for r in parts.groupBy("split", "is_late").count().collect()}
    assert counts == {("train", 0): 720, ("test", 0): 180, ("train", 1): 80, ("test", 1): 20}
    again = split.stratified_split(df.repartition(3), test_share=0.2)
    assert again.exceptAll(parts).count() == 0
    balance = split.split_balance(parts).first()
    assert balance.balanced and balance.rate_difference == 0
    folds = split.stratified_folds(df, 3).groupBy("fold", "is_late").count().collect()
    assert sorted(r["count"] for r in folds if r.is_late == 1) == [33, 33, 34]
    assert {r.fold for r in folds} == {0, 1, 2}


def test_class_weight(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "is_late int")
    assert split.class_weight(df).first().scale_pos_weight == 3.0
    with pytest.raises(Exception, match="no positive"):
        split.class_weight(df.filter("is_late = 0")).collect()


def test_correlation_with_constants_and_pairwise_nulls(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 5.0, None), (2.0, 4.0, 5.0, 1.0), (3.0, None, 5.0, None), (4.0, 9.0, 5.0, None)],
        "is_late double, a double, c double, n double",
    )
    cells = {(r.feature_a, r.feature_b): r.correlation for r in correlation_matrix(df, ["is_late", "a", "c", "n"]).collect()}
    assert len(cells) == 16
    expected = df.toPandas()[["is_late", "a"]].dropna().corr().iloc[0, 1]
    assert abs(cells["a", "is_late"] - expected) < 1e-12
    assert cells["a", "is_late"] == cells["is_late", "a"]
    assert abs(cells["a", "a"] - 1) < 1e-12
    assert cells["c", "a"] is None and cells["n", "is_late"] is None
    ranked = correlation_with_target(df, ["is_late", "a", "c"]).collect()
    assert [r.feature for r in ranked] == ["a", "c"]


def test_describe_and_top_values(spark):
    df = spark.createDataFrame(
        [("x", 1, START), ("y", 2, START), ("y", 3, None), (None, None, None)],
        "t string, n int, at timestamp_ntz",
    )
    rows = {r.column_name: r for r in describe(df).collect()}
    assert (rows["t"].value_count, rows["t"].unique_values, rows["t"].top, rows["t"].freq) == (3, 2, "y", 2)
    assert (rows["n"].mean, rows["n"].p50, rows["n"].p25, rows["n"].std) == (2.0, 2.0, 1.5, 1.0)
    assert (rows["at"].time_mean, rows["at"].time_max, rows["at"].mean) == (START, START, None)
    tied = spark.createDataFrame([("b",), ("a",)], "t string")
    assert top_values(tied, ["t"]).first().top == "a"


def test_duplicate_rows_count_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert table_overview({"t": df}).first().duplicate_rows == 1


def test_correlations_compute_their_table_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(value):
        seen.add(1)
        return value * value

    rows = spark.range(40).select("id", counted(F.col("id").cast("double")).alias("a"), (F.col("id") % 2).alias("late"))
    found = {r.feature_b: r.correlation for r in correlation_matrix(rows, ["a", "late"]).collect() if r.feature_a == "a"}
    assert seen.value == 40
    assert abs(found["a"] - 1) < 1e-12 and -1 < found["late"] < 1


SOURCES = {
    "region": "SELECT CAST(id AS INT) r_regionkey, concat('R', id) r_name FROM range(2)",
    "nation": "SELECT CAST(id AS INT) n_nationkey, concat('N', id) n_name, CAST(id % 2 AS INT) n_regionkey FROM range(4)",
    "customer": "SELECT id c_custkey, CAST(id % 4 AS INT) c_nationkey FROM range(10)",
    "supplier": "SELECT id s_suppkey, CAST(id % 4 AS INT) s_nationkey FROM range(5)",
    "part": "SELECT id p_partkey, concat('T', id % 3) p_type, CAST(id % 50 AS INT) p_size FROM range(60)",
    "orders": """SELECT id o_orderkey, id % 10 o_custkey, 'F' o_orderstatus,
        TIMESTAMP_NTZ '1995-01-01 00:00:00' + make_dt_interval(CAST(id AS INT)) o_orderdate,
        '1-URGENT' o_orderpriority, CAST(100 + id AS DOUBLE) o_totalprice FROM range(300)""",
    "lineitem": """SELECT id % 300 l_orderkey, CAST(1 + id DIV 300 AS INT) l_linenumber, id % 60 l_partkey, id % 5 l_suppkey,
        CAST(10 + id % 7 AS DOUBLE) l_extendedprice, CAST(1 + id % 9 AS DOUBLE) l_quantity, 0.05D l_discount
        FROM range(600)""",
}


def _staged_columns(spark, monkeypatch, folder, name):
    from ontide.plans import registry

    staged = []

    def stage(df):
        staged.append(df.columns)
        return registry_stage(df)

    registry_stage = registry.stage
    monkeypatch.setattr(registry, "stage", stage)
    for table, text in SOURCES.items():
        spark.sql(text).write.parquet(f"{folder}/{table}.parquet")
    shown = registry.QUERIES[name](spark, str(folder))
    return staged, shown


@pytest.mark.parametrize("name", ["score_inputs_known", "imputed_mart"])
def test_queries_stage_only_what_they_show(spark, monkeypatch, tmp_path, name):
    staged, shown = _staged_columns(spark, monkeypatch, tmp_path, name)
    assert len(staged) == 1
    assert not {"customer_city", "main_seller_city", "review_count", "delivery_days_actual"} & set(staged[0])
    assert shown.count() > 0


@pytest.mark.parametrize("name", ["score_inputs", "score_inputs_known"])
def test_numeric_inputs_need_no_hidden_category(spark, monkeypatch, tmp_path, name):
    staged, shown = _staged_columns(spark, monkeypatch, tmp_path, name)
    assert len(staged) == 1
    assert not {"main_product_category", "main_payment_type", "customer_city"} & set(staged[0])
    assert {"main_seller_state", "customer_state", "purchase_day_of_week"} <= set(staged[0])
    assert shown.count() > 0
