"""Training, scoring, saved models and streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ontide.operators import rates, scoring, train
from ontide.operators.features import Preprocessor, feature_matrix
from ontide.operators.mart import delivered_orders, with_durations
from ontide.plans import reports
from ontide.plans.reports import findings_text, key_findings, run_reports
from ontide.sources.sinks import load_json, save_json, save_stage
from ontide.streaming import jobs

PARAMS = train.BoostingParams(rounds=6, max_depth=3, learning_rate=0.2)


@pytest.fixture(scope="module")
def run(mart):
    return train.train_risk_model(mart, PARAMS, draws=1, folds=2)


def test_training_learns_the_planted_signal(run):
    assert run.default_row["auc_roc"] > 0.5
    assert 0 < run.model.threshold < 1
    assert run.optimal_row["tp"] + run.optimal_row["fn"] == run.default_row["tp"] + run.default_row["fn"]
    assert 1 <= run.best_rounds <= PARAMS.rounds


def test_draws_are_distinct_and_seeded():
    drawn = train.draw_params(PARAMS, 5)
    assert len(set(drawn)) == 5 and drawn == train.draw_params(PARAMS, 5)
    assert all(p.max_depth in train.SEARCH_SPACE["max_depth"] for p in drawn)


def test_metrics_document_round_trip(spark, run, tmp_path):
    document = train.metrics_document(spark, run)
    save_json(document, str(tmp_path / "m"))
    stored = load_json(spark, str(tmp_path / "m"), train.METRICS_SCHEMA)
    assert stored.first() == document.first()
    row = document.first()
    assert row.n_features == 26 and row.n_train + row.n_test == run.train.count() + run.test.count()
    assert scoring.kpi_row(document).first().training_orders == row.n_train
    assert scoring.threshold_comparison(document).count() == 8
    assert train.model_deltas(spark, run).count() == 3


def test_feature_importance_lists_every_feature_once(spark, run):
    rows = train.feature_importance(spark, run.model.trees, run.model.preprocessor.features, 26).collect()
    assert len(rows) == 26
    gains = [r.importance for r in rows]
    assert gains == sorted(gains, reverse=True) and abs(sum(gains) - 1) < 1e-9


def test_saved_model_gives_equal_scores(spark, run, mart, tmp_path):
    profiles = scoring.order_profiles(mart)
    run.model.save(spark, str(tmp_path / "model"))
    loaded = train.RiskModel.load(spark, str(tmp_path / "model"))
    assert loaded.threshold == run.model.threshold
    before = scoring.score_orders(profiles, run.model).select("order_id", "score", "action")
    after = scoring.score_orders(profiles, loaded).select("order_id", "score", "action")
    assert before.exceptAll(after).count() == 0
    assert before.count() == mart.count()


def test_stream_scores_equal_table_scores(spark, run, mart, tmp_path):
    profiles = save_stage(scoring.order_profiles(mart), str(tmp_path / "in"))
    columns = ["order_id", "score", "verdict", "action"]
    arriving = jobs.read_order_stream(spark, str(tmp_path / "in"), profiles.schema, files_per_batch=1)
    stream = jobs.score_stream(arriving, run.model).select(*columns)
    jobs.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    expected = scoring.score_orders(profiles, run.model).select(*columns)
    assert found.exceptAll(expected).count() == 0 and found.count() == expected.count()


@pytest.mark.parametrize("files_per_batch", [1, 3, 1000])
def test_replayed_windows_hold_every_order(spark, tables, tmp_path, files_per_batch):
    orders = save_stage(tables["orders"].repartition(6, F.rand(1)), str(tmp_path / "in"))
    arriving = jobs.read_order_stream(
        spark, str(tmp_path / "in"), orders.schema, files_per_batch=files_per_batch
    )
    windows = jobs.late_windows(arriving, "60 days")
    jobs.write_totals(windows, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, jobs.late_windows(orders, "60 days").collect()))
    kept = with_durations(delivered_orders(orders)).count()
    assert found.agg(F.sum("orders")).first()[0] == kept


def test_live_windows_close_in_order_of_time(spark, tables, tmp_path):
    orders = save_stage(tables["orders"].orderBy("order_purchase_timestamp"), str(tmp_path / "in"))
    arriving = jobs.read_order_stream(spark, str(tmp_path / "in"), orders.schema)
    windows = jobs.late_windows(arriving, "60 days", "60 days")
    jobs.write_stream(windows, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).select("window_start", "orders", "late_orders")
    every = jobs.late_windows(orders, "60 days").select("window_start", "orders", "late_orders")
    assert found.count() > 20 and found.exceptAll(every).isEmpty()


def test_known_orders_score_as_the_matrix_does(run, mart):
    known = scoring.score_orders(scoring.known_orders(mart), run.model).select("order_id", "score")
    matrix = feature_matrix(mart, run.model.preprocessor)
    features = run.model.preprocessor.features
    expected = train.score_matrix(matrix, features, run.model.trees, ["order_id"])
    pairs = known.join(expected.withColumnRenamed("score", "wanted"), "order_id")
    assert pairs.count() == mart.count()
    assert pairs.filter(F.abs(F.col("score") - F.col("wanted")) > 1e-12).isEmpty()


def test_bare_profile_counts_one_of_each(spark):
    fitted = Preprocessor({"product_count": 4.0, "avg_product_width_cm": 7.0}, {}, {}, ["product_count", "avg_product_width_cm"])
    row = scoring.scoring_inputs(spark.createDataFrame([CALM], PROFILE), fitted).first()
    assert row["product_count"] == 1.0 and row["avg_product_width_cm"] == 7.0


PROFILE = (
    "order_id long, delivery_days_estimated double, total_price double, total_freight double, "
    "item_count long, avg_product_weight_g double, main_seller_state string, customer_state string, "
    "main_product_category string, main_payment_type string, installments int, "
    "purchase_day_of_week string, purchase_month_num int, purchase_hour int"
)
CALM = (1, 18.0, 99.0, 28.0, 1, 2500.0, "SP", "SP", "toys", "boleto", 6, "Monday", 5, 9)
FITTED = Preprocessor({"avg_product_weight_g": 1000.0}, {}, {})


def factors(spark, **changes):
    names = [part.split()[0] for part in PROFILE.split(", ")]
    row = tuple(changes.get(name, value) for name, value in zip(names, CALM))
    return scoring.risk_factors(spark.createDataFrame([row], PROFILE), FITTED).first().risk_factors


def test_risk_rules_at_and_above_their_limits(spark):
    assert factors(spark) == []
    assert factors(spark, delivery_days_estimated=18.01) == ["long_promised_window"]
    assert factors(spark, customer_state="RJ") == ["cross_state_shipment"]
    assert factors(spark, total_freight=28.1) == ["high_freight_ratio"]
    assert factors(spark, purchase_day_of_week="Friday") == ["weekend_order"]
    assert factors(spark, avg_product_weight_g=2500.1) == ["heavy_product"]
    assert factors(spark, installments=7) == ["many_installments"]
    assert factors(spark, total_price=None, customer_state=None, avg_product_weight_g=None) == []


def test_default_weight_limit(spark):
    row = spark.createDataFrame([CALM], PROFILE).withColumn("avg_product_weight_g", F.lit(5000.1))
    assert scoring.risk_factors(row, Preprocessor()).first().risk_factors == ["heavy_product"]


def test_explanations_name_the_values(spark):
    row = spark.createDataFrame([CALM], PROFILE).withColumns(
        {"customer_state": F.lit("RJ"), "installments": F.lit(9), "total_freight": F.lit(50.0)}
    )
    lines = {r.factor: r.explanation for r in scoring.describe_factors(scoring.risk_factors(row, FITTED)).collect()}
    assert lines == {
        "cross_state_shipment": "ships from SP to RJ",
        "high_freight_ratio": "freight is 0.50 of the price",
        "many_installments": "9 installments",
    }


def test_action_tiers_and_bands(spark):
    scores = [0.1, 0.25, 0.3, 0.55, 0.6, 0.72, 0.9]
    df = spark.createDataFrame([(s,) for s in scores], "score double")
    rows = scoring.with_decisions(df, 0.6).orderBy("score").collect()
    assert [r.action for r in rows] == [
        "standard", "watch", "watch", "watch", "monitor", "escalate", "escalate",
    ]
    assert [r.risk_band for r in rows] == ["low", "low", "medium", "high", "high", "high", "high"]
    assert [r.verdict for r in rows][3:5] == ["LOW RISK", "HIGH RISK"]
    strict = scoring.with_decisions(df, 0.8).orderBy("score").collect()
    assert strict[5].action == "escalate" and strict[5].verdict == "LOW RISK"


def test_scoring_inputs_fill_absent_attributes(spark):
    from ontide.contract import FINAL_FEATURE_COLUMNS

    profile = spark.createDataFrame([CALM], PROFILE)
    fitted = Preprocessor({"avg_product_length_cm": 25.0}, {}, {})
    row = scoring.scoring_inputs(profile, fitted).first()
    assert (row.avg_product_length_cm, row.avg_product_height_cm, row.product_count) == (25.0, 15.0, 1.0)
    assert (row.approval_time_hours, row.total_payment_value, row.price_per_item) == (2.0, 127.0, 99.0)
    plain = [c for c in FINAL_FEATURE_COLUMNS if not c.endswith("_encoded")]
    assert all(row[c] is not None for c in plain)


def test_grouping_sets_equal_single_reports(mart):
    together = rates.late_rate_all(mart)
    for dimension in rates.RATE_DIMENSIONS:
        single = rates.late_rate_by(mart, dimension).select(
            F.col(dimension).alias("value"), "orders", "late_orders"
        )
        part = together.filter(F.col("dimension") == dimension).select("value", "orders", "late_orders")
        assert single.exceptAll(part).count() == 0 and part.count() == single.count()


def test_unknown_states_leave_the_map(spark, mart):
    centres = rates.state_centres(spark, {"ASIA": (34.0, 100.0)})
    assert [r.state for r in rates.state_map(mart, centres).collect()] == ["ASIA"]
    assert rates.state_centres(spark).count() == 27


def test_stage_scope_removes_what_it_staged(spark):
    from ontide import session

    def folders():
        top = f"{session.shared_dir(spark)}/ontide-stage/{spark.sparkContext.applicationId}"
        return set(os.listdir(top.removeprefix("file://")))

    session.stage(spark.range(1))
    before = folders()
    with session.stage_scope(spark):
        assert session.stage(spark.range(3)).count() == 3
        assert len(folders()) == len(before) + 1
    assert folders() == before


def test_model_run_stores_model_and_reports(spark, mart, tmp_path):
    run = reports.run_model(mart, str(tmp_path), params=PARAMS, draws=1, folds=2)
    stored = {p.name for p in (tmp_path / "reports").iterdir()}
    assert stored == {
        "feature_importance", "model_deltas", "threshold_analysis", "business_impact", "classification_report"
    }
    loaded = train.RiskModel.load(spark, str(tmp_path / "model"))
    assert loaded.threshold == run.model.threshold
    assert load_json(spark, str(tmp_path / "model_metrics"), train.METRICS_SCHEMA).count() == 1


def test_full_run_writes_every_report(spark, tables, tmp_path):
    mart, matrix, fitted = run_reports(tables, str(tmp_path))
    stored = {p.name for p in (tmp_path / "reports").iterdir()}
    extra = {"feature_report", "key_findings"}
    assert stored == {*reports.TABLE_REPORTS, *reports.MART_REPORTS, *reports.MATRIX_REPORTS, *extra}
    assert matrix.count() == mart.count()
    lines = [r.value for r in findings_text(key_findings(mart)).collect()]
    assert any(line.startswith("Worst customer state: ") for line in lines)
    json.dumps(fitted.labels)
