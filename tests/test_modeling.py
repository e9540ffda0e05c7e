"""Two-stage model: determinism, save/load, output invariants (small tree counts)."""

from __future__ import annotations

import inspect
import os

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import features as fe
from shelfcast.operators.dataset import feature_columns, time_split
from shelfcast.operators.modeling import TwoStageConfig, predict_two_stage, train_two_stage
from shelfcast.operators.scoring import forecast_latest, train_request_model
from shelfcast.sources import fixtures
from shelfcast.sources.model_store import load_bundle, save_bundle
from tests.conftest import SF_CHECK, SF_SMALL

CFG = TwoStageConfig(classifier_iters=3, regressor_iters=4, forest_trees=4, regressor_a_depth=4,
                     regressor_b_depth=3, forest_depth=4)


def test_defaults_are_the_reference_sizes():
    cfg = TwoStageConfig()
    assert (cfg.classifier_iters, cfg.classifier_step) == (300, 0.05)
    assert (cfg.regressor_iters, cfg.regressor_step, cfg.regressor_a_depth, cfg.regressor_b_depth) == (1000, 0.03, 8, 6)
    assert (cfg.forest_trees, cfg.forest_depth) == (100, 10)
    request = {k: p.default for k, p in inspect.signature(train_request_model).parameters.items()}
    assert (request["iters"], request["depth"], request["step"]) == (1000, 8, 0.03)


@pytest.fixture(scope="module")
def weekly(spark):
    feats = fe.build_features(fixtures.transactions(spark, SF_SMALL), fe.WEEKLY, narrow=False, fill=True)
    return feats.cache()


@pytest.fixture(scope="module")
def fitted(weekly):
    train, test = time_split(weekly, "week_ending", "1996-01-01", "2001-01-01", "2002-01-01")
    cols = feature_columns(weekly)
    return train_two_stage(train, cols, CFG, date_column="week_ending"), train, test


def test_feature_choice(weekly):
    cols = feature_columns(weekly)
    assert "total_amount" not in cols and "quantity" not in cols and "is_filled" not in cols
    assert "lag_1_week" in cols and "product_id" not in cols
    assert "total_amount" in feature_columns(weekly, include_same_period=True)


def test_split_disjoint(fitted):
    _, train, test = fitted
    assert train.agg(F.max("week_ending")).first()[0] < test.agg(F.min("week_ending")).first()[0]


def test_predictions_whole_and_non_negative(fitted):
    model, _, test = fitted
    pred = predict_two_stage(model, test)
    bad = pred.filter((F.col("predicted_quantity") < 0) | F.col("predicted_quantity").isNull()).count()
    assert bad == 0
    assert dict(pred.dtypes)["predicted_quantity"] == "int"
    # Gated: a no-demand class always predicts 0.
    assert pred.filter((F.col("demand_class") == 0) & (F.col("predicted_quantity") != 0)).count() == 0


def test_deterministic_and_save_load(spark, fitted, weekly, tmp_dir):
    model, train, test = fitted
    again = train_two_stage(train, model.feature_columns, CFG, date_column="week_ending")
    a = predict_two_stage(model, test).select("product_id", "week_ending", "predicted_quantity")
    b = predict_two_stage(again, test).select("product_id", "week_ending", "predicted_quantity")
    assert a.exceptAll(b).count() == 0
    path = os.path.join(tmp_dir, "bundle")
    save_bundle(spark, {"weekly": model}, path, weights={"xgb": 0.45, "lgbm": 0.45, "rf": 0.10})
    loaded = load_bundle(spark, path, "weekly")
    assert loaded.regressors == ["xgb_regressor", "lgbm_regressor", "rf_regressor"]
    c = predict_two_stage(loaded, test).select("product_id", "week_ending", "predicted_quantity")
    assert a.exceptAll(c).count() == 0
    scored = forecast_latest(loaded, weekly, fe.WEEKLY)
    assert scored.count() == weekly.select("product_id").distinct().count()
    assert scored.filter(F.col("predicted_demand") < 0).count() == 0


def test_beats_mean_predictor(spark, fitted):
    """On gap-filled series the model has a lower MAE than predicting the train mean."""
    from shelfcast.operators.evaluation import metric_pack

    model, train, test = fitted
    mean_q = train.agg(F.avg("quantity")).first()[0]
    pred = predict_two_stage(model, test).select(
        F.col("quantity").cast("double").alias("actual_quantity"), "predicted_quantity"
    )
    base = test.select(F.col("quantity").cast("double").alias("actual_quantity"),
                       F.lit(round(mean_q)).alias("predicted_quantity"))
    assert metric_pack(pred).first().mae < metric_pack(base).first().mae


def test_bare_model_gets_full_weight(spark, tmp_dir):
    from shelfcast.operators.scoring import train_request_model

    # The smallest tables have no product sold both 7 and 14 days before a sale.
    daily = fe.daily_features(fixtures.transactions(spark, SF_CHECK))
    model = train_request_model(daily, iters=2, depth=2)
    path = os.path.join(tmp_dir, "bare")
    model.write().overwrite().save(path)
    loaded = load_bundle(spark, path, "weekly")
    assert loaded.weights == {"model": 1.0} and loaded.regressors == ["model"]
    assert loaded.feature_columns == ["lag_7", "lag_14", "day_of_week", "month"]
    table = daily.withColumnRenamed("sale_date", "week_ending").limit(50)
    scored = forecast_latest(loaded, table, fe.WEEKLY)
    assert scored.count() == table.select("product_id").distinct().count()
    assert scored.filter(F.col("predicted_demand").isNull()).count() == 0


def test_foreign_classifier_names_take_no_part_in_the_blend(spark, fitted, weekly, tmp_dir):
    from dataclasses import replace

    model, *_ = fitted
    for k, name in enumerate(("clf", "class_model", "DemandClassifier")):
        members = {name: model.members["classifier"], "xgb_one": model.members["xgb_regressor"], "rf_one": model.members["rf_regressor"]}
        path = os.path.join(tmp_dir, f"foreign{k}")
        save_bundle(spark, {"weekly": replace(model, members=members)}, path, weights={"xgb": 3, "rf": 1})
        loaded = load_bundle(spark, path, "weekly")
        assert loaded.regressors == ["xgb_one", "rf_one"] and loaded.classifier is not None
        assert loaded.weights == {"xgb_one": 0.75, "rf_one": 0.25}
        assert forecast_latest(loaded, weekly, fe.WEEKLY).filter(F.col("demand_class").isNull()).count() == 0


def test_undeclared_features_are_taken_from_the_table(spark, fitted, weekly):
    from shelfcast.sources.contract import undeclared_features

    names = undeclared_features(weekly.columns, but=("week_ending",))
    assert "quantity" not in names and "product_id" not in names and "week_ending" not in names
    assert {"lag_1_week", "selling_price"} <= set(names)
    from dataclasses import replace

    class Flat:  # a member without declared inputs: any frame will do
        stages = ()

        def transform(self, df):
            return df.withColumn("score_any", F.lit(3.4))

    model = replace(fitted[0], members={"any": Flat()}, feature_columns=[], weights={"any": 1.0})
    assert {r.predicted_demand for r in forecast_latest(model, weekly, fe.WEEKLY).collect()} == {3}


def test_rounds_used_are_known_and_saved(spark, fitted, tmp_dir):
    from shelfcast.sources.model_store import read_metadata

    model, *_ = fitted
    assert set(model.rounds) == set(model.members)
    assert 1 <= model.rounds["classifier"] <= CFG.classifier_iters and 1 <= model.rounds["xgb_regressor"] <= CFG.regressor_iters
    path = os.path.join(tmp_dir, "rounds")
    save_bundle(spark, {"weekly": model}, path)
    assert read_metadata(spark, path)["horizons"]["weekly"]["rounds"] == model.rounds
    assert load_bundle(spark, path, "weekly").rounds == model.rounds


def test_a_save_that_stops_half_way_changes_nothing(spark, fitted, tmp_dir):
    from dataclasses import replace

    from shelfcast.sources.model_store import read_metadata

    model, *_ = fitted
    path = os.path.join(tmp_dir, "versions")
    first = save_bundle(spark, {"weekly": model}, path, note="first")

    class Broken:
        def write(self):
            raise RuntimeError("executor lost")

    half = replace(model, members={"classifier": model.members["classifier"], "xgb_regressor": Broken()})
    with pytest.raises(RuntimeError, match="lost"):
        save_bundle(spark, {"weekly": half}, path, note="second")
    assert len(os.listdir(f"{path}/versions")) == 2  # the members written are there, and nobody reads them
    assert read_metadata(spark, path)["version"] == first and read_metadata(spark, path)["note"] == "first"
    assert list(load_bundle(spark, path, "weekly").members) == list(model.members)
    third = save_bundle(spark, {"weekly": replace(model, members={k: model.members[k] for k in ("classifier", "rf_regressor")})}, path, note="third")
    assert read_metadata(spark, path)["version"] == third
    assert load_bundle(spark, path, "weekly").regressors == ["rf_regressor"]


def test_inputs_come_from_nested_assemblers(spark):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from shelfcast.operators.modeling import model_inputs
    from shelfcast.operators.scoring import score_requests_with_model

    rows = spark.createDataFrame([(float(k), float(k % 3), 2.0 * k + 1, f"i{k}", True) for k in range(20)], "b double, a double, label double, item_id string, is_valid boolean")
    inner = Pipeline(stages=[VectorAssembler(inputCols=["b"], outputCol="v"), StandardScaler(inputCol="v", outputCol="scaled")])
    both = VectorAssembler(inputCols=["scaled", "a"], outputCol="features")
    model = Pipeline(stages=[inner, both, LinearRegression(predictionCol="predicted_quantity")]).fit(rows)
    assert isinstance(model.stages[0], PipelineModel) and model_inputs(model) == ["b", "a"]
    scored = score_requests_with_model(model, rows, keep=("item_id",))
    assert abs(scored.where("item_id = 'i7'").first().predicted_quantity - 15) < 1e-3
    with pytest.raises(KeyError, match="features a"):
        score_requests_with_model(model, rows.drop("a"), keep=("item_id",))


def test_forecast_job_serves_the_saved_bundle(spark, fitted, weekly, tmp_dir, capsys):
    from shelfcast.plans.forecast import main

    model, *_ = fitted
    save_bundle(spark, {"weekly": model, "monthly": model}, f"{tmp_dir}/models")
    monthly = weekly.where("dayofmonth(week_ending) <= 7").withColumn("month_start", F.trunc("week_ending", "month"))
    weekly.withColumnRenamed("product_id", "SKU").write.parquet(f"{tmp_dir}/features/weekly")  # a table written elsewhere
    monthly.write.parquet(f"{tmp_dir}/features/monthly")
    known = weekly.select("product_id").first()[0]
    asked = [(1, known, "weekly"), (2, f" {known}", "MONTHLY"), (3, "absent", "weekly"), (4, known, "daily")]
    spark.createDataFrame(asked, "request_id int, product_id string, timeframe string").write.parquet(f"{tmp_dir}/requests")
    main(["--models", f"{tmp_dir}/models", "--features", f"{tmp_dir}/features", "--requests", f"{tmp_dir}/requests", "--output", f"{tmp_dir}/out/"])
    forecasts = spark.read.parquet(f"{tmp_dir}/out/forecasts")
    products = weekly.select("product_id").distinct().count()
    assert forecasts.where("timeframe = 'weekly'").count() == products
    assert '"answers": 4' in capsys.readouterr().out
    answers = {r.request_id: r for r in spark.read.parquet(f"{tmp_dir}/out/answers").collect()}
    want = {r.timeframe: r.predicted_demand for r in forecasts.where(F.col("product_id") == known).collect()}
    assert answers[1].predicted_demand == want["weekly"] and answers[2].predicted_demand == want["monthly"]
    assert [answers[k].status for k in (3, 4)] == ["not_found", "bad_timeframe"]


def test_no_sale_to_learn_from(weekly):
    with pytest.raises(ValueError, match="no sale"):
        train_two_stage(weekly.withColumn("quantity", F.lit(0)), feature_columns(weekly), CFG)


def test_requests_meet_forecasts_after_save_and_load(spark, fitted, weekly, tmp_dir):
    from shelfcast.operators.scoring import forecast_requests

    model, *_ = fitted
    path = os.path.join(tmp_dir, "served")
    save_bundle(spark, {"weekly": model}, path)
    padded = weekly.withColumn("product_id", F.concat(F.lit("  "), "product_id"))
    forecasts = forecast_latest(load_bundle(spark, path, "weekly"), padded, fe.WEEKLY)
    known = weekly.select("product_id").first()[0]
    rows = [(1, f" {known} ", "Weekly"), (2, known, "monthly"), (3, "absent", "weekly"), (4, "", "weekly"), (5, known, "daily")]
    out = {r.request_id: r for r in forecast_requests(spark.createDataFrame(rows, "request_id int, product_id string, timeframe string"), forecasts).collect()}
    assert [out[k].status for k in range(1, 6)] == ["ok", "not_found", "not_found", "bad_product", "bad_timeframe"]
    assert out[1].predicted_demand >= 0 and out[2].predicted_demand is None
