"""End-to-end batch job on the smallest fixture tables, and the streaming ingest."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from shelfcast.operators.modeling import TwoStageConfig
from shelfcast.plans.pipeline import run_pipeline
from shelfcast.sources.model_store import load_bundle, read_metadata
from shelfcast.streaming.ingest import start_cleaning_stream
from tests.conftest import SF_SMALL

TINY = TwoStageConfig(classifier_iters=2, regressor_iters=2, forest_trees=2, regressor_a_depth=3,
                      regressor_b_depth=3, forest_depth=3)


def test_pipeline_end_to_end(spark, tmp_dir):
    out = os.path.join(tmp_dir, "run")
    summary = run_pipeline(spark, out, sf_dir=SF_SMALL, train_start="1996-01-01", test_start="2001-01-01",
                           test_end="2002-01-01", config=TINY, fill_gaps=True)
    assert summary["cleaned_rows"] == spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
    assert {r["horizon"] for r in summary["accuracy"]} == {"Weekly", "Monthly"}
    weekly = spark.read.parquet(f"{out}/features/weekly")
    assert weekly.count() == summary["weekly_rows"]
    assert dict(weekly.dtypes)["quantity"] == "float"
    assert spark.read.parquet(f"{out}/exploration/weekday_hour_matrix").count() == 7
    meta = read_metadata(spark, f"{out}/models")
    assert meta["weights"] == {"xgb": 0.45, "lgbm": 0.45, "rf": 0.1}
    assert meta["horizons"]["monthly"]["date_column"] == "month_start"
    model = load_bundle(spark, f"{out}/models", "monthly")
    assert model.classifier is not None and len(model.regressors) == 3
    preds = spark.read.parquet(f"{out}/predictions/weekly")
    assert preds.filter(F.col("predicted_quantity") < 0).count() == 0
    # Gap filling gave the classifier zero-demand rows to learn from.
    assert spark.read.parquet(f"{out}/features/weekly").filter(F.col("quantity") == 0).count() > 0


HEADER = ["TransactionID", "Date", "Time", "ProductID", "ProductName", "Category", "UnitPrice", "BuyingPrice",
          "SellingPrice", "Quantity", "Total_LKR"]


def test_job_reports_rejects_and_takes_formats(spark, tmp_dir):
    from pyspark.sql import Observation

    from shelfcast.plans.pipeline import ingest
    from shelfcast.sources.sinks import write_cleaned

    path = os.path.join(tmp_dir, "us.csv")
    rows = [["1", "1/5/2025", "10:30", "P", "n", "c", "10", "5", "12", "1", "12"],
            ["2", "2025-01-06", "10:30", "P", "n", "c", "10", "5", "x", "1", "12"],
            ["3", "1/7/2025", "9.15", "P", "n", "c", "1e100", "5", "12", "1", "12"]]
    with open(path, "w") as f:
        f.write("\n".join(",".join(r) for r in [HEADER, *rows]))
    seen = Observation("rejects")
    cleaned = ingest(spark, path, None, date_formats=("M/d/yyyy",), time_formats=("H:mm", "H.mm"), rejects=seen)
    assert write_cleaned(cleaned, os.path.join(tmp_dir, "cleaned")) == 1
    assert {k: v for k, v in seen.get.items() if v} == {"sale_date": 1, "selling_price": 1, "unit_price": 1}


def test_cleaned_files_in_total_order(spark, tmp_dir):
    from shelfcast.sources import fixtures
    from shelfcast.sources.sinks import write_cleaned

    path = os.path.join(tmp_dir, "ordered")
    tx = fixtures.transactions(spark, SF_SMALL)
    assert write_cleaned(tx, path, total_order=True) == tx.count()
    ends = spark.read.parquet(path).groupBy("sale_year", F.input_file_name()).agg(F.min("sale_date").alias("lo"), F.max("sale_date").alias("hi"))
    spans = sorted((r.lo, r.hi) for r in ends.collect())
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_streaming_ingest(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    for i, rows in enumerate([["1,2025-01-05,9:05,P1,Tea,Bev,25,35,45,2,90", "2,bad,9:05,P1,Tea,Bev,25,35,45,2,90"],
                              ["3,2024-12-31,23:00:00,P2,Rice,Food,10,10,10,1,10"]]):
        with open(os.path.join(src, f"part{i}.csv"), "w") as f:
            f.write(",".join(HEADER) + "\n" + "\n".join(rows) + "\n")
    target = os.path.join(tmp_dir, "cleaned")
    q = start_cleaning_stream(spark, src, HEADER, target, checkpoint=os.path.join(tmp_dir, "ckpt"),
                              available_now=True)
    q.awaitTermination(120)
    out = spark.read.parquet(target)
    assert sorted(r.txn_id for r in out.collect()) == ["1", "3"]
    assert sorted(r.sale_year for r in out.select("sale_year").collect()) == [2024, 2025]
    assert out.filter(F.col("txn_id") == "1").first().unit_price == 20
