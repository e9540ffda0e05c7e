"""End-to-end batch job: clean -> explore -> features -> train -> evaluate -> save.

Stage boundaries are parquet tables on shared storage: the cleaned
transactions (partitioned by sale year), their product-day rollup and both
feature tables are written and read back, which cuts lineage (a lost executor recomputes from the last
table, not from the raw files) and lets the time split prune partitions.

Run with spark-submit::

    spark-submit -m shelfcast.plans.pipeline --input s3://.../pos/*.csv --output s3://.../run1

or on the driver's fixture tables with ``--sf-dir /root/testdata/sf0.1``.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shelfcast.operators import evaluation as ev
from shelfcast.operators import explore as ex
from shelfcast.operators import features as fe
from shelfcast.functions.temporal import DEFAULT_DATE_FORMATS, DEFAULT_TIME_FORMATS
from shelfcast.operators.cleaning import add_sold_at, coerce_raw, drop_incomplete, price_cleaning, reject_columns
from shelfcast.operators.dataset import (
    DEFAULT_TEST_END,
    DEFAULT_TEST_START,
    DEFAULT_TRAIN_START,
    feature_columns,
    time_split,
)
from shelfcast.operators.modeling import TwoStageConfig, predict_two_stage, prediction_table, train_two_stage
from shelfcast.session import use_checkpoint_dir
from shelfcast.sources import fixtures
from shelfcast.sources.contract import PRICE_COLUMNS, canonical_headers, strip_headers, to_our_names
from shelfcast.sources.model_store import save_bundle
from shelfcast.sources.readers import read_cleaned, read_features, read_pos_csv
from shelfcast.sources.sinks import write_cleaned, write_counted, write_features

# Tables that follow from the per-transaction-hour rollup ...
EXPLORATION_FROM_TXN_HOURS = {
    "basket_histogram": ex.basket_histogram,
    "hourly_transactions": ex.hourly_transactions,
    "weekday_hour_matrix": ex.weekday_hour_matrix,
}
# ... and tables that follow from the much smaller product-day rollup.
EXPLORATION_FROM_DAYS = {
    "monthly_price_trend": ex.monthly_price_trend,
    "daily_quantity": ex.daily_quantity,
    "top_products": ex.top_products,
    "monthly_revenue": ex.monthly_revenue,
    "category_revenue": ex.category_revenue,
}


def ingest(
    spark: SparkSession,
    input_path: str | None,
    sf_dir: str | None,
    input_format: str = "csv",
    date_formats: Sequence[str] = DEFAULT_DATE_FORMATS,
    time_formats: Sequence[str] = DEFAULT_TIME_FORMATS,
    rejects: Observation | None = None,
) -> DataFrame:
    """Cleaned rows of the input; ``rejects`` gets, from the same pass, how many rows fail to parse per column.
    (A later sort of the whole table would run that pass twice, for its ranges, and count twice.)"""
    if sf_dir:
        return fixtures.transactions(spark, sf_dir)
    if input_format == "csv":
        raw = read_pos_csv(spark, input_path)
    else:
        raw = to_our_names(canonical_headers(strip_headers(spark.read.format(input_format).load(input_path))))
        raw = raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns])
    coerced = coerce_raw(raw, date_formats, time_formats)
    if rejects is not None:
        coerced = coerced.observe(rejects, *[n.alias(c) for c, n in reject_columns(coerced).items()])
    return price_cleaning(add_sold_at(drop_incomplete(coerced))).dropna(subset=[*PRICE_COLUMNS, "quantity"])


def run_pipeline(
    spark: SparkSession,
    output: str,
    input_path: str | None = None,
    sf_dir: str | None = None,
    input_format: str = "csv",
    train_start: str = DEFAULT_TRAIN_START,
    test_start: str = DEFAULT_TEST_START,
    test_end: str = DEFAULT_TEST_END,
    config: TwoStageConfig = TwoStageConfig(),
    explore: bool = True,
    fill_gaps: bool = False,
    date_formats: Sequence[str] = DEFAULT_DATE_FORMATS,
    time_formats: Sequence[str] = DEFAULT_TIME_FORMATS,
) -> dict:
    """Run the whole job; ``fill_gaps=True`` adds zero-sale periods between a
    product's sales, which also gives the demand classifier its negative class.

    The summary lists, under ``rejects``, the rows that failed to parse per column
    (an input row may fail in several)."""
    use_checkpoint_dir(spark)
    out = output.rstrip("/")
    summary: dict = {}

    rejects = None if sf_dir else Observation("rejects")
    cleaned = ingest(spark, input_path, sf_dir, input_format, date_formats, time_formats, rejects)
    summary["cleaned_rows"] = write_cleaned(cleaned, f"{out}/cleaned")
    summary["rejects"] = dict(rejects.get) if rejects else {}
    if summary["cleaned_rows"] == 0:
        raise ValueError(f"every input row was rejected: {summary['rejects']}")
    tx = read_cleaned(spark, f"{out}/cleaned")

    # One pass over the line items: the product-day rollup feeds both feature grains
    # and five exploration tables; it is a table, so they reread it, not the raw rows.
    summary["product_days"] = write_features(fe.product_day_rollup(tx), f"{out}/product_days")
    days = spark.read.parquet(f"{out}/product_days")

    if explore:
        # Baskets and hours: one more pass, to a per-transaction-hour table; margins
        # need the per-row prices and take the third pass (column-pruned).
        write_features(ex.transaction_hour_rollup(tx), f"{out}/transaction_hours")
        txn_hours = spark.read.parquet(f"{out}/transaction_hours")
        for name, op in EXPLORATION_FROM_TXN_HOURS.items():
            write_features(op(txn_hours, rolled=True), f"{out}/exploration/{name}")
        for name, op in EXPLORATION_FROM_DAYS.items():
            extra = {"rolled": True} if op is ex.monthly_price_trend else {}
            write_features(op(days, **extra), f"{out}/exploration/{name}")
        write_features(ex.margin_histogram(tx), f"{out}/exploration/margin_histogram")

    frames = {}
    for grain in (fe.WEEKLY, fe.MONTHLY):
        path = f"{out}/features/{grain.name}"
        period = F.col(grain.period_col)
        split = {"train": period.between(train_start, test_start) & (period != F.lit(test_start).cast("date")),
                 "test": period.between(test_start, test_end) & (period != F.lit(test_end).cast("date"))}
        counts = write_counted(fe.build_features(days, grain, fill=fill_gaps, rolled=True), path, split)
        summary[f"{grain.name}_rows"], summary[f"{grain.name}_split"] = counts.pop("rows"), counts
        if summary[f"{grain.name}_rows"] == 0:
            raise ValueError(f"the {grain.name} feature table is empty: every product's history is too short")
        frames[grain.name] = read_features(spark, path, grain.period_col)

    models, predictions = {}, {}
    for grain in (fe.WEEKLY, fe.MONTHLY):
        feats = frames[grain.name]
        cols = feature_columns(feats)
        if not cols:
            raise ValueError(f"the {grain.name} feature table has no number to learn from")
        train, test = time_split(feats, grain.period_col, train_start, test_start, test_end)
        for name, n in summary[f"{grain.name}_split"].items():
            if not n:
                raise ValueError(f"no {grain.name} {name} row between {train_start}, {test_start} and {test_end}")
        model = train_two_stage(train, cols, config, date_column=grain.period_col)
        models[grain.name] = model
        summary[f"{grain.name}_rounds"] = model.rounds
        pred_path = f"{out}/predictions/{grain.name}"
        write_features(prediction_table(predict_two_stage(model, test), grain.period_col), pred_path)
        predictions[grain.name] = spark.read.parquet(pred_path)

    stacked = ev.stack_horizons(predictions["weekly"], predictions["monthly"])
    table = ev.accuracy_table(stacked)
    summary["accuracy"] = [r.asDict() for r in table.collect()]  # one row per horizon
    write_features(ev.actual_vs_predicted(stacked), f"{out}/report/actual_vs_predicted")
    write_features(ev.top_product_series(stacked), f"{out}/report/top_product_series")

    save_bundle(
        spark,
        models,
        f"{out}/models",
        weights=dict(config.weights),
        training_window=f"{train_start} <= period < {test_start}",
        test_window=f"{test_start} <= period < {test_end}",
        prediction_rounding="nearest whole number, ties to even",
    )
    return summary


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Clean -> explore -> features -> train -> evaluate -> save")
    src = p.add_mutually_exclusive_group(required=True)
    src.add_argument("--input", help="raw POS files (path or glob)")
    src.add_argument("--sf-dir", help="driver fixture tables (lineitem/orders/part parquet)")
    p.add_argument("--input-format", default="csv")
    p.add_argument("--output", required=True, help="output folder on shared storage")
    p.add_argument("--train-start", default=DEFAULT_TRAIN_START)
    p.add_argument("--test-start", default=DEFAULT_TEST_START)
    p.add_argument("--test-end", default=DEFAULT_TEST_END)
    p.add_argument("--classifier-iters", type=int)
    p.add_argument("--regressor-iters", type=int)
    p.add_argument("--forest-trees", type=int)
    p.add_argument("--no-explore", action="store_true")
    p.add_argument("--date-format", action="append", help="date pattern of the input, tried in the order given; repeatable")
    p.add_argument("--time-format", action="append", help="clock time pattern of the input; repeatable")
    p.add_argument("--fill-gaps", action="store_true", help="zero rows for periods without a sale")
    args = p.parse_args(argv)
    cfg = TwoStageConfig()
    overrides = {k: v for k, v in (("classifier_iters", args.classifier_iters),
                                   ("regressor_iters", args.regressor_iters),
                                   ("forest_trees", args.forest_trees)) if v is not None}
    cfg = replace(cfg, **overrides)
    spark = SparkSession.builder.appName("shelfcast-pipeline").getOrCreate()
    summary = run_pipeline(spark, args.output, args.input, args.sf_dir, args.input_format, args.train_start,
                           args.test_start, args.test_end, cfg, explore=not args.no_explore,
                           fill_gaps=args.fill_gaps,
                           date_formats=tuple(args.date_format or DEFAULT_DATE_FORMATS),
                           time_formats=tuple(args.time_format or DEFAULT_TIME_FORMATS))
    print(json.dumps(summary, default=str, indent=2))


if __name__ == "__main__":
    main()
