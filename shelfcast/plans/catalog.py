"""Driver query catalogue: one ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the driver tables (through the views in
:mod:`shelfcast.sources.fixtures`) over their whole extent. Output doubles
that come from averages or logs are rounded to 6 places, as in the oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.operators import features as fe
from shelfcast.sources import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str) -> Callable[[Query], Query]:
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return deco


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    casts = {n: F.round(F.col(n), places) for n, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(casts) if casts else df


@register("weekly_features")
def weekly_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = fixtures.transactions(spark, sf_dir)
    return round_doubles(fe.build_features(tx, fe.WEEKLY, narrow=False))


@register("monthly_features")
def monthly_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = fixtures.transactions(spark, sf_dir)
    return round_doubles(fe.build_features(tx, fe.MONTHLY, narrow=False))


# --- helpers shared by several queries -------------------------------------------------

# The time split of the fixture data (its sales run 1995..2001-08).
FIXTURE_TRAIN_START = "1996-01-01"
FIXTURE_TEST_START = "2001-01-01"
FIXTURE_TEST_END = "2002-01-01"


def _features(spark: SparkSession, sf_dir: str, grain: fe.Grain, **kw) -> DataFrame:
    return fe.build_features(fixtures.transactions(spark, sf_dir), grain, narrow=False, **kw)


def _naive_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfcast.operators import evaluation as ev

    tx = fixtures.transactions(spark, sf_dir)
    preds = [
        ev.naive_forecast(
            fe.build_features(tx, g, narrow=False), g, FIXTURE_TEST_START, FIXTURE_TEST_END
        )
        for g in (fe.WEEKLY, fe.MONTHLY)
    ]
    return ev.stack_horizons(*preds)


# --- ingest ----------------------------------------------------------------------------


def spoilt_raw_lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a raw POS export: every field text, padded headers, a header
    alias, and one kind of damage per line number (bad date, ``1.5d`` price, empty
    quantity, bad time, lenient time with an exponent price, null-token name). First
    lines have, by order, a price of 1e100, of 400 digits or of 1e-100, or an ISO date-time."""
    li = fixtures.read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_shipdate", "l_returnflag",
    )
    n = F.col("l_linenumber")
    first = lambda k: (n == 1) & (F.col("l_orderkey") % 5 == k)
    as_text = lambda c: c.cast("string")
    net = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
    return li.select(
        as_text(F.col("l_orderkey")).alias("Transaction ID"),
        F.when(n == 2, F.lit("bad"))
        .when(first(3), F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T10:30:00.250")))
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias(" Date"),
        F.when(n == 5, F.lit("bad")).when(n == 6, F.lit("9:05 PM")).otherwise(F.lit("10:30:00")).alias("Time "),
        as_text(F.col("l_partkey")).alias("ProductID"),
        F.when(n == 7, F.lit("N/A")).otherwise(F.concat(F.lit("part "), as_text(F.col("l_partkey")))).alias(
            "ProductName"
        ),
        F.col("l_returnflag").alias("Category"),
        F.when(n == 3, F.lit("1.5d")).otherwise(as_text(F.col("l_extendedprice") / F.col("l_quantity"))).alias(
            "UnitPrice"
        ),
        F.when(first(0), F.lit("1e100")).when(first(1), F.lit("9" * 400)).when(first(2), F.lit("1e-100"))
        .otherwise(as_text(F.col("l_extendedprice"))).alias("BuyingPrice"),
        F.when(n == 6, F.lit(" 1e3 ")).otherwise(as_text(net / F.col("l_quantity"))).alias("SellingPrice"),
        F.when(n == 4, F.lit("")).otherwise(as_text(F.col("l_quantity"))).alias("Quantity"),
        as_text(net).alias("Total_LKR"),
        as_text(F.col("l_linenumber")).alias("line"),
    )


def spoilt_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spoilt line items as the raw table that a CSV export of them reads back as:
    every row a line of text, parsed into text fields. Nothing is written. Some first lines lack their last field,
    have one too many, or begin with a quote that is never closed."""
    from shelfcast.sources.readers import parse_pos_lines

    rows = spoilt_raw_lineitems(spark, sf_dir)
    text = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    damage = F.when(F.col("line") == "1", F.col("`Transaction ID`").cast("long") % 15)
    lines = rows.select(F.when(damage == 4, F.regexp_replace(text, ",[^,]*$", "")).when(damage == 9, F.concat(text, F.lit(",surplus")))
                        .when(damage == 14, F.concat(F.lit('"'), text)).otherwise(text).alias("line"))
    return parse_pos_lines(lines, "line", rows.columns)


@register("ingest_coercion")
def ingest_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest of a dirty POS export: CSV lines as text (header trim, alias, required
    columns), coerce, reject incomplete rows, compose the sale timestamp."""
    from shelfcast.operators.cleaning import clean_transactions

    return clean_transactions(spoilt_csv_lines(spark, sf_dir)).select(
        "txn_id", F.col("line").cast("int").alias("line"), "sale_date", "sold_at", "product_id", "product_name",
        "category", "unit_price", "buying_price", "selling_price", "quantity", "total_amount",
    )


@register("ingest_rejects")
def ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per required column, how many rows of the dirty export fail to parse (one row)."""
    from shelfcast.operators.cleaning import coerce_raw, reject_counts

    return reject_counts(coerce_raw(spoilt_csv_lines(spark, sf_dir)))


@register("price_rounding")
def price_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfcast.operators.cleaning import unit_margin

    tx = unit_margin(fixtures.transactions(spark, sf_dir))
    return tx.select(
        "txn_id", "product_id", "sale_date", "unit_price", "buying_price", "selling_price", "quantity",
        "total_amount", "unit_margin", "payment_method",
    )


# --- features --------------------------------------------------------------------------


@register("weekly_rollup")
def weekly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(fe.rollup(fixtures.transactions(spark, sf_dir), fe.WEEKLY))


@register("monthly_rollup")
def monthly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(fe.rollup(fixtures.transactions(spark, sf_dir), fe.MONTHLY))


def _lags(spark: SparkSession, sf_dir: str, g: fe.Grain) -> DataFrame:
    rolled = fe.rollup(fixtures.transactions(spark, sf_dir), g)
    return round_doubles(
        fe.add_history(rolled, g).select(*fe.PRODUCT_KEYS, g.period_col, "quantity", *g.history_cols)
    )


@register("weekly_lags")
def weekly_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lags(spark, sf_dir, fe.WEEKLY)


@register("monthly_lags")
def monthly_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lags(spark, sf_dir, fe.MONTHLY)


@register("gap_filled_weekly")
def gap_filled_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(_features(spark, sf_dir, fe.WEEKLY, fill=True))


@register("daily_lags")
def daily_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(fe.daily_features(fixtures.transactions(spark, sf_dir)))


# --- exploration -----------------------------------------------------------------------


def _explore(name: str) -> Query:
    from shelfcast.operators import explore as ex

    op = getattr(ex, name)

    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_doubles(op(fixtures.transactions(spark, sf_dir)))

    q.__name__ = name
    return q


for _name in (
    "monthly_price_trend",
    "daily_quantity",
    "basket_sizes",
    "basket_histogram",
    "top_products",
    "monthly_revenue",
    "category_revenue",
    "margin_histogram",
):
    register(_name)(_explore(_name))


def _hourly(name: str) -> Query:
    from shelfcast.operators import explore as ex

    op = getattr(ex, name)

    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op(fixtures.hourly_transactions_view(spark, sf_dir))

    q.__name__ = name
    return q


for _name in ("hourly_transactions", "weekday_hour_quantity", "weekday_hour_matrix"):
    register(_name)(_hourly(_name))


# --- dataset and evaluation ------------------------------------------------------------


@register("time_split")
def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfcast.operators.dataset import time_split as split

    feats = _features(spark, sf_dir, fe.WEEKLY)
    train, test = split(feats, "week_ending", FIXTURE_TRAIN_START, FIXTURE_TEST_START, FIXTURE_TEST_END)
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return both.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("quantity").alias("quantity"),
        F.min("week_ending").alias("first_period"),
        F.max("week_ending").alias("last_period"),
    )


@register("forecast_metrics")
def forecast_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfcast.operators.evaluation import metric_pack

    return round_doubles(metric_pack(_naive_stacked(spark, sf_dir), group_by=("horizon", "category")))


@register("accuracy_table")
def accuracy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfcast.operators.evaluation import accuracy_table as table

    return round_doubles(table(_naive_stacked(spark, sf_dir)))


@register("actual_vs_predicted")
def actual_vs_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfcast.operators.evaluation import actual_vs_predicted as avp

    return round_doubles(avp(_naive_stacked(spark, sf_dir)))


@register("top_forecast_product")
def top_forecast_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfcast.operators.evaluation import top_forecast_product as top

    return round_doubles(top(_naive_stacked(spark, sf_dir)))


@register("top_product_series")
def top_product_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfcast.operators.evaluation import top_product_series as series

    return round_doubles(series(_naive_stacked(spark, sf_dir)))


# --- blending and scoring --------------------------------------------------------------


def _weekly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly features with three stand-in model scores and a stand-in class."""
    feats = _features(spark, sf_dir, fe.WEEKLY)
    return feats.select(
        *fe.PRODUCT_KEYS,
        "week_ending",
        (F.col("lag_1_week") > 20).cast("int").alias("demand_class"),
        F.col("lag_1_week").cast("double").alias("score_a"),
        F.col("lag_2_weeks").cast("double").alias("score_b"),
        F.when(F.col("lag_2_weeks") > 40, F.lit(float("nan")))
        .otherwise(F.col("rolling_mean_4_weeks"))
        .alias("score_c"),
    )


@register("gated_blend")
def gated_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfcast.operators.ensemble import gated_blend as blend

    s = _weekly_scores(spark, sf_dir)
    return s.select(
        *fe.PRODUCT_KEYS,
        "week_ending",
        "demand_class",
        blend(F.col("demand_class"), [F.col("score_a"), F.col("score_b"), F.col("score_c")]).alias(
            "predicted_quantity"
        ),
    )


ENSEMBLE_MODELS = ("xgb_regressor", "lgbm_regressor", "rf_regressor")


@register("weighted_ensemble")
def weighted_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfcast.operators.ensemble import DEFAULT_BLEND_WEIGHTS, blend_shares, to_demand, weighted_score

    weights = blend_shares(ENSEMBLE_MODELS, DEFAULT_BLEND_WEIGHTS)
    s = _weekly_scores(spark, sf_dir)
    scores = dict(zip(ENSEMBLE_MODELS, (F.col("score_a"), F.col("score_b"), F.col("score_c"))))
    out = s.select(*fe.PRODUCT_KEYS, "week_ending", weighted_score(scores, weights).alias("ensemble_score"))
    return round_doubles(out.withColumn("predicted_demand", to_demand(F.col("ensemble_score"))))


@register("log_target_inverse")
def log_target_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfcast.operators.ensemble import inverse_log_target, to_demand

    feats = _features(spark, sf_dir, fe.WEEKLY)
    score = F.when(F.col("lag_1_week") > F.col("lag_2_weeks"), F.col("lag_1_week").cast("double")).otherwise(
        F.col("log_quantity")
    )
    out = feats.select("product_id", "product_name", "category", "week_ending", score.alias("score"))
    out = out.withColumn("demand_value", inverse_log_target(F.col("score")))
    return round_doubles(out.withColumn("predicted_demand", to_demand(F.col("demand_value"))))


@register("latest_features")
def latest_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfcast.operators.scoring import latest_rows

    return round_doubles(latest_rows(_features(spark, sf_dir, fe.WEEKLY), fe.WEEKLY))


def catalogue_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast requests for the whole part catalogue: ids padded with blanks, some
    unknown (``X`` prefix), timeframes in mixed case, some invalid (``Daily``)."""
    part = fixtures.read_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    size = F.col("p_size")
    key = F.col("p_partkey").cast("string")
    return part.select(
        F.col("p_partkey").alias("request_id"),
        F.when(size >= 47, F.concat(F.lit("X"), key)).otherwise(F.concat(F.lit("  "), key, F.lit(" "))).alias(
            "product_id"
        ),
        F.when(size.between(41, 43), F.lit("Daily"))
        .when(size <= 20, F.lit(" Weekly"))
        .when(size <= 30, F.lit("MONTHLY "))
        .otherwise(F.lit("weekly"))
        .alias("timeframe"),
    )


@register("score_requests")
def score_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfcast.operators.scoring import attach_latest, latest_by_timeframe, normalize_requests

    tx = fixtures.transactions(spark, sf_dir)
    latest = latest_by_timeframe(
        fe.build_features(tx, fe.WEEKLY, narrow=False),
        fe.build_features(tx, fe.MONTHLY, narrow=False),
        columns=("quantity",),
    )
    out = attach_latest(normalize_requests(catalogue_requests(spark, sf_dir)), latest)
    return out.select(
        "request_id", "product_id", "timeframe", "status", "period", F.col("quantity").cast("double").alias("quantity")
    )


def daily_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-row requests from the daily features, spoilt on some days of the month
    (price 0 or NaN, weekday 7 or -1, month 13 or 0, no id, no weekend flag)."""
    daily = fe.daily_features(fixtures.transactions(spark, sf_dir))
    dom = F.dayofmonth("sale_date")
    return daily.select(
        F.when(dom != 12, F.col("product_id")).alias("item_id"),
        "sale_date",
        "lag_7",
        "lag_14",
        F.when(dom != 18, F.col("is_weekend")).alias("is_weekend"),
        F.when(dom == 5, F.lit(0.0)).when(dom == 8, F.lit(float("nan"))).otherwise(F.col("selling_price")).alias("selling_price"),
        F.when(dom == 10, F.lit(7)).when(dom == 20, F.lit(-1)).otherwise(F.col("day_of_week")).alias("day_of_week"),
        F.when(dom == 15, F.lit(13)).when(dom == 25, F.lit(0)).otherwise(F.col("month")).alias("month"),
    )


@register("validate_requests")
def validate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfcast.operators.scoring import validate_requests as validate

    return round_doubles(validate(daily_requests(spark, sf_dir)))


# --- model fitting and scoring (rows-only checks: no SQL statement of a tree fit) ----


def _filled(spark: SparkSession, sf_dir: str, grain: fe.Grain) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gap-filled features (both demand classes occur) with their train and test rows."""
    from shelfcast.operators.dataset import time_split

    feats = _features(spark, sf_dir, grain, fill=True)
    return feats, *time_split(feats, grain.period_col, FIXTURE_TRAIN_START, FIXTURE_TEST_START, FIXTURE_TEST_END)


def _fit(spark: SparkSession, sf_dir: str, grain: fe.Grain):
    """The two-stage model of one horizon at the library's defaults."""
    from shelfcast.operators.dataset import feature_columns
    from shelfcast.operators.modeling import train_two_stage
    from shelfcast.session import use_checkpoint_dir

    use_checkpoint_dir(spark)
    feats, train, test = _filled(spark, sf_dir, grain)
    return feats, test, train_two_stage(train, feature_columns(feats), date_column=grain.period_col)


def _model_inputs(grain: fe.Grain) -> Query:
    from shelfcast.operators.dataset import feature_columns, positive_rows, time_split, with_labels

    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        """What the fits read: features, label and class of the training rows, and whether the regressors see a row."""
        feats = _features(spark, sf_dir, grain, fill=True)
        train, _ = time_split(feats, grain.period_col, FIXTURE_TRAIN_START, FIXTURE_TEST_START, FIXTURE_TEST_END)
        keys = [*fe.PRODUCT_KEYS, grain.period_col]
        rows = with_labels(train).select(*keys, *feature_columns(feats), "label", "demand")
        seen = positive_rows(rows, "label").withColumn("for_regressors", F.lit(True))
        rest = rows.where("demand = 0").withColumn("for_regressors", F.lit(False))
        return round_doubles(seen.unionByName(rest))

    return q


for _grain in (fe.WEEKLY, fe.MONTHLY):
    register(f"model_inputs_{_grain.name}")(_model_inputs(_grain))


@register("prediction_keys")
def prediction_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prediction tables of both horizons but for the prediction."""
    from shelfcast.operators.dataset import time_split
    from shelfcast.operators.modeling import prediction_table

    parts = []
    for grain in (fe.WEEKLY, fe.MONTHLY):
        feats = _features(spark, sf_dir, grain, fill=True)
        _, test = time_split(feats, grain.period_col, FIXTURE_TRAIN_START, FIXTURE_TEST_START, FIXTURE_TEST_END)
        table = prediction_table(test.withColumn("predicted_quantity", F.lit(None).cast("int")), grain.period_col)
        parts.append(table.drop("predicted_quantity").withColumn("horizon", F.lit(grain.name)))
    return parts[0].unionByName(parts[1])


def _two_stage(grain: fe.Grain) -> Query:
    from shelfcast.operators.modeling import predict_two_stage, prediction_table

    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, test, model = _fit(spark, sf_dir, grain)
        return prediction_table(predict_two_stage(model, test), grain.period_col)

    return q


register("two_stage_forecast")(_two_stage(fe.WEEKLY))
register("two_stage_forecast_monthly")(_two_stage(fe.MONTHLY))


@register("forecast_latest")
def forecast_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly forecast of every product by a bundle that was saved and loaded again."""
    import uuid

    from shelfcast.plans.forecast import saved_forecasts
    from shelfcast.session import work_dir
    from shelfcast.sources.model_store import save_bundle

    feats, _, model = _fit(spark, sf_dir, fe.WEEKLY)
    models = f"{work_dir(spark)}/models-{uuid.uuid4().hex}"
    save_bundle(spark, {"weekly": model}, models)
    return saved_forecasts(spark, models, {"weekly": feats})


@register("score_valid_requests")
def score_valid_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfcast.operators.scoring import score_requests_with_model, train_request_model, validate_requests

    daily = fe.daily_features(fixtures.transactions(spark, sf_dir))
    model = train_request_model(daily)
    return score_requests_with_model(model, validate_requests(daily_requests(spark, sf_dir)))


# The history columns of each horizon, standing in for the three regressors.
STAND_INS = {
    "weekly": ("lag_1_week", "lag_2_weeks", "rolling_mean_4_weeks"),
    "monthly": ("lag_1_month", "lag_2_months", "rolling_mean_3_months"),
}


@register("forecast_requests")
def forecast_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests answered with forecasts of both horizons: latest row of each product (its
    id padded, as some exports have it), stand-in scores, gate, blend, demand, status."""
    from shelfcast.operators import scoring
    from shelfcast.operators.ensemble import DEFAULT_BLEND_WEIGHTS, blend_shares, to_demand, weighted_score

    weights = blend_shares(ENSEMBLE_MODELS, DEFAULT_BLEND_WEIGHTS)
    parts = []
    for grain in (fe.WEEKLY, fe.MONTHLY):
        padded = _features(spark, sf_dir, grain).withColumn("product_id", F.concat(F.lit(" "), "product_id", F.lit("  ")))
        names = STAND_INS[grain.name]
        frame = scoring.inference_frame(scoring.latest_rows(padded, grain), names, keep=("product_id", grain.period_col))
        value = to_demand(weighted_score({m: F.col(c) for m, c in zip(ENSEMBLE_MODELS, names)}, weights))
        parts.append(frame.select("product_id", F.lit(grain.name).alias("timeframe"), F.col(grain.period_col).alias("period"),
                                  F.when(F.col(names[0]) > 20, value).otherwise(F.lit(0).cast("bigint")).alias("predicted_demand")))
    out = scoring.forecast_requests(catalogue_requests(spark, sf_dir), parts[0].unionByName(parts[1]))
    return out.select("request_id", "product_id", "timeframe", "status", "period", "predicted_demand")


@register("inference_frame")
def inference_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest weekly rows as a model's inputs: a number, a number with NaN, text that is
    no number, a column that is absent, and two values of a text column as 0 / 1."""
    from shelfcast.operators.scoring import inference_frame as frame
    from shelfcast.operators.scoring import latest_rows

    latest = latest_rows(_features(spark, sf_dir, fe.WEEKLY), fe.WEEKLY)
    latest = latest.withColumns({
        "lag_2_weeks": F.when(F.col("lag_2_weeks") > 30, F.lit(float("nan"))).otherwise(F.col("lag_2_weeks")),
        "size": F.element_at(F.split("category", " "), 1),
    })
    columns = ["lag_1_week", "lag_2_weeks", "product_name", "not_there", "size_SMALL", "size_PROMO"]
    return frame(latest, columns, keep=("product_id", "week_ending"))


@register("gap_filled_monthly")
def gap_filled_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(_features(spark, sf_dir, fe.MONTHLY, fill=True))


@register("latest_naive_forecast")
def latest_naive_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue-wide forecast path (latest row per product, aligned inputs,
    finite weighted mean, class gate, clamp and round) with the three history
    columns standing in for the regressors and lag 1 > 20 for the classifier."""
    from shelfcast.operators.ensemble import DEFAULT_BLEND_WEIGHTS, blend_shares, to_demand, weighted_score
    from shelfcast.operators.scoring import inference_frame, latest_rows

    latest = latest_rows(_features(spark, sf_dir, fe.WEEKLY), fe.WEEKLY)
    frame = inference_frame(latest, ["lag_1_week", "lag_2_weeks", "rolling_mean_4_weeks"],
                            keep=("product_id", "week_ending"))
    weights = blend_shares(ENSEMBLE_MODELS, DEFAULT_BLEND_WEIGHTS)
    scores = dict(zip(ENSEMBLE_MODELS, (F.col("lag_1_week"), F.col("lag_2_weeks"), F.col("rolling_mean_4_weeks"))))
    demand = F.when(F.col("lag_1_week") > 20, to_demand(weighted_score(scores, weights))).otherwise(
        F.lit(0).cast("bigint")
    )
    return frame.select(
        "product_id",
        F.lit("weekly").alias("timeframe"),
        F.col("week_ending").alias("period"),
        demand.alias("predicted_demand"),
    )


@register("next_period_naive_forecast")
def next_period_naive_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast of the period after each product's last sale: next-period inputs
    (lags advanced by one), latest row per product, the three history columns as
    stand-in regressors, lag 1 > 20 as the stand-in class."""
    from shelfcast.operators.ensemble import DEFAULT_BLEND_WEIGHTS, blend_shares, to_demand, weighted_score
    from shelfcast.operators.scoring import inference_frame, latest_rows

    nxt = fe.next_period_features(fixtures.transactions(spark, sf_dir), fe.WEEKLY)
    latest = latest_rows(nxt, fe.WEEKLY)
    frame = inference_frame(latest, ["lag_1_week", "lag_2_weeks", "rolling_mean_4_weeks"],
                            keep=("product_id", "week_ending", "is_christmas_month", "is_payday_week"))
    weights = blend_shares(ENSEMBLE_MODELS, DEFAULT_BLEND_WEIGHTS)
    scores = dict(zip(ENSEMBLE_MODELS, (F.col("lag_1_week"), F.col("lag_2_weeks"), F.col("rolling_mean_4_weeks"))))
    demand = F.when(F.col("lag_1_week") > 20, to_demand(weighted_score(scores, weights))).otherwise(
        F.lit(0).cast("bigint")
    )
    return frame.select(
        "product_id",
        F.col("week_ending").alias("period"),
        "is_christmas_month",
        "is_payday_week",
        "lag_1_week",
        "lag_2_weeks",
        F.round("rolling_mean_4_weeks", 6).alias("rolling_mean_4_weeks"),
        demand.alias("predicted_demand"),
    )
