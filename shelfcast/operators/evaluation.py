"""Forecast evaluation: metric pack, accuracy table, report aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.features import Grain

PREDICTION_COLUMNS = ("date", "product_id", "product_name", "category", "actual_quantity", "predicted_quantity")


def naive_forecast(features: DataFrame, grain: Grain, start: str, end: str) -> DataFrame:
    """Prediction table (T4) from the rolling mean, rounded half-even, for start <= period < end.

    A transparent stand-in for model output that the SQL oracle can reproduce.
    """
    p = F.col(grain.period_col)
    return features.filter((p >= F.lit(start).cast("date")) & (p < F.lit(end).cast("date"))).select(
        p.alias("date"),
        "product_id",
        "product_name",
        "category",
        F.col("quantity").cast("double").alias("actual_quantity"),
        F.rint(F.col(grain.rolling_col)).cast("int").alias("predicted_quantity"),
    )


def stack_horizons(weekly: DataFrame, monthly: DataFrame) -> DataFrame:
    """Weekly and monthly predictions in one table with a ``horizon`` column."""
    return weekly.withColumn("horizon", F.lit("Weekly")).unionByName(monthly.withColumn("horizon", F.lit("Monthly")))


def metric_pack(
    pred: DataFrame,
    group_by: Sequence[str] = (),
    actual: str = "actual_quantity",
    predicted: str = "predicted_quantity",
) -> DataFrame:
    """R2, MAE, RMSE and MAPE in one aggregate (globally or per group).

    R2 = 1 - SSE / SST with SST = n * var_pop(actual); constant actuals give 1
    for a perfect fit, else 0; fewer than two rows give NULL. MAPE is in
    percent over rows with a nonzero actual, 0 when there are none.
    """
    y = F.col(actual).cast("double")
    p = F.col(predicted).cast("double")
    err = y - p
    n = F.count(F.lit(1))
    sse = F.sum(err * err)
    sst = F.var_pop(y) * n
    r2 = (
        F.when(n < 2, F.lit(None).cast("double"))
        .when(sst == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(F.lit(1.0) - sse / sst)
    )
    mape = F.coalesce(F.avg(F.when(y != 0, F.abs(err) / F.abs(y))) * F.lit(100.0), F.lit(0.0))
    aggs = [
        r2.alias("r2"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        mape.alias("mape"),
        n.alias("rows"),
    ]
    return pred.groupBy(*group_by).agg(*aggs) if group_by else pred.agg(*aggs)


def accuracy_table(stacked: DataFrame) -> DataFrame:
    """One metric row per horizon."""
    return metric_pack(stacked, group_by=("horizon",))


def actual_vs_predicted(stacked: DataFrame) -> DataFrame:
    """Total actual and predicted quantity per horizon and date."""
    return (
        stacked.groupBy("horizon", "date")
        .agg(
            F.sum("actual_quantity").alias("actual_quantity"),
            F.sum("predicted_quantity").cast("bigint").alias("predicted_quantity"),
        )
        .orderBy("horizon", "date")  # one row per period: a small result
    )


def top_forecast_product(stacked: DataFrame) -> DataFrame:
    """The product with the largest actual quantity over both horizons together.

    Both horizons are summed, so each sale counts twice; ties go to the smaller id.
    """
    return (
        stacked.groupBy("product_id", "product_name")
        .agg(F.sum("actual_quantity").alias("actual_quantity"))
        .orderBy(F.desc("actual_quantity"), F.asc("product_id"), F.asc("product_name"))
        .limit(1)
    )


def top_product_series(stacked: DataFrame) -> DataFrame:
    """Weekly and monthly actual/predicted series of the top product (matched on id).

    The totals that decide are summed over the products' rows as they lie for the
    series itself, so the predictions are computed once: a sum per (product, name),
    the best one by (sum, then smaller id and name), and a join back.
    """
    rows = stacked.select("horizon", "date", "product_id", "product_name", "actual_quantity", "predicted_quantity").repartition("product_id")
    totals = rows.groupBy("product_id", "product_name").agg(F.sum("actual_quantity").alias("total"))
    best = totals.orderBy(F.desc("total"), F.asc("product_id"), F.asc("product_name")).limit(1).select("product_id")
    return rows.join(best, "product_id").select(*stacked.select("horizon", "date", "product_id", "product_name").columns,
                                                "actual_quantity", "predicted_quantity").orderBy("horizon", "date")
