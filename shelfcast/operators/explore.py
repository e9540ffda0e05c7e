"""Descriptive sales aggregates (the tables behind the exploration charts).

All are hash aggregates with map-side partial aggregation, so a hot product,
day or transaction is collapsed before the shuffle. The per-day, per-month,
per-category and per-product tables also accept the product-day rollup of
:func:`features.product_day_rollup` in place of line items. Data-dependent bounds
(largest basket, margin range) are scalar subqueries: Spark runs them as
separate one-row jobs and inlines the value; nothing is collected by hand and
no cross join is planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions import bin_edge, month_start, outer_edges
from shelfcast.functions.histogram import with_bin_index
from shelfcast.operators.features import mean_of


def monthly_price_trend(tx: DataFrame, rolled: bool = False) -> DataFrame:
    """Mean selling price per calendar month of line items (``rolled``: of their product-day rollup)."""
    return tx.groupBy(month_start(F.col("sale_date")).alias("month")).agg(
        mean_of("selling_price", rolled).alias("avg_selling_price")
    )


def daily_quantity(tx: DataFrame) -> DataFrame:
    return tx.groupBy("sale_date").agg(F.sum("quantity").alias("quantity"))


def transaction_hour_rollup(tx: DataFrame) -> DataFrame:
    """Per transaction and clock hour (with its weekday): line count and quantity.

    Baskets, distinct transactions per hour and the weekday x hour table all
    follow from it, so a job computing the three reads the line items once.
    """
    return tx.groupBy(
        "txn_id",
        F.weekday("sold_at").alias("weekday_index"),
        F.date_format("sold_at", "EEEE").alias("weekday"),
        F.hour("sold_at").alias("hour"),
    ).agg(F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("quantity"))


def basket_sizes(tx: DataFrame, rolled: bool = False) -> DataFrame:
    """Line items per transaction (items, not units); ``rolled``: from their
    :func:`transaction_hour_rollup`."""
    items = F.sum("lines") if rolled else F.count(F.lit(1))
    return tx.groupBy("txn_id").agg(items.cast("bigint").alias("items"))


#: Numbers that one row of a generated range is spread into.
RANGE_BLOCK = 4096


def key_range(spark, lo: Column, hi: Column, name: str) -> DataFrame:
    """Rows ``lo..hi`` (BIGINT) in two levels: the starts of blocks, dealt out to tasks,
    then the numbers of each block, so no row holds more than a block of them."""
    lo, hi = lo.cast("bigint"), hi.cast("bigint")
    starts = spark.range(1).select(
        F.explode(F.when(lo <= hi, F.sequence(lo, hi, F.lit(RANGE_BLOCK).cast("bigint")))).alias("_start"), hi.alias("_hi")
    ).repartition("_start")
    last = F.least(F.col("_start") + RANGE_BLOCK - 1, F.col("_hi"))
    return starts.select(F.explode(F.sequence("_start", last)).alias(name))


def _zero_fill(counts: DataFrame, key: str, value: str, lo: Column, hi: Column) -> DataFrame:
    """Add a zero row for every key in lo..hi and re-sum: empty bins appear."""
    keys = key_range(counts.sparkSession, lo, hi, key)
    dtype = dict(counts.dtypes)[key]
    zeros = keys.select(F.col(key).cast(dtype).alias(key), F.lit(0).cast("bigint").alias(value))
    return counts.unionByName(zeros).groupBy(key).agg(F.sum(value).alias(value))


def basket_histogram(tx: DataFrame, rolled: bool = False) -> DataFrame:
    """Transactions per basket size, for every size 1..largest (empty sizes count 0)."""
    counts = basket_sizes(tx, rolled).groupBy("items").agg(F.count(F.lit(1)).alias("transactions"))
    largest = counts.select(F.max("items")).scalar()
    return _zero_fill(counts, "items", "transactions", F.lit(1), largest)


def top_products(tx: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` product names with the highest sales amount (ties: name ascending)."""
    return (
        tx.groupBy("product_name")
        .agg(F.sum("total_amount").alias("total_amount"))
        .orderBy(F.desc("total_amount"), F.asc("product_name"))
        .limit(k)
    )


def monthly_revenue(tx: DataFrame) -> DataFrame:
    return tx.groupBy(month_start(F.col("sale_date")).alias("month")).agg(F.sum("total_amount").alias("revenue"))


def category_revenue(tx: DataFrame) -> DataFrame:
    return (
        tx.groupBy("category")
        .agg(F.sum("total_amount").alias("revenue"))
        .orderBy(F.desc("revenue"), F.asc("category"))
    )


def hourly_transactions(tx: DataFrame, approximate: bool = False, rolled: bool = False) -> DataFrame:
    """Distinct transactions per hour of day (observed hours only).

    Exact distinct counting is planned as a two-level aggregate on
    (hour, transaction) then hour, so no hour's id set meets in one task.
    """
    counter = F.approx_count_distinct("txn_id") if approximate else F.count_distinct("txn_id")
    hour = F.col("hour") if rolled else F.hour("sold_at").alias("hour")
    return tx.groupBy(hour).agg(counter.alias("transactions"))


def weekday_hour_quantity(tx: DataFrame, rolled: bool = False) -> DataFrame:
    """Quantity per weekday (Monday 0) and hour of day, long form, observed cells only."""
    if rolled:
        return tx.groupBy("weekday_index", "weekday", "hour").agg(F.sum("quantity").alias("quantity"))
    return tx.groupBy(
        F.weekday("sold_at").alias("weekday_index"),
        F.date_format("sold_at", "EEEE").alias("weekday"),
        F.hour("sold_at").alias("hour"),
    ).agg(F.sum("quantity").alias("quantity"))


def weekday_hour_matrix(tx: DataFrame, rolled: bool = False) -> DataFrame:
    """Seven rows Monday..Sunday, columns ``h00``..``h23`` of quantity; empty cells 0."""
    spark = tx.sparkSession
    long = weekday_hour_quantity(tx, rolled)
    # 2024-01-01 is a Monday: seven zero cells name every weekday.
    zeros = spark.range(7).select(
        F.col("id").cast("int").alias("weekday_index"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")), "EEEE").alias("weekday"),
        F.lit(0).alias("hour"),
        F.lit(0).cast("bigint").alias("quantity"),
    )
    wide = (
        long.unionByName(zeros)
        .groupBy("weekday_index", "weekday")
        .pivot("hour", list(range(24)))
        .agg(F.sum("quantity"))
    )
    return wide.select(
        "weekday_index",
        "weekday",
        *[F.coalesce(F.col(str(h)), F.lit(0).cast("bigint")).alias(f"h{h:02d}") for h in range(24)],
    )


def margin_histogram(tx: DataFrame, bins: int = 40) -> DataFrame:
    """Histogram of unit margin (selling - buying price): ``bins`` equal-width bins from
    the smallest to the largest margin, last bin closed, every bin listed.

    Margins are first counted per distinct value (prices are rounded to a step,
    so there are few); bounds and bins are computed on that aggregate. The
    bounds are one scalar subquery attached as a column, so the bin formula
    refers to plain columns.
    """
    m = tx.select((F.col("selling_price") - F.col("buying_price")).cast("double").alias("v"))
    dist = m.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    bounds = dist.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()

    def with_edges(df: DataFrame) -> DataFrame:
        b = df.withColumn("_b", bounds)
        lo, hi = outer_edges(F.col("_b.lo"), F.col("_b.hi"))
        return b.withColumns({"_lo": lo, "_hi": hi}).drop("_b")

    binned = with_bin_index(with_edges(dist), "v", "_lo", "_hi", bins)
    counts = binned.groupBy("bin").agg(F.sum("n").alias("count"))
    filled = with_edges(_zero_fill(counts, "bin", "count", F.lit(0), F.lit(bins - 1)))
    lo, hi = F.col("_lo"), F.col("_hi")
    return filled.select(
        "bin",
        bin_edge(F.col("bin"), lo, hi, bins).alias("bin_start"),
        bin_edge(F.col("bin") + 1, lo, hi, bins).alias("bin_end"),
        "count",
    )
