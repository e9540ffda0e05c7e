"""Point-of-sale views over the driver's TPC-H-like tables.

``transactions``: one row per line item, lineitem joined to orders (order key)
and part (part key). Prices are the raw doubles; :func:`price_cleaning` rounds
them. ``hourly``: the events table read as till transactions, because order
dates carry no time of day.

Join strategy: lineitem and orders are both fact-sized, so they meet in a
sort-merge join on the order key (hinted, so small test scales plan what a
cluster plans). Part is left to Spark's size check: it is
broadcast only while its measured size is under
``spark.sql.autoBroadcastJoinThreshold``, else shuffled. No broadcast hint is
given for tables whose size grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# The columns of the driver tables that the views read, with their types.
# A declared schema reads only these columns and skips the footer-inference job.
TABLE_COLUMNS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_returnflag string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_name string, p_type string, p_size int, p_retailprice double",
    "events": "ts timestamp_ntz, user_id bigint, value double",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_COLUMNS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_read = read_table


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount"
    )
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_retailprice")
    # Fact-to-fact: a sort-merge join on the order key at every size (what a cluster
    # runs anyway). It also spreads a scan that arrives in few splits over all cores.
    joined = li.join(orders.hint("merge"), li.l_orderkey == orders.o_orderkey).join(
        part, li.l_partkey == part.p_partkey
    )
    net = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
    return joined.select(
        F.col("l_orderkey").cast("string").alias("txn_id"),
        F.col("o_orderdate").cast("date").alias("sale_date"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("sold_at"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("unit_price"),
        F.col("p_retailprice").alias("buying_price"),
        F.try_divide(net, F.col("l_quantity")).alias("selling_price"),
        F.col("l_quantity").alias("quantity"),
        net.alias("total_amount"),
        F.col("o_orderpriority").alias("payment_method"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned transactions (T1): the raw view with price cleaning applied."""
    from shelfcast.operators.cleaning import price_cleaning

    return price_cleaning(raw_transactions(spark, sf_dir))


def hourly_transactions_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as till rows: user id as transaction id, rounded value as quantity."""
    ev = _read(spark, sf_dir, "events").select("ts", "user_id", "value")
    return ev.select(
        F.col("user_id").cast("string").alias("txn_id"),
        F.col("ts").cast("timestamp_ntz").alias("sold_at"),
        F.col("ts").cast("date").alias("sale_date"),
        F.rint(F.col("value")).cast("bigint").alias("quantity"),
    )
