"""The ingest stage over a stream of POS files.

The reference has no streaming. Its cleaning operators are lazy DataFrame
functions, so they apply unchanged to ``readStream``: POS exports dropped into
a folder are cleaned and appended to the year-partitioned cleaned table by
Spark's file sink, exactly once (the sink's commit log and the stream's own
checkpoint folder track what was written).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfcast.operators.cleaning import clean_transactions, price_cleaning
from shelfcast.sources.contract import RAW_REQUIRED, canonical_headers, require_columns, strip_headers, to_our_names


def read_pos_stream(spark: SparkSession, path: str, header: Sequence[str], max_files_per_trigger: int = 100) -> DataFrame:
    """Stream of raw POS CSV files sharing the given header; every column STRING."""
    schema = ", ".join(f"`{h}` string" for h in header)
    raw = (
        spark.readStream.option("header", "true")
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .schema(schema)
        .csv(path)
    )
    df = canonical_headers(strip_headers(raw))
    require_columns(df, RAW_REQUIRED, path)
    return to_our_names(df)


def start_cleaning_stream(
    spark: SparkSession,
    source: str,
    header: Sequence[str],
    target: str,
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Clean each new batch of files and append it to ``target`` (parquet by sale year).

    ``checkpoint`` is the stream's own folder on shared storage, the same one after a restart.
    """
    cleaned = price_cleaning(clean_transactions(read_pos_stream(spark, source, header)))
    cleaned = cleaned.withColumn("sale_year", F.year("sale_date"))
    writer = (
        cleaned.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .partitionBy("sale_year")
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
