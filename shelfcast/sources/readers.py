"""Readers: raw POS CSV (all text), cleaned transactions and feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.functions import guarded_double, parse_date
from shelfcast.sources.contract import (
    CLEANED_REQUIRED,
    MALFORMED,
    RAW_REQUIRED,
    canonical_headers,
    require_columns,
    strip_headers,
    to_our_names,
)


def read_pos_csv(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """Read a raw POS export with a header line; every column stays STRING.

    No schema inference: it costs a full pass and makes column types depend on
    content. Parsing happens in :func:`shelfcast.operators.cleaning.coerce_raw`. A line with more or fewer fields than the
    header, or with a quote that is never closed, is in the column ``malformed`` and has no other value.
    """

    def reader():
        r = spark.read.option("header", "true").option("inferSchema", "false").option("mode", "PERMISSIVE")
        for k, v in options.items():
            r = r.option(k, v)
        return r

    header = reader().csv(path).columns
    # Only a parser that reads all fields of a line notices a wrong number of them.
    whole = reader().schema(_raw_schema(header)).option("columnNameOfCorruptRecord", MALFORMED).option("columnPruning", "false")
    return _as_raw_table(whole.csv(path))


def parse_pos_lines(lines: DataFrame, column: str, header: list[str]) -> DataFrame:
    """Raw POS rows from a column of CSV lines without a header line, every field STRING;
    the lines may come from anywhere (a topic, a table, another query). Malformed ones as in :func:`read_pos_csv`."""
    schema = ", ".join(f"`{f.name}` string" for f in _raw_schema(header))
    row = F.from_csv(F.col(column), schema, {"columnNameOfCorruptRecord": MALFORMED, "mode": "PERMISSIVE"})
    # A generator: the optimizer would write the parser into every column and every later filter, to run there again for each.
    return _as_raw_table(lines.select(F.inline(F.array(row))))


def _raw_schema(header: list[str]) -> T.StructType:
    return T.StructType([T.StructField(h, T.StringType()) for h in (*header, MALFORMED)])


def _as_raw_table(df: DataFrame) -> DataFrame:
    # What a malformed line's fields hold is anyone's guess.
    df = df.select(*[F.when(F.col(MALFORMED).isNull(), F.col(f"`{c}`")).alias(c) for c in df.columns if c != MALFORMED], MALFORMED)
    df = canonical_headers(strip_headers(df))
    require_columns(df, RAW_REQUIRED, "the raw POS export")
    return to_our_names(df)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true").option("inferSchema", "false")
    for k, v in options.items():
        reader = reader.option(k, v)
    return strip_headers(reader.load(path))


def read_cleaned(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Reread a cleaned transaction table with the feature stage's checks."""
    df = require_columns(read_table(spark, path, fmt), CLEANED_REQUIRED, path)
    casts = {}
    if dict(df.dtypes)["sale_date"] != "date":
        casts["sale_date"] = parse_date(F.col("sale_date"))
    for c in ("quantity", "buying_price", "selling_price", "unit_price", "total_amount"):
        if dict(df.dtypes)[c] == "string":
            casts[c] = guarded_double(F.col(c))
    if dict(df.dtypes).get("sold_at") == "string":
        casts["sold_at"] = F.trim(F.col("sold_at")).try_cast("timestamp_ntz")
    if casts:
        df = df.withColumns(casts)
    return df.dropna(subset=list(CLEANED_REQUIRED))


def read_features(
    spark: SparkSession, path: str, period_col: str, fmt: str = "parquet", narrow: bool = True
) -> DataFrame:
    """Reread a weekly or monthly feature table with the preparation stage's checks:
    headers trimmed, required columns present, period and quantity parsed, rows
    missing any of them dropped, then DOUBLE -> FLOAT and BIGINT -> INT."""
    df = require_columns(
        read_table(spark, path, fmt),
        (period_col, "product_id", "product_name", "category", "quantity"),
        path,
    )
    df = df.drop("period_year")  # of the folders, see sinks.write_features
    types = dict(df.dtypes)
    casts = {}
    if types[period_col] != "date":
        casts[period_col] = parse_date(F.col(period_col))
    # A text source (CSV) carries every measure as text: all but the keys are numbers.
    text_keys = {"product_id", "product_name", "category", period_col}
    for c, t in types.items():
        if t == "string" and c not in text_keys:
            casts[c] = guarded_double(F.col(c))
    if casts:
        df = df.withColumns(casts)
    df = df.dropna(subset=[period_col, "product_id", "product_name", "category", "quantity"])
    if narrow:
        from shelfcast.operators.features import narrow_types

        df = narrow_types(df)
    return df
