"""Ingest cleaning: coercing casts, null rejection, timestamp composition, price rounding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions import (
    compose_timestamp,
    guarded_double,
    null_tokens_to_null,
    parse_date,
    parse_time_of_day,
    round_half_even_to_step,
    truncate_to_long,
)
from shelfcast.functions.temporal import DEFAULT_DATE_FORMATS, DEFAULT_TIME_FORMATS
from shelfcast.sources.contract import KEY_TEXT_COLUMNS, MALFORMED, NUMERIC_COLUMNS, PRICE_COLUMNS

REQUIRED_AFTER_PARSE = (*KEY_TEXT_COLUMNS, "sale_date", "sale_seconds", *NUMERIC_COLUMNS)


def coerce_raw(
    df: DataFrame,
    date_formats: Sequence[str] = DEFAULT_DATE_FORMATS,
    time_formats: Sequence[str] = DEFAULT_TIME_FORMATS,
) -> DataFrame:
    """Parse the text columns of a raw POS table; every bad value becomes NULL.

    Null tokens are mapped to NULL in the key columns; dates and times try each
    format in turn; numbers must be plain decimals.
    """
    text = {c: null_tokens_to_null(F.col(c)) for c in KEY_TEXT_COLUMNS}
    # Null tokens never parse as a date, time or number, so those need no token step.
    parsed = {
        "sale_date": parse_date(F.col("sale_date"), date_formats),
        "sale_seconds": parse_time_of_day(F.col("sale_time"), time_formats),
    }
    numbers = {c: guarded_double(F.col(c)) for c in NUMERIC_COLUMNS}
    return df.withColumns({**text, **parsed, **numbers})


def reject_columns(df: DataFrame, columns: Sequence[str] = REQUIRED_AFTER_PARSE) -> dict[str, Column]:
    """Per required column, how many rows are NULL after coercion; malformed lines are counted apart, as ``malformed``."""
    whole = F.col(MALFORMED).isNull() if MALFORMED in df.columns else F.lit(True)
    counts = {c: F.count_if(F.col(c).isNull() & whole) for c in columns}
    return counts | ({MALFORMED: F.count_if(~whole)} if MALFORMED in df.columns else {})


def reject_counts(df: DataFrame, columns: Sequence[str] = REQUIRED_AFTER_PARSE) -> DataFrame:
    """One row: :func:`reject_columns` under ``null_<column>``, and ``malformed``, plus the total."""
    counts = {c if c == MALFORMED else f"null_{c}": n for c, n in reject_columns(df, columns).items()}
    return df.agg(F.count(F.lit(1)).alias("rows"), *[n.alias(c) for c, n in counts.items()])


def drop_incomplete(df: DataFrame, columns: Sequence[str] = REQUIRED_AFTER_PARSE) -> DataFrame:
    """Rows with all required values; malformed lines have none."""
    return df.dropna(subset=list(columns)).drop(MALFORMED)


def add_sold_at(df: DataFrame) -> DataFrame:
    """Timestamp of the sale from the parsed date and time of day.

    Both inputs are non-null here (``drop_incomplete`` ran first) and in range by
    construction, so composing cannot fail.
    """
    return df.withColumn("sold_at", compose_timestamp(F.col("sale_date"), F.col("sale_seconds"))).drop(
        "sale_seconds"
    )


def clean_transactions(
    raw: DataFrame,
    date_formats: Sequence[str] = DEFAULT_DATE_FORMATS,
    time_formats: Sequence[str] = DEFAULT_TIME_FORMATS,
) -> DataFrame:
    """Raw text POS rows to validated, typed rows (sale_time text is kept as read)."""
    return add_sold_at(drop_incomplete(coerce_raw(raw, date_formats, time_formats)))


def price_cleaning(df: DataFrame, price_step: int = 10) -> DataFrame:
    """Round the four money columns half-to-even to ``price_step``; truncate quantity.

    Amounts are rounded per row before any sum, so a total need not equal price
    times quantity; fractional quantities lose their fraction.
    """
    out = {c: round_half_even_to_step(F.col(c), price_step) for c in PRICE_COLUMNS}
    out["quantity"] = truncate_to_long(F.col("quantity"))
    return df.withColumns(out)


def unit_margin(df: DataFrame) -> DataFrame:
    return df.withColumn("unit_margin", F.col("selling_price") - F.col("buying_price"))


def order_rows(df: DataFrame, *first: str) -> DataFrame:
    """Date, time, transaction order inside each partition, behind the columns ``first``."""
    return df.sortWithinPartitions(*[c for c in (*first, "sale_date", "sold_at", "txn_id") if c in df.columns])


def order_all_rows(df: DataFrame) -> DataFrame:
    """The whole table in date, time, transaction order (a range shuffle)."""
    return df.orderBy(*[c for c in ("sale_date", "sold_at", "txn_id") if c in df.columns])
