"""Numeric column helpers: guarded parsing, half-even rounding, finiteness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokens that a pandas CSV reader turns into a missing value by
# default (public pandas ``read_csv`` documentation). An empty field is missing too.
NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# A plain decimal number with optional sign and exponent. Spark's own cast also
# accepts suffixes such as ``1.5d`` and words such as ``Infinity``; both are
# rejected here, as are thousands separators (``1,5``) and every null token.
DECIMAL_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"

# Amounts and quantities end up as BIGINT; a number outside its range is no valid value.
BIGINT_LIMIT = float(2**63)


def null_tokens_to_null(c: Column) -> Column:
    """String column with every null token (after trimming) mapped to NULL."""
    return F.when(F.trim(c).isin(*NULL_TOKENS), F.lit(None).cast("string")).otherwise(c)


def guarded_double(c: Column) -> Column:
    """Parse text as DOUBLE; anything that is not a plain decimal, or not finite and
    within the range of BIGINT, becomes NULL.

    The input is read once, also by the range check: a non-matching field extracts as
    '' and casts to NULL. (Written so because Catalyst inlines this expression into a
    later null filter; every extra reference would be parsed again.)
    """
    number = F.regexp_extract(F.trim(c.cast("string")), DECIMAL_PATTERN, 0).try_cast("double")
    return F.get(F.filter(F.array(number), lambda v: F.abs(v) < F.lit(BIGINT_LIMIT)), F.lit(0))


def is_finite(c: Column) -> Column:
    """TRUE for finite numbers, FALSE for NaN and +-infinity, NULL for NULL."""
    return ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def round_half_even_to_step(c: Column, step: int = 10) -> Column:
    """Round to the nearest multiple of ``step``, ties to even, as BIGINT (25 -> 20, 35 -> 40);
    NULL beyond its range."""
    return (F.rint(c / F.lit(float(step))) * F.lit(step)).try_cast("bigint")


def truncate_to_long(c: Column) -> Column:
    """Cast toward zero (-2.7 -> -2), as pandas ``astype('int64')`` does; NULL beyond the range."""
    return c.try_cast("bigint")
