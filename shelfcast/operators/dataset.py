"""Model dataset preparation: feature choice, time split, labels, vector assembly."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")

# Columns never used as model inputs (names, targets, period keys).
EXCLUDED_FEATURES = frozenset(
    {"product_name", "category", "quantity", "log_quantity", "week_ending", "month_start", "is_filled"}
)
# Same-period revenue is the target times price: it leaks the label.
SAME_PERIOD_COLUMNS = frozenset({"total_amount"})

# The reference split (train 2019..2024, test 2025).
DEFAULT_TRAIN_START = "2019-01-01"
DEFAULT_TEST_START = "2025-01-01"
DEFAULT_TEST_END = "2026-01-01"


def feature_columns(
    df: DataFrame, include_same_period: bool = False, exclude: Iterable[str] = ()
) -> list[str]:
    """Numeric columns that are not names, targets or periods, in table order.

    Ids are text, so they never become features.
    """
    drop = set(EXCLUDED_FEATURES) | set(exclude)
    if not include_same_period:
        drop |= SAME_PERIOD_COLUMNS
    return [c for c, t in df.dtypes if c not in drop and t in NUMERIC_TYPES]


def time_split(
    df: DataFrame,
    period_col: str,
    train_start: str = DEFAULT_TRAIN_START,
    test_start: str = DEFAULT_TEST_START,
    test_end: str = DEFAULT_TEST_END,
) -> tuple[DataFrame, DataFrame]:
    """Train: train_start <= period < test_start; test: test_start <= period < test_end.

    Rows before ``train_start`` only served to warm up the lags.
    """
    p = F.col(period_col)
    d = lambda s: F.lit(s).cast("date")
    train = df.filter((p >= d(train_start)) & (p < d(test_start)))
    test = df.filter((p >= d(test_start)) & (p < d(test_end)))
    return train, test


def with_labels(df: DataFrame, target: str = "quantity") -> DataFrame:
    """``label``: the target as DOUBLE; ``demand``: 1.0 when it is positive, else 0.0."""
    return df.withColumns(
        {
            "label": F.col(target).cast("double"),
            "demand": (F.col(target) > 0).cast("double"),
        }
    )


def positive_rows(df: DataFrame, target: str = "quantity") -> DataFrame:
    return df.filter(F.col(target) > 0)


def assembler(feature_cols: list[str], output: str = "features") -> VectorAssembler:
    """Vector assembly; a NULL or NaN input raises instead of being dropped silently."""
    return VectorAssembler(inputCols=feature_cols, outputCol=output, handleInvalid="error")
