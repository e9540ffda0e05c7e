"""Sinks: cleaned transactions and feature tables.

Row counts come from an ``Observation`` filled by the write itself, so a
sink costs one job, not a write plus a count.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from shelfcast.operators.cleaning import order_all_rows, order_rows


def _write(df: DataFrame, path: str, fmt: str, mode: str, partition_by: Sequence[str] = (), touched_only: bool = False,
           counts: Mapping[str, Column] | None = None) -> dict[str, int]:
    obs = Observation("sink_rows")
    counted = [F.count_if(condition).alias(name) for name, condition in (counts or {}).items()]
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"), *counted)
    writer = observed.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic" if touched_only else "static")
    writer.save(path)
    return {name: int(n) for name, n in obs.get.items()}


def write_cleaned(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", total_order: bool = False,
                  touched_only: bool = False) -> int:
    """Write cleaned transactions partitioned by sale year, rows ordered within files.

    The year partition turns a later time split into partition pruning. Rows are
    arranged by year first (a large year is split over tasks), so a year has a few
    files, not one for every task. Within each file rows are in the order of
    :func:`cleaning.order_rows`; with ``total_order`` the files are in that order too,
    at the price of a range shuffle of all rows.

    ``touched_only`` replaces the years that ``df`` has rows of and leaves the files of all others as they are: a late
    file of one year is written with that year's rows, as often as need be, to the same end.
    """
    out = df.withColumn("sale_year", F.year("sale_date"))
    out = order_all_rows(out) if total_order else order_rows(out.hint("rebalance", "sale_year"), "sale_year")
    return _write(out, path, fmt, mode, ["sale_year"], touched_only)["rows"]


def write_features(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", period_col: str | None = None) -> int:
    """Write a feature table (or any other). With ``period_col`` it is partitioned by that column's year (``period_year``), and only the years
    that ``df`` has rows of are replaced."""
    if period_col is None:
        return _write(df, path, fmt, mode)["rows"]
    years = df.withColumn("period_year", F.year(period_col)).hint("rebalance", "period_year")
    return _write(years, path, fmt, mode, ["period_year"], touched_only=True)["rows"]


def write_counted(df: DataFrame, path: str, counts: Mapping[str, Column]) -> dict[str, int]:
    """Write a table; returns its ``rows`` and how many meet each condition, counted by the write itself."""
    return _write(df, path, "parquet", "overwrite", counts=counts)
