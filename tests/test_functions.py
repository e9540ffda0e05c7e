"""Scalar helpers against hand-checked values (FIXTURES.md section 3, tables 1, 3, 7)."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.functions import (
    bin_index,
    guarded_double,
    in_last_week_of_month,
    month_start,
    null_tokens_to_null,
    outer_edges,
    parse_date,
    parse_time_of_day,
    round_half_even_to_step,
    truncate_to_long,
    week_ending_sunday,
)


def _col(spark, values, typ="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {typ}")


def test_guarded_double(spark):
    vals = ["12", " 3.5 ", "1.5d", "inf", "1,5", "1e3", "-2.7", "", "NA", "nan", "bad", ".5", "Infinity"]
    got = [r[0] for r in _col(spark, vals).select(guarded_double(null_tokens_to_null(F.col("v")))).collect()]
    assert got == [12.0, 3.5, None, None, None, 1000.0, -2.7, None, None, None, None, 0.5, None]


def test_null_tokens(spark):
    vals = ["NA", "null", "None", "N/A", "nan", "", "-", "x"]
    got = [r[0] for r in _col(spark, vals).select(null_tokens_to_null(F.col("v"))).collect()]
    assert got == [None, None, None, None, None, None, "-", "x"]


def test_half_even_rounding_and_truncation(spark):
    df = _col(spark, [25.0, 35.0, -25.0, 14.9, 15.0, 1234.5], "double")
    got = [r[0] for r in df.select(round_half_even_to_step(F.col("v"))).collect()]
    assert got == [20, 40, -20, 10, 20, 1230]
    q = _col(spark, [2.7, 0.4, -2.7], "double").select(truncate_to_long(F.col("v"))).collect()
    assert [r[0] for r in q] == [2, 0, -2]


def test_time_parse(spark):
    vals = ["9:05", "09:05:01", "9:05 PM", "bad", "23:59:59"]
    got = [r[0] for r in _col(spark, vals).select(parse_time_of_day(F.col("v"))).collect()]
    assert got == [9 * 3600 + 300, 9 * 3600 + 301, 21 * 3600 + 300, None, 86399]


def test_date_parse(spark):
    vals = ["2025-01-05", "2025-01-05 10:00:00", "05/01/2025", "bad"]
    got = [r[0] for r in _col(spark, vals).select(parse_date(F.col("v"))).collect()]
    assert got == [dt.date(2025, 1, 5), dt.date(2025, 1, 5), None, None]


def test_periods_and_flags(spark):
    days = [dt.date(2025, 1, 5), dt.date(2025, 1, 6), dt.date(2025, 1, 11), dt.date(2024, 2, 29),
            dt.date(2024, 12, 31), dt.date(2025, 1, 25), dt.date(2025, 1, 24)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    rows = df.select(week_ending_sunday(F.col("d")), month_start(F.col("d")), in_last_week_of_month(F.col("d"))).collect()
    assert [r[0] for r in rows] == [dt.date(2025, 1, 5), dt.date(2025, 1, 12), dt.date(2025, 1, 12),
                                   dt.date(2024, 3, 3), dt.date(2025, 1, 5), dt.date(2025, 1, 26),
                                   dt.date(2025, 1, 26)]
    assert [r[1] for r in rows][:4] == [dt.date(2025, 1, 1)] * 3 + [dt.date(2024, 2, 1)]
    # Jan has 31 days: the last seven are 25..31.
    assert [r[2] for r in rows] == [0, 0, 0, 1, 1, 1, 0]


@pytest.mark.parametrize(
    "values",
    [
        [5.0, 5.0, 5.0],  # lo == hi: numpy widens to +-0.5
        [0.0, 1.0, 2.0, 40.0],  # values on bin edges and at the maximum
        list(np.random.default_rng(7).normal(0, 100, 500).round(0) * 10),
        [-1.0, 0.1, 0.2, 0.3, 0.7, 3.3],
    ],
)
def test_histogram_bins_match_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    lo0, hi0 = min(values), max(values)
    lo, hi = outer_edges(F.lit(lo0), F.lit(hi0))
    got = np.bincount([r[0] for r in df.select(bin_index(F.col("v"), lo, hi, 40)).collect()], minlength=40)
    want, _ = np.histogram(values, bins=40)
    assert got.tolist() == want.tolist()


def test_numbers_keep_their_range(spark):
    """Finite and within BIGINT, however it is spelt; everything else is no value, and no error."""
    from pyspark.sql import functions as F

    from shelfcast.functions import guarded_double, round_half_even_to_step, truncate_to_long

    texts = ["1e-100", "1e100", "9" * 400, "1e18", "-9.3e18", "0." + "0" * 400 + "1", "12" + "0" * 15, "1E+3", "1e5000"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(guarded_double(F.col("t")).alias("v"))
    got = [r.v for r in df.collect()]
    assert got == [1e-100, None, None, 1e18, None, 0.0, 12e15, 1000.0, None]
    wide = spark.createDataFrame([(1e25,), (25.0,)], "v double")
    out = wide.select(round_half_even_to_step(F.col("v")).alias("r"), truncate_to_long(F.col("v")).alias("q")).collect()
    assert [tuple(r) for r in out] == [(None, None), (20, 25)]


def test_iso_date_times_are_dates(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    from shelfcast.functions import parse_date

    good = ["2025-01-05", " 2025-01-05T10:30:00 ", "2025-01-05 10:30", "2025-1-5 9:05:07.125"]
    bad = ["2025-13-05", "2025-01-05T25:00", "05/01/2025", "2025-01-05x", ""]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string")
    assert [r.d for r in df.select(parse_date(F.col("t")).alias("d")).collect()] == [dt.date(2025, 1, 5)] * 4 + [None] * 5
    us = spark.createDataFrame([("1/5/2025",)], "t string").select(parse_date(F.col("t"), ("M/d/yyyy",)).alias("d")).first().d
    assert us == dt.date(2025, 1, 5)
