"""Metric pack edge cases (FIXTURES.md section 3, table 6) against numpy formulas."""

from __future__ import annotations

import math

import numpy as np
import pytest

from shelfcast.operators.evaluation import metric_pack


def numpy_metrics(y, p):
    y, p = np.asarray(y, float), np.asarray(p, float)
    sse = ((y - p) ** 2).sum()
    sst = ((y - y.mean()) ** 2).sum()
    r2 = (1.0 if sse == 0 else 0.0) if sst == 0 else 1 - sse / sst
    nz = y != 0
    mape = float(np.mean(np.abs(y[nz] - p[nz]) / np.abs(y[nz])) * 100) if nz.any() else 0.0
    return r2, float(np.mean(np.abs(y - p))), float(np.sqrt(np.mean((y - p) ** 2))), mape


@pytest.mark.parametrize(
    "y,p",
    [
        ([0, 0, 0], [1, 0, 2]),  # all actuals zero
        ([5, 5, 5], [5, 5, 5]),  # constant, perfect
        ([5, 5, 5], [4, 5, 6]),  # constant, imperfect
        ([1, 2, 3, 4], [1, 2, 3, 4]),  # perfect
        ([3, 0, 7, 10, 2], [2, 1, 9, 8, 2]),
    ],
)
def test_metric_pack(spark, y, p):
    df = spark.createDataFrame(list(zip(map(float, y), p)), "actual_quantity double, predicted_quantity int")
    r = metric_pack(df).first()
    want = numpy_metrics(y, p)
    assert [r.r2, r.mae, r.rmse, r.mape] == pytest.approx(list(want))


def test_single_row_r2_undefined(spark):
    df = spark.createDataFrame([(3.0, 2)], "actual_quantity double, predicted_quantity int")
    r = metric_pack(df).first()
    assert r.r2 is None and math.isclose(r.mae, 1.0)


def test_grouped(spark):
    df = spark.createDataFrame(
        [("W", 1.0, 1), ("W", 2.0, 3), ("M", 4.0, 4), ("M", 8.0, 4)],
        "horizon string, actual_quantity double, predicted_quantity int",
    )
    rows = {r.horizon: r for r in metric_pack(df, group_by=("horizon",)).collect()}
    assert rows["W"].mae == pytest.approx(0.5) and rows["M"].mape == pytest.approx(25.0)
