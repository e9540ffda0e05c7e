"""Weekly / monthly features against an independent pandas statement, plus invariants."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import features as fe
from tests.pos_tables import sparse_products, to_spark


def pandas_features(tx: pd.DataFrame, weekly: bool) -> pd.DataFrame:
    d = pd.to_datetime(tx["sale_date"])
    if weekly:
        period = d + pd.to_timedelta((6 - d.dt.weekday) % 7, unit="D")
        width = 4
    else:
        period = d.values.astype("datetime64[M]").astype("datetime64[ns]")
        width = 3
    agg = (
        tx.assign(period=period)
        .groupby(["product_id", "product_name", "category", "period"], as_index=False)
        .agg(quantity=("quantity", "sum"), unit_price=("unit_price", "mean"), buying_price=("buying_price", "mean"),
             selling_price=("selling_price", "mean"), total_amount=("total_amount", "sum"))
        .sort_values(["product_id", "period", "product_name", "category"], kind="stable")
        .reset_index(drop=True)
    )
    lag1, lag2, roll = [], [], []
    for _, grp in agg.groupby("product_id", sort=False):
        q = grp["quantity"].tolist()
        for i in range(len(q)):
            lag1.append(q[i - 1] if i >= 1 else np.nan)
            lag2.append(q[i - 2] if i >= 2 else np.nan)
            roll.append(np.mean(q[i - width:i]) if i >= width else np.nan)
    agg["lag1"], agg["lag2"], agg["roll"] = lag1, lag2, roll
    agg = agg.dropna(subset=["lag1", "lag2", "roll"])
    agg["log_quantity"] = np.log1p(agg["quantity"].clip(lower=0))
    return agg


@pytest.mark.parametrize("grain", [fe.WEEKLY, fe.MONTHLY])
def test_features_match_pandas(spark, grain):
    pdf = sparse_products()
    got = fe.build_features(to_spark(spark, pdf), grain, narrow=False).toPandas()
    want = pandas_features(pdf, grain is fe.WEEKLY)
    assert len(got) == len(want)
    got = got.sort_values(["product_id", grain.period_col, "product_name"]).reset_index(drop=True)
    want = want.sort_values(["product_id", "period", "product_name"]).reset_index(drop=True)
    assert got["quantity"].tolist() == want["quantity"].tolist()
    assert got[grain.lag1_col].tolist() == want["lag1"].astype(int).tolist()
    assert got[grain.lag2_col].tolist() == want["lag2"].astype(int).tolist()
    np.testing.assert_allclose(got[grain.rolling_col], want["roll"])
    np.testing.assert_allclose(got["log_quantity"], want["log_quantity"])
    np.testing.assert_allclose(got["unit_price"], want["unit_price"])


def test_rows_after_history_drop(spark):
    """Rows kept = sum over products of max(0, observed periods - width)."""
    pdf = sparse_products()
    tx = to_spark(spark, pdf)
    rolled = fe.rollup(tx, fe.WEEKLY)
    per_product = rolled.groupBy("product_id").count().toPandas()["count"]
    expected = int(np.maximum(per_product - 4, 0).sum())
    assert fe.build_features(tx, fe.WEEKLY).count() == expected


def test_rollup_preserves_sums(spark):
    pdf = sparse_products()
    tx = to_spark(spark, pdf)
    for grain in (fe.WEEKLY, fe.MONTHLY):
        r = fe.rollup(tx, grain).agg(F.sum("quantity"), F.sum("total_amount")).first()
        assert (r[0], r[1]) == (pdf["quantity"].sum(), pdf["total_amount"].sum())


def test_returns_clip_log_and_flags(spark):
    pdf = sparse_products()
    out = fe.build_features(to_spark(spark, pdf), fe.WEEKLY, narrow=False).toPandas()
    assert (out.loc[out["quantity"] <= 0, "log_quantity"] == 0).all()
    months = pd.to_datetime(out["week_ending"]).dt.month
    assert (out["is_christmas_month"] == (months == 12)).all()
    assert (out["is_avurudu_month"] == (months == 4)).all()


def test_narrowing_types(spark):
    out = fe.build_features(to_spark(spark, sparse_products()), fe.WEEKLY)
    types = dict(out.dtypes)
    for c in ("quantity", "unit_price", "lag_1_week", "rolling_mean_4_weeks", "log_quantity", "price_difference"):
        assert types[c] == "float"
    for c in ("is_avurudu_month", "is_payday_week"):
        assert types[c] == "tinyint"


def test_gap_fill(spark):
    pdf = sparse_products()
    tx = to_spark(spark, pdf)
    rolled = fe.rollup(tx, fe.WEEKLY)
    filled = fe.fill_gaps(rolled, fe.WEEKLY).toPandas()
    # Each (product, name, category) runs without holes from its first to last week.
    for _, grp in filled.groupby(["product_id", "product_name", "category"]):
        weeks = pd.to_datetime(grp["week_ending"]).sort_values()
        assert (weeks.diff().dropna() == pd.Timedelta(days=7)).all()
    obs = rolled.count()
    assert int((filled["is_filled"] == 0).sum()) == obs
    assert (filled.loc[filled["is_filled"] == 1, "quantity"] == 0).all()
    assert filled["quantity"].sum() == pdf["quantity"].sum()


def test_daily_lags(spark):
    import datetime as dt

    rows = [("A", dt.date(2025, 1, 1), 3), ("A", dt.date(2025, 1, 8), 5), ("A", dt.date(2025, 1, 15), 7),
            ("A", dt.date(2025, 1, 16), 1), ("B", dt.date(2025, 1, 8), 2)]
    tx = spark.createDataFrame(rows, "product_id string, sale_date date, quantity bigint").withColumn(
        "selling_price", F.lit(10.0)
    )
    out = {(r.product_id, r.sale_date): r for r in fe.daily_features(tx).collect()}
    a15 = out[("A", dt.date(2025, 1, 15))]
    assert (a15.lag_7, a15.lag_14, a15.day_of_week, a15.is_weekend, a15.month) == (5, 3, 2, False, 1)
    assert out[("A", dt.date(2025, 1, 16))].lag_7 == 0  # on sale since Jan 1, nothing sold on Jan 9
    assert out[("A", dt.date(2025, 1, 8))].lag_14 is None  # Dec 25 is before the first sale
    assert out[("B", dt.date(2025, 1, 8))].lag_7 is None


@pytest.mark.parametrize("grain", [fe.WEEKLY, fe.MONTHLY])
def test_product_day_rollup_gives_same_features(spark, grain):
    tx = to_spark(spark, sparse_products())
    direct = fe.build_features(tx, grain, narrow=False)
    via_days = fe.build_features(fe.product_day_rollup(tx), grain, narrow=False, rolled=True)
    assert direct.exceptAll(via_days).count() == 0 and via_days.exceptAll(direct).count() == 0


def test_exploration_from_product_days(spark):
    from shelfcast.operators import explore as ex

    tx = to_spark(spark, sparse_products())
    days = fe.product_day_rollup(tx)
    for op in (ex.monthly_price_trend, ex.daily_quantity, ex.top_products, ex.monthly_revenue, ex.category_revenue):
        a, b = op(tx), op(days, rolled=True) if op is ex.monthly_price_trend else op(days)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, op.__name__


def test_narrowing_raises_on_int_overflow(spark):
    from pyspark.errors import ArithmeticException

    df = spark.createDataFrame([(2**40, 1.5)], "big bigint, x double")
    out = fe.narrow_types(df)
    assert dict(out.dtypes) == {"big": "int", "x": "float"}
    with pytest.raises(ArithmeticException):
        out.collect()


def awkward_products(spark, seed: int = 5):
    """Rolled-up rows with gaps: one key, several keys, null keys, null periods, null quantities and amounts beyond 2 ** 53."""
    import datetime as dt

    rng = np.random.default_rng(seed)
    rows = []
    for pid in [None, *(f"P{k}" for k in range(40))]:
        names = [[f"n{pid}"], [f"n{pid}"], ["a", "b"], [None, "b"], [None]][int(rng.integers(0, 5))]
        for name in names:
            days = [dt.date(1969, 11, 2) + dt.timedelta(days=7 * int(k)) for k in rng.choice(60, int(rng.integers(1, 25)), replace=False)]
            for day in [*days, *([None] if rng.random() < 0.1 else [])]:
                q = None if rng.random() < 0.1 else int(rng.integers(-3, 9)) + (2**60 if rng.random() < 0.1 else 0)
                rows.append((pid, name, None if rng.random() < 0.01 else "c", day, q, int(rng.integers(1, 9)), 1, 2, q))
    return spark.createDataFrame(rows, "product_id string, product_name string, category string, sale_date date, quantity bigint, "
                                 "unit_price bigint, buying_price bigint, selling_price bigint, total_amount bigint")


@pytest.mark.parametrize("grain", [fe.WEEKLY, fe.MONTHLY])
def test_filled_history_is_fill_then_history(spark, grain):
    rolled = fe.rollup(awkward_products(spark), grain)
    want = fe.add_history(fe.fill_gaps(rolled, grain), grain)
    got = fe.filled_history(rolled, grain)
    assert got.dtypes == want.dtypes
    text = lambda df: sorted(map(str, df.collect()))
    assert text(got) == text(want) and len(text(got)) > 300


def test_filled_rows_of_one_key_are_not_sorted(spark):
    import re

    tx = to_spark(spark, sparse_products())
    df = fe.build_features(tx, fe.WEEKLY, narrow=False, fill=True)
    # The plan's part for products under one key, from its top down to where rows are filled.
    simple = df._jdf.queryExecution().sparkPlan().toString().split("Union")[1].split("Generate")[0]
    assert not re.search(r"\b(Sort|Window) \[", simple)
