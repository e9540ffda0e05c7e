"""Random POS tables (hypothesis): Spark features and aggregates against pandas."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shelfcast.operators import explore as ex
from shelfcast.operators import features as fe
from tests.pos_tables import TX_SCHEMA
from tests.test_features import pandas_features

row = st.tuples(
    st.sampled_from(["A", "B", "C"]),  # product
    st.sampled_from(["n1", "n2"]),  # name (a product may carry two)
    st.integers(0, 120),  # day offset
    st.integers(-3, 12),  # quantity, returns included
    st.integers(1, 40),  # price in tens
)


def to_frame(rows) -> pd.DataFrame:
    start = dt.date(2024, 11, 4)
    out = []
    for i, (pid, name, day, q, price) in enumerate(rows):
        d = start + dt.timedelta(days=day)
        out.append((f"T{i // 2}", d, dt.datetime.combine(d, dt.time(9 + i % 12)), pid, name, "cat", price * 10 + 10,
                    price * 10 - 10, price * 10, q, price * 10 * q))
    return pd.DataFrame(out, columns=[c.split()[0] for c in TX_SCHEMA.split(", ")])


SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(row, min_size=1, max_size=60))
def test_random_weekly_features(spark, rows):
    pdf = to_frame(rows)
    got = fe.build_features(spark.createDataFrame(pdf, TX_SCHEMA), fe.WEEKLY, narrow=False).toPandas()
    want = pandas_features(pdf, weekly=True)
    assert len(got) == len(want)
    if len(want):
        g = got.sort_values(["product_id", "week_ending", "product_name"]).reset_index(drop=True)
        w = want.sort_values(["product_id", "period", "product_name"]).reset_index(drop=True)
        assert g["lag_1_week"].tolist() == w["lag1"].tolist()
        np.testing.assert_allclose(g["rolling_mean_4_weeks"], w["roll"])


@SETTINGS
@given(st.lists(row, min_size=1, max_size=60))
def test_random_aggregates(spark, rows):
    pdf = to_frame(rows)
    tx = spark.createDataFrame(pdf, TX_SCHEMA)
    daily = {r.sale_date: r.quantity for r in ex.daily_quantity(tx).collect()}
    assert daily == pdf.groupby("sale_date")["quantity"].sum().to_dict()
    hist = {r["items"]: r.transactions for r in ex.basket_histogram(tx).collect()}
    sizes = pdf.groupby("txn_id").size()
    assert sum(hist.values()) == len(sizes) and max(hist) == sizes.max()
    margins = (pdf["selling_price"] - pdf["buying_price"]).astype(float)
    counts = [r["count"] for r in ex.margin_histogram(tx).orderBy("bin").collect()]
    assert counts == np.histogram(margins, bins=40)[0].tolist()


score = st.one_of(st.floats(-50, 500, allow_nan=False), st.just(float("nan")), st.just(float("inf")),
                  st.just(float("-inf")), st.sampled_from([0.5, 1.5, 2.5, -0.5]))


def numpy_weighted(row, weights):
    used = [(s, w) for s, w in zip(row, weights) if w > 0 and np.isfinite(s)]
    total = sum(w for _, w in used)
    value = sum(s * w for s, w in used) / total if total > 0 else row[0]
    value = value if np.isfinite(value) else 0.0
    return int(np.rint(max(value, 0.0)))


@SETTINGS
@given(st.lists(st.tuples(score, score, score), min_size=1, max_size=40),
       st.tuples(st.floats(-1, 2), st.floats(-1, 2), st.floats(-1, 2)))
def test_random_weighted_demand(spark, rows, raw_weights):
    from pyspark.sql import functions as F

    from shelfcast.operators.ensemble import blend_shares, to_demand, weighted_score

    names = ["xgb_regressor", "lgbm_regressor", "rf_regressor"]
    weights = blend_shares(names, dict(zip(["xgb", "lgbm", "rf"], raw_weights)))
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "a double, b double, c double")
    expr = weighted_score(dict(zip(names, (F.col("a"), F.col("b"), F.col("c")))), weights)
    got = [r[0] for r in df.select(to_demand(expr)).collect()]
    want = [numpy_weighted(r, [weights[n] for n in names]) for r in rows]
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 1), score, score, score), min_size=1, max_size=40))
def test_random_gated_blend(spark, rows):
    from pyspark.sql import functions as F

    from shelfcast.operators.ensemble import gated_blend

    df = spark.createDataFrame([(c, float(a), float(b), float(r)) for c, a, b, r in rows],
                               "c int, a double, b double, r double")
    got = [x[0] for x in df.select(gated_blend(F.col("c"), [F.col("a"), F.col("b"), F.col("r")])).collect()]
    want = []
    for c, a, b, r in rows:
        blend = a * 0.45 + b * 0.45 + r * 0.1
        want.append(int(np.rint(max(blend, 0.0))) if c == 1 and np.isfinite(blend) else 0)
    assert got == want
