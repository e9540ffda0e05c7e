"""Exploration aggregates on hand-made tables."""

from __future__ import annotations

import numpy as np

from shelfcast.operators import explore as ex
from tests.pos_tables import sparse_products, to_spark


def test_basket_histogram_has_empty_bins(spark):
    pdf = sparse_products()
    pdf.loc[:5, "txn_id"] = "BIG"  # one basket of six lines
    tx = to_spark(spark, pdf)
    hist = {r["items"]: r["transactions"] for r in ex.basket_histogram(tx).collect()}
    sizes = pdf.groupby("txn_id").size()
    assert sorted(hist) == list(range(1, sizes.max() + 1))
    assert hist[6] == 1 and hist[2] == 0
    assert sum(k * v for k, v in hist.items()) == len(pdf)


def test_margin_histogram_matches_numpy(spark):
    pdf = sparse_products()
    rows = ex.margin_histogram(to_spark(spark, pdf)).orderBy("bin").collect()
    margins = (pdf["selling_price"] - pdf["buying_price"]).astype(float)
    counts, edges = np.histogram(margins, bins=40)
    assert [r["count"] for r in rows] == counts.tolist()
    np.testing.assert_allclose([r["bin_start"] for r in rows], edges[:-1])
    assert sum(r["count"] for r in rows) == len(pdf)


def test_weekday_matrix_has_seven_rows(spark):
    pdf = sparse_products()
    m = ex.weekday_hour_matrix(to_spark(spark, pdf)).orderBy("weekday_index").collect()
    assert [r.weekday for r in m] == ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
    total = sum(sum(r[f"h{h:02d}"] for h in range(24)) for r in m)
    assert total == pdf["quantity"].sum()


def test_top_products_and_hours(spark):
    pdf = sparse_products()
    tx = to_spark(spark, pdf)
    top = ex.top_products(tx, k=3).collect()
    want = pdf.groupby("product_name")["total_amount"].sum().sort_values(ascending=False).head(3)
    assert [r.total_amount for r in top] == want.tolist()
    hours = {r.hour: r.transactions for r in ex.hourly_transactions(tx).collect()}
    want_h = pdf.assign(h=pdf["sold_at"].dt.hour).groupby("h")["txn_id"].nunique().to_dict()
    assert hours == want_h


def test_transaction_hour_rollup_gives_same_tables(spark):
    pdf = sparse_products()
    pdf.loc[:5, "txn_id"] = "BIG"
    tx = to_spark(spark, pdf)
    txh = ex.transaction_hour_rollup(tx)
    for op in (ex.basket_sizes, ex.basket_histogram, ex.hourly_transactions, ex.weekday_hour_quantity,
               ex.weekday_hour_matrix):
        a, b = op(tx), op(txh, rolled=True)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, op.__name__


def test_key_range_covers_exactly(spark):
    from pyspark.sql import functions as F

    for lo, hi in [(1, 1), (1, 3), (0, 39), (5, 1000), (-3, 3 * ex.RANGE_BLOCK), (2, 1)]:
        got = [r.k for r in ex.key_range(spark, F.lit(lo), F.lit(hi), "k").collect()]
        assert sorted(got) == list(range(lo, hi + 1))


def test_a_column_named_like_the_rollups_changes_nothing(spark):
    from pyspark.sql import functions as F

    tx = to_spark(spark, sparse_products())
    named = tx.withColumns({"lines": F.lit(8), "selling_price_sum": F.lit(1.0), "hour": F.lit(3), "weekday": F.lit("x")})
    for op in (ex.basket_sizes, ex.hourly_transactions, ex.weekday_hour_quantity, ex.monthly_price_trend):
        assert op(tx).exceptAll(op(named)).count() == 0, op.__name__


def test_hot_basket_histogram(spark):
    """One transaction holding a third of the rows: every size up to it is listed."""
    pdf = sparse_products()
    third = len(pdf) // 3
    pdf.loc[: third - 1, "txn_id"] = "HOT"
    hist = {r["items"]: r.transactions for r in ex.basket_histogram(to_spark(spark, pdf)).collect()}
    assert max(hist) == third and len(hist) == third and hist[third] == 1
