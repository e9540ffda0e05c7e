"""Small hand-made POS tables (FIXTURES.md section 3) shared by the tests."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd

TX_SCHEMA = (
    "txn_id string, sale_date date, sold_at timestamp_ntz, product_id string, product_name string, "
    "category string, unit_price bigint, buying_price bigint, selling_price bigint, quantity bigint, "
    "total_amount bigint"
)


def sparse_products(seed: int = 3) -> pd.DataFrame:
    """Products with 1, 2, 4, 5, 9 and 12 observed weeks (with gaps), several sales per
    week, product P5 sold under two names in one week, and returns (negative quantity)."""
    rng = np.random.default_rng(seed)
    start = dt.date(2024, 12, 2)  # a Monday
    rows = []
    txn = 0
    for pid, n_weeks in zip(["P1", "P2", "P3", "P4", "P5", "P6"], [1, 2, 4, 5, 9, 12]):
        weeks = sorted(rng.choice(np.arange(26), size=n_weeks, replace=False))
        for w in weeks:
            for _ in range(int(rng.integers(1, 4))):
                day = start + dt.timedelta(days=int(w) * 7 + int(rng.integers(0, 7)))
                q = int(rng.integers(-2, 9))
                price = int(rng.integers(5, 60)) * 10
                name = f"name {pid}"
                if pid == "P5" and w == weeks[3]:
                    name = rng.choice(["name P5", "renamed P5"])
                txn += 1
                rows.append(
                    (f"T{txn}", day, dt.datetime.combine(day, dt.time(int(rng.integers(7, 22)), 15)), pid, name,
                     "cat" + pid[-1], price + 20, price - 40, price, q, price * q)
                )
    return pd.DataFrame(rows, columns=[c.split()[0] for c in TX_SCHEMA.split(", ")])


def to_spark(spark, pdf: pd.DataFrame):
    return spark.createDataFrame(pdf, TX_SCHEMA)
