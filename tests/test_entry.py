"""Driver contract: entry() runs, every query has a unique name, and each SQL-checked
query agrees with its DuckDB statement on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from shelfcast.plans.oracle import ORACLE
from tests.conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events".split()


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "week_ending" in df.columns and "lag_1_week" in df.columns


def test_oracle_keys_subset():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 35


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _canon(df: pd.DataFrame) -> list[tuple]:
    out = []
    for rec in df[sorted(df.columns)].itertuples(index=False):
        row = []
        for v in rec:
            if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
                row.append("NULL")
            elif hasattr(v, "isoformat"):
                s = str(v)[:19]
                row.append(s[:10] if s.endswith("00:00:00") else s)
            else:
                try:
                    f = float(v)
                    row.append(str(int(f)) if f == int(f) else repr(f))
                except (TypeError, ValueError):
                    row.append(str(v))
        out.append(tuple(row))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SF_SMALL).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert _canon(got) == _canon(want)
