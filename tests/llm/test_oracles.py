"""Each query that has a DuckDB statement against it, on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from shelfcast.llm import catalog
from tests.conftest import SF_SMALL


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_SMALL}/{table}.parquet')")
    want, got = con.execute(catalog.ORACLE[name]).df(), catalog.QUERIES[name](spark, SF_SMALL).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
