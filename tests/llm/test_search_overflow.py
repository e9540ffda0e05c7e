"""Numbers that are finite, but not when scaled, take no part in the search."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.llm import search


def test_numbers_too_large_to_scale(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.5]), (1, [1e307, 0.0]), (2, [0.5, 0.5]), (3, [-1e307, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, search.top_k(rows, F.col("vec_id") % 2 == 0).collect()))
    assert got == [(0, 1, 2, 256 * 128 + 128 * 128), (2, 1, 0, 256 * 128 + 128 * 128)]
