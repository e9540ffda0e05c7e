"""Hard negatives by residue products against brute force, and their edge cases."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("width,size", [(1, 5), (64, 300), (1500, 3000), (3, 1 << 30), (70, 1 << 40)])
def test_scores_are_exact(width, size):
    rng = np.random.default_rng(width)
    a, b = (rng.integers(-size, size, (n, width)).astype(np.float64) for n in (7, 40))
    want = np.array([[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a], dtype=object)
    got = negatives.scores(a, b)
    assert (got.astype(object) == np.clip(want, -(1 << 63), (1 << 63) - 1)).all()


def test_no_product_of_residues_leaves_float32():
    for width in (1, 64, 1024, 5000):
        for p in negatives.primes_for(width, 1 << 40):
            assert min(width, negatives.SLICE) * (p // 2) ** 2 <= 1 << 24


def brute(rows, asked):
    clean = {}
    for i, v, label in rows:
        if None not in (i, v, label) and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v):
            clean.setdefault(i, []).append((label, v))
    clean = {i: min(r) for i, r in clean.items()}
    whole = {i: [math.floor(256 * x) for x in v] for i, (_, v) in clean.items()}
    score = lambda a, b: max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(whole[a], whole[b]))))  # noqa: E731,B905
    out = []
    for a in (i for i in clean if asked(i)):
        best = sorted(((score(a, o), o) for o in clean if o != a and clean[o][0] == clean[a][0]), key=lambda t: (-t[0], t[1]))
        for ps, p in best[:5]:
            hit = sorted(((score(a, o), o) for o in clean if clean[o][0] != clean[a][0] and 30 * ps <= 100 * score(a, o) <= 90 * ps),
                         key=lambda t: (-t[0], t[1]))
            out += [(a, p, k + 1, o, ps, s) for k, (s, o) in enumerate(hit[:10])]
    return sorted(out)


def run(spark, rows, every=3):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("block", "chunk", "vector", "rank", "positives")})
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % every == 0).collect()))


def test_equals_brute_force_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 20)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    monkeypatch.setattr(negatives, "AT_ONCE", 3)
    rng = np.random.default_rng(4)
    rows = [(k, (np.abs(rng.normal(size=6)) / 3).tolist(), int(rng.integers(0, 4))) for k in range(150)]
    rows += [(200 + k, rows[9][1], k % 2) for k in range(40)]  # ties
    got = run(spark, rows)
    assert got == brute(rows, lambda i: i % 3 == 0) and len(got) > 500


def test_edge_rows(spark):
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.8], 2), (3, [-1.0, 0.0], 2), (4, None, 1), (5, [None, 1.0], 1),
            (6, [float("nan"), 1.0], 2), (9, [float("inf"), 1.0], 2), (None, [1.0, 1.0], 2), (7, [0.7, 0.1], None), (8, [0.3, 0.3], 3), (12, [1e307, 0.0], 3), (15, [], 3)]
    got = run(spark, rows)
    assert got == brute(rows, lambda i: i % 3 == 0) and got
    assert run(spark, []) == []
    huge = [(k, [1e18 * (k + 1), 1.0], k % 2) for k in range(8)]
    assert run(spark, huge) == brute(huge, lambda i: i % 3 == 0)
