"""Equal-width bins with a closed last bin, numerically identical to numpy's histogram."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def outer_edges(lo: Column, hi: Column) -> tuple[Column, Column]:
    """A degenerate range lo == hi is widened to [lo - 0.5, hi + 0.5]."""
    same = lo == hi
    return (
        F.when(same, lo - F.lit(0.5)).otherwise(lo),
        F.when(same, hi + F.lit(0.5)).otherwise(hi),
    )


def bin_edge(i: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Edge ``i`` of ``bins`` equal bins over [lo, hi] (edge ``bins`` is exactly hi)."""
    step = (hi - lo) / F.lit(float(bins))
    return F.when(i >= bins, hi).otherwise(i.cast("double") * step + lo)


def bin_index(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin of ``v`` in 0..bins-1 where bin i holds edge_i <= v < edge_{i+1}, last bin closed.

    ``lo``/``hi`` must already be the outer edges. The division estimate can be
    one off near an edge, so it is corrected against the edges themselves.
    """
    guess = _guess(v, lo, hi, bins)
    return _settle(v, guess, bin_edge(guess, lo, hi, bins), bin_edge(guess + 1, lo, hi, bins), bins)


def _guess(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    return F.least(F.floor((v - lo) / (hi - lo) * F.lit(float(bins))).cast("int"), F.lit(bins - 1))


def _settle(v: Column, guess: Column, lower: Column, upper: Column, bins: int) -> Column:
    return F.when(v < lower, guess - 1).when((v >= upper) & (guess != bins - 1), guess + 1).otherwise(guess)


def with_bin_index(df, value: str, lo: str, hi: str, bins: int, out: str = "bin"):
    """``df`` plus column ``out`` = :func:`bin_index` of ``value`` against the outer-edge
    columns ``lo``/``hi``, computed in steps over named columns so that a bound
    that is itself a subquery is referenced once, not once per use in the formula."""
    v, low, high = F.col(value), F.col(lo), F.col(hi)
    staged = df.withColumn("_guess", _guess(v, low, high, bins))
    g = F.col("_guess")
    staged = staged.withColumns({"_lower": bin_edge(g, low, high, bins), "_upper": bin_edge(g + 1, low, high, bins)})
    return staged.withColumn(out, _settle(v, g, F.col("_lower"), F.col("_upper"), bins)).drop("_guess", "_lower", "_upper")
