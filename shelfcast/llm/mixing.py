"""Mixing sources to target weights by subset sums over document lengths.

Documents are counted by exact length in words. A source's target is filled in
three steps on those counts alone: whole passes over the source, an equal share
of every length, and for the words that are then left a bounded-knapsack dynamic
program over the remaining counts. The counts chosen per length are then drawn
from the documents in the order of a seeded hash.

Only ids, sources and lengths are shuffled. A length with very many documents is
cut into slices, so no task ranks an unbounded group.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, word_count, written

#: Words left for the dynamic program; its table has one bit for each.
DP_WORDS = 16384
#: Documents of one source and length that one task ranks.
SLICE = 1000


def knapsack(sizes: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many of each size to take so that their sum is the largest one <= budget.

    Counts are split into powers of two; ``reach`` has bit s set when s words
    can be made, ``last`` the piece that first made s.
    """
    pieces = []
    for k, (size, n) in enumerate(zip(sizes, counts, strict=True)):
        n, part = min(n, budget // size if size else 0), 1
        while n > 0:
            take = min(part, n)
            pieces.append((k, take, take * size))
            n -= take
            part *= 2
    reach, mask, last = 1, (1 << (budget + 1)) - 1, {}
    for j, (_, _, words) in enumerate(pieces):
        new = (reach << words) & mask & ~reach
        reach |= new
        while new:
            low = new & -new
            last[low.bit_length() - 1] = j
            new ^= low
        if reach >> budget & 1:
            break
    taken, at = [0] * len(sizes), reach.bit_length() - 1
    while at:
        k, n, words = pieces[last[at]]
        taken[k] += n
        at -= words
    return taken


def fit_counts(sizes: Sequence[int], counts: Sequence[int], target: float, seed: int = 0) -> tuple[int, list[int]]:
    """(whole passes, extra documents of each size) so that the words taken come near ``target``."""
    total = sum(s * n for s, n in zip(sizes, counts, strict=True))
    goal = round(target)
    passes = goal // total if total else 0
    left = goal - passes * total
    if not left:
        return passes, [0] * len(sizes)
    extra = [left * n // total if s else 0 for s, n in zip(sizes, counts, strict=True)]
    left -= sum(s * n for s, n in zip(sizes, extra, strict=True))
    order = list(range(len(sizes)))
    random.Random(seed).shuffle(order)
    while left > DP_WORDS:
        before = left
        for k in order:
            n = min(counts[k] - extra[k], 1, (left - DP_WORDS // 2) // sizes[k] if sizes[k] else 0)
            if n > 0:
                extra[k] += n
                left -= n * sizes[k]
        if left == before:  # only documents above the rest are left: the largest that fits
            k = max((k for k in order if counts[k] > extra[k] and 0 < sizes[k] <= left), key=lambda k: sizes[k], default=None)
            if k is None:
                break
            extra[k] += 1
            left -= sizes[k]
    more = knapsack(sizes, [n - e for n, e in zip(counts, extra, strict=True)], min(left, DP_WORDS))
    return passes, [a + b for a, b in zip(extra, more, strict=True)]


def targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """``target`` of each row (source, source_size): weights in code point order of the source, null last.

    The budget is ``share`` of all sizes. With every target at most ``cap`` sizes
    and the excess shared anew by weight, the targets are min(cap * size, level *
    weight) for one level; the sources whose cap lies lowest per weight are full.
    The frame has one row for each source.
    """
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(ranked) - 1) % len(weights) + 1)
    full = F.col("source_size") * F.lit(float(cap))
    by_level = Window.orderBy("_at", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    return (
        sources.withColumn("_weight", weight).withColumn("_full", full).withColumn("_at", F.col("_full") / F.col("_weight"))
        .withColumn("_budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("_level", (F.col("_budget") - F.coalesce(F.sum("_full").over(before), F.lit(0.0)))
                    / (F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))))
        # The first source whose cap is above the level then reached fixes the level of all above it.
        .withColumn("_open", F.min(F.when(F.col("_level") <= F.col("_at"), F.struct("_at", "_level"))).over(every))
        .withColumn("target", F.least("_full", F.coalesce(F.col("_open._level") * F.col("_weight"), F.col("_full"))))
        .select("source", "source_size", "target")
    )


def mix(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    ``size`` is the number of words of the text; null and empty texts have none
    and are taken only in whole passes, with 0 words. Repeated rows are documents of
    their own; null sources form one source; ties of the seeded hash go by doc_id.
    Other columns of ``docs`` take no part. An empty table gives no rows.
    """
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(per_source, weights, share, cap)
    histogram = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size", kind="stable")
        passes, extra = fit_counts(frame["size"].tolist(), frame["n"].tolist(), float(frame["target"].iloc[0]), seed)
        return frame.assign(passes=passes, extra=extra)[["source", "size", "n", "source_size", "target", "passes", "extra"]]

    joined = histogram.alias("h").join(goals.alias("g"), F.col("h.source").eqNullSafe(F.col("g.source"))).select("h.*", "source_size", "target")
    plan = written(
        joined.groupBy("source").applyInPandas(
            fit, "source string, size long, n long, source_size long, target double, passes long, extra long"
        ),
        "mix-plan",
    )
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"))
    sliced = (
        sized.alias("d")
        .join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size")))
        .select("d.*", "n", "source_size", "target", "passes", "extra", draw.alias("_draw"))
        .withColumn("_slice", F.pmod(F.col("_draw"), F.ceil(F.col("n") / SLICE)))
    )
    key = ["source", "size"]
    fill = sliced.groupBy(*key, "_slice").agg(F.count(F.lit(1)).alias("_in")).withColumn(
        "_before",
        F.coalesce(F.sum("_in").over(Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    f = fill.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("_slice").alias("_k"), "_before")
    rank = F.row_number().over(Window.partitionBy(*key, "_slice").orderBy("_draw", "doc_id"))
    return (
        sliced.join(f, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("_slice") == F.col("_k")))
        .withColumn("copies", F.col("passes") + (F.col("_before") + rank <= F.col("extra")).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix takes them: each row as often as ``mix`` says, columns unchanged."""
    size, copies, rows, t_id, t_source, t_size, copy = (
        free_name(docs, c) for c in ("_size", "_copies", "_rows", "_mix_id", "_mix_source", "_mix_size", "_copy")
    )
    taken = mix(docs, **options).groupBy(F.col("doc_id").alias(t_id), F.col("source").alias(t_source), F.col("size").alias(t_size)).agg(
        F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows)
    )
    sized = docs.withColumn(size, word_count(F.col("text")))
    same = sized["doc_id"].eqNullSafe(F.col(t_id)) & sized["source"].eqNullSafe(F.col(t_source)) & (F.col(size) == F.col(t_size))
    # Rows that repeat an id share its copies, in an order that their texts set.
    nth = F.row_number().over(Window.partitionBy("doc_id", "source", size).orderBy(F.xxhash64("text")))
    own = F.floor(F.col(copies) / F.col(rows)) + (nth <= F.col(copies) % F.col(rows)).cast("long")
    return (
        sized.join(taken, same).withColumn(copies, own)
        .withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.when(F.col(copies) > 0, F.col(copies)))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
