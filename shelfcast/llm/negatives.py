"""Hard negatives by exact integer scores: products modulo small primes, put together by Chinese remaindering.

1. Vectors become whole numbers, floor(256 * x). Rows are dealt to blocks of about
   ``ROWS`` by a hash of the id, anchors to chunks of ``ANCHORS``; each block meets each chunk
   in one group, so neither side is ever held whole.
2. A score is an inner product. Both matrices are reduced modulo each of several
   primes, centred on 0, and multiplied in float32: the primes are small enough that no sum
   in a product passes 2**24, so each is exact. There are as many primes as the largest
   possible score needs, and mixed-radix digits (Garner) give the signed scores back.
3. Positives: the best rows of the anchor's own label, block by block, then the best of these over all
   blocks by a window.
4. Negatives: a positive's score fixes a window of scores. A block's scores are sorted once for an
   anchor, and each window is a range of them; the best of the blocks' bests are taken again by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, written

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these percentages of its positive's.
LEAST, MOST = 30, 90
#: Vectors of a block, anchors of a chunk, and anchors whose scores a task holds at once.
ROWS, ANCHORS, AT_ONCE = 8192, 4096, 256
#: Dimensions that one product sums over; longer vectors are summed in slices.
SLICE = 1024
_LONG = 1 << 63
_LOW = np.iinfo(np.int64).min


def primes_for(width: int, largest: int) -> list[int]:
    """Primes, descending, for vectors of ``width`` numbers whose scores are at most ``largest`` either way.

    Centred residues are at most (p - 1) / 2, so ``width`` products of them sum to no more than 2**24. The
    product of the primes is above four times ``largest``.
    """
    half = int((2**24 / max(1, min(width, SLICE))) ** 0.5)
    found, product, p = [], 1, 2 * min(half, 1 << 11) + 1
    while product <= 4 * largest + 4:
        if p < 3:
            raise ValueError("scores too large for the primes at hand")
        if all(p % d for d in range(2, int(p**0.5) + 1)):
            found.append(p)
            product *= p
        p -= 2
    return found


def centred(values: np.ndarray, p: int) -> np.ndarray:
    """Whole numbers in doubles as residues from -(p - 1) / 2 to (p - 1) / 2, in float32."""
    r = np.fmod(values, p)
    r[r > p // 2] -= p
    r[r < -(p // 2)] += p
    return r.astype(np.float32)


def residues_of_products(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p (float32, about centred)."""
    out = None
    for at in range(0, max(1, a.shape[1]), SLICE):
        part = centred(a[:, at:at + SLICE], p) @ centred(b[:, at:at + SLICE], p).T
        part -= np.rint(part * np.float32(1 / p)) * np.float32(p)
        if out is not None:
            part += out
            part -= np.rint(part * np.float32(1 / p)) * np.float32(p)
        out = part
    return out


def reconstruct(residues: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The numbers within half the primes' product either way that have these residues: int64, or Python's where it could overflow."""
    whole = 1
    for p in primes:
        whole *= p
    if whole < 1 << 46:  # every step is exact in doubles
        x, done = residues[0].astype(np.float64), primes[0]
        for r, p in zip(residues[1:], primes[1:], strict=True):
            digit = r - x
            digit -= np.rint(digit / p) * p
            digit *= pow(done, -1, p)
            digit -= np.rint(digit / p) * p
            x += digit * done
            done *= p
        return x.astype(np.int64)
    x, done = np.rint(residues[0]).astype(np.int64).astype(object), primes[0]
    for r, p in zip(residues[1:], primes[1:], strict=True):
        digit = (np.rint(r).astype(np.int64).astype(object) - x) * pow(done, -1, p) % p
        x = x + np.where(digit > p // 2, digit - p, digit) * done
        done *= p
    return np.clip(x, -_LONG, _LONG - 1)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` and ``b``; those beyond a long are held at its ends."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    width = a.shape[1]
    largest = width * int(np.abs(a).max()) * int(np.abs(b).max())
    norms = [np.sqrt((m**2).sum(1)).max() for m in (a, b)] if largest < 1 << 100 else [np.inf]
    if np.isfinite(norms).all():
        largest = min(largest, int(norms[0] * norms[1] * (1 + 1e-9)) + 1)  # Cauchy and Schwarz
    primes = primes_for(width, largest)
    return reconstruct([residues_of_products(a, b, p) for p in primes], primes)


def sort_keys(score: np.ndarray) -> np.ndarray:
    """int64 keys, distinct in a row, that order columns by score and equal scores with the first column above.

    The column is the last column's number less ``key % columns``.
    """
    n = score.shape[1]
    if score.dtype == object or np.abs(score).max(initial=0) >= (1 << 62) // max(1, n):
        score = np.unique(score, return_inverse=True)[1].reshape(score.shape).astype(np.int64)
    return score * n + np.arange(n - 1, -1, -1)


def _matrix(rows: list[bytes], width: int = 0) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    own = [np.frombuffer(r, np.float64) for r in rows]
    out = np.zeros((len(own), max([width, *map(len, own)])))
    for k, v in enumerate(own):
        out[k, : len(v)] = v
    return out


def whole_vectors(embeddings: DataFrame, label: Column) -> DataFrame:
    """vec_id, label and the vector floor(256 * x) as packed doubles, one row per vec_id."""
    good = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < float("inf"))
    )
    rows = embeddings.where(good & F.col("vec_id").isNotNull() & F.col("label").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")
    ).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors = [np.floor(SCALE * np.array(v, np.float64)).tobytes() for v in batch.column("embedding").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(vectors, pa.binary())], names=["vec_id", "label", "vector"])

    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", T.LongType()), T.StructField("vector", T.BinaryType())])
    return map_batches(rows.select("vec_id", "r.label", "r.embedding"), run, schema)


def _numbers(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def _meet(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, fn, schema: str) -> DataFrame:
    """``fn(block of rows, chunk of anchors)`` over all blocks and chunks. A row travels once for each
    chunk of ``ANCHORS`` anchors, an anchor once for each block of ``ROWS`` rows."""
    blocks, chunks = max(1, -(-n_rows // ROWS)), max(1, -(-n_anchors // ANCHORS))
    dealt = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(n)).cast("long")
    left = rows.select("*", dealt(blocks, 1).alias("block"), _numbers(chunks).alias("chunk"))
    right = anchors.select("*", dealt(chunks, 2).alias("chunk"), _numbers(blocks).alias("block"))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-blocks * chunks // 4))

    def run(key, data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(asked):
            return pd.DataFrame(columns=names, dtype="int64")
        data, asked = data.sort_values("vec_id"), asked.sort_values("vec_id")
        x = _matrix(data["vector"].tolist())
        a = _matrix(asked["vector"].tolist(), x.shape[1])
        x = np.pad(x, ((0, 0), (0, a.shape[1] - x.shape[1])))
        found = [out for at in range(0, len(a), AT_ONCE) for out in fn(data, x, asked.iloc[at:at + AT_ONCE], a[at:at + AT_ONCE])]
        return pd.DataFrame({c: np.concatenate([f[k] for f in found]) for k, c in enumerate(names)}, dtype="int64") if found else pd.DataFrame(columns=names, dtype="int64")

    names = [part.split()[0] for part in schema.split(", ")]
    by = ["block", "chunk"]
    return left.repartition(tasks, *by).groupBy(*by).cogroup(right.repartition(tasks, *by).groupBy(*by)).applyInPandas(run, schema)


def _best(found: DataFrame, per: list[str], score: str, then: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*per).orderBy(F.desc(score), then))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def positives(vectors: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, k: int = POSITIVES) -> DataFrame:
    """anchor_id, positive_id, positive_score, rank: the ``k`` best other rows of each anchor's label."""

    def of_block(data, x, asked, a) -> Iterator[tuple]:
        ids, labels, own = data["vec_id"].to_numpy(), data["label"].to_numpy(), asked["label"].to_numpy()
        for label in np.unique(own):
            some, rows = np.flatnonzero(labels == label), np.flatnonzero(own == label)
            if not len(some):
                continue
            score, anchor = scores(a[rows], x[some]), asked["vec_id"].to_numpy()[rows]
            keys = sort_keys(score)
            keys[anchor[:, None] == ids[some]] = _LOW
            n = len(some)
            top = np.partition(keys, max(0, n - k), axis=1)[:, max(0, n - k):]
            row, place = np.nonzero(top != _LOW)
            column = n - 1 - top[row, place] % n
            yield anchor[row], ids[some][column], score[row, column].astype(np.int64)

    found = _meet(vectors, anchors, n_rows, n_anchors, of_block, "anchor_id long, positive_id long, positive_score long")
    return _best(found, ["anchor_id"], "positive_score", "positive_id", k)


def window_of(score: int, least: int = LEAST, most: int = MOST) -> tuple[int, int]:
    """The smallest and largest whole score from ``least`` to ``most`` percent of ``score``."""
    return -(-least * score // 100), most * score // 100


def negatives_of(score: np.ndarray, other: np.ndarray, bounds: list[list[tuple[int, int]]], k: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(anchor, window, columns, best first): the ``k`` best columns within each window of an anchor, of those that ``other`` marks."""
    n = score.shape[1]
    keys = sort_keys(score)
    keys[~other] = _LOW
    keys.sort(axis=1)
    for i, windows in enumerate(bounds):
        row = keys[i]
        columns = n - 1 - row % n
        values = score[i, columns]
        first = int(np.searchsorted(row, _LOW, side="right"))
        for j, (low, high) in enumerate(windows):
            end = first + int(np.searchsorted(values[first:], high, side="right"))
            begin = first + int(np.searchsorted(values[first:], low, side="left"))
            if begin < end:
                yield i, j, columns[max(begin, end - k):end][::-1]


def hard_negatives(embeddings: DataFrame, asked: Column, label: Column | None = None, n_positives: int = POSITIVES,
                   n_negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows that ``asked`` (of vec_id) picks; ``label`` (of vec_id and label) stands for the label, if given.
    An anchor's positives are its ``n_positives`` best other rows of the same label; for each, the ``n_negatives`` best rows
    of another label whose score is from ``least`` to ``most`` percent of the positive's are returned, all if fewer; a
    positive with a negative score has none. Scores are inner products of floor(256 * x); ties go to the smaller vec_id.

    Rows without vec_id, label or vector, and vectors that hold a null or a number that is not finite, or not when times 256, take
    no part. Rows that repeat a vec_id count once, with the smallest label, then vector. Of vectors of
    different length the shorter is filled up with zeros. Scores beyond a long are held at its ends. Other
    columns take no part; an empty table gives no rows.
    """
    vectors = written(whole_vectors(embeddings, F.col("label") if label is None else label), "vectors")
    anchors = written(vectors.where(asked), "anchors")
    n_rows, n_anchors = vectors.count(), anchors.count()
    pairs = written(positives(vectors, anchors, n_rows, n_anchors, n_positives), "positives")
    listed = pairs.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    with_positives = anchors.join(listed, "vec_id")

    def of_block(data, x, asked_rows, a) -> Iterator[tuple]:
        ids, labels, own = data["vec_id"].to_numpy(), data["label"].to_numpy(), asked_rows["label"].to_numpy()
        targets = [[(int(p["positive_id"]), int(p["positive_score"])) for p in row] for row in asked_rows["positives"]]
        bounds = [[window_of(s, least, most) for _, s in row] for row in targets]
        score, anchor = scores(a, x), asked_rows["vec_id"].to_numpy()
        for i, j, columns in negatives_of(score, own[:, None] != labels, bounds, n_negatives):
            positive, its_score = targets[i][j]
            one = np.ones(len(columns), np.int64)
            yield anchor[i] * one, positive * one, ids[columns], its_score * one, score[i, columns].astype(np.int64)

    schema = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    found = _meet(vectors, with_positives, n_rows, n_anchors, of_block, schema)
    best = _best(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", n_negatives)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label)


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same, CAST(list_inner_product(a.e, o.e) AS BIGINT) AS score
  FROM v a JOIN v o ON a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0
),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE p.k <= {POSITIVES} AND {LEAST} * p.score <= 100 * s.score AND 100 * s.score <= {MOST} * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
