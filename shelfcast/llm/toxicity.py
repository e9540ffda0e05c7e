"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams and itself, hashed into buckets, so a
misspelling never seen shares most of its vectors with the word it imitates.
The vectors of the bag are averaged and a two-class softmax is put on the
average; vectors and softmax are trained jointly in numpy. A document's margin
is the log-sum-exp of its words' margins, so a few words in a very long
text still count. After ``warm`` epochs a document's gradient is scaled by how
likely the model holds its label (generalised cross entropy), so that wrong
labels are not learned by heart.

Training reads a bounded sample of labelled rows on the driver
(``TRAIN_DOCS``, ``TRAIN_BYTES``); scoring reads every whole text in Arrow batches.
With the vectors fixed, a word's margin is the mean of one number per subword, so
a task needs one float for each bucket, not the vectors.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, map_batches, mix64, utf8

#: Bound of the training sample: labelled documents of each class, by a seeded hash of the id.
TRAIN_DOCS = 2048
#: Longest total of training text in bytes; documents beyond it are left out of the sample whole.
TRAIN_BYTES = 32 << 20
GRAMS = (3, 4, 5)
BUCKETS = 1 << 17
DIM = 8
FOLDS, HELD_OUT = 5, 0
_CACHE_WORDS, _CACHE_BYTES = 400_000, 64


def subwords(words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every subword, word by word; number of subwords of each word)."""
    marked = b"".join(b"<" + w + b">" for w in words)
    raw = np.frombuffer(marked, np.uint8).astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = ends[owner] - np.arange(len(raw))  # bytes from here to the word's end
    hashes, owners = [], []
    h = np.zeros(len(raw), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, min(max(GRAMS), len(raw)) + 1):
            h[: len(raw) - n + 1] = h[: len(raw) - n + 1] * np.uint64(257) + raw[n - 1:]
            if n in GRAMS:
                at = np.flatnonzero(left >= n)
                hashes.append(mix64(h[at] + np.uint64(n << 56)))
                owners.append(owner[at])
    hashes.append(np.fromiter((zlib.crc32(w) | 1 << 40 for w in words), np.uint64, len(words)))
    owners.append(np.arange(len(words)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    buckets = (mix64(np.concatenate(hashes)) % np.uint64(BUCKETS)).astype(np.int64)[order]
    return buckets, np.bincount(owner, minlength=len(words))


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)


@dataclass
class ToxicityModel:
    """One margin for each bucket (softmax weights times vectors) and the bias."""

    margins: np.ndarray
    bias: float
    constant: bool = False  # trained without rows of both classes: every text has the bias as its margin

    def word_margins(self, words: Sequence[bytes]) -> np.ndarray:
        buckets, counts = subwords(words)
        return np.add.reduceat(self.margins[buckets], _starts(counts)) / counts

    def scorer(self):
        """A function from whole texts to scores; known words are kept in a bounded cache."""
        cache: dict[bytes, float] = {}

        def score(texts: Sequence[bytes]) -> np.ndarray:
            out = np.empty(len(texts))
            for i, text in enumerate(texts):
                words = text.lower().split()
                values = list(map(cache.get, words))
                if None in values:
                    new = list({w for w, v in zip(words, values, strict=True) if v is None})
                    fresh: dict[bytes, float] = {}
                    for k in range(0, len(new), 20_000):
                        part = new[k:k + 20_000]
                        fresh.update(zip(part, self.word_margins(part).tolist(), strict=True))
                    if len(cache) + len(fresh) > _CACHE_WORDS:
                        cache.clear()
                    cache.update((w, v) for w, v in fresh.items() if len(w) <= _CACHE_BYTES)
                    values = [fresh[w] if v is None else v for w, v in zip(words, values, strict=True)]
                out[i] = self.margin(np.array(values))
            return 1 / (1 + np.exp(-np.clip(out, -60, 60)))

        return score

    def margin(self, words: np.ndarray) -> float:
        """Log-sum-exp of the words' margins; the bias alone without words."""
        if self.constant or not len(words):
            return self.bias
        top = words.max()
        return float(top + np.log(np.exp(words - top).sum()) + self.bias)


def train(texts: Sequence[bytes], toxic: Sequence[int], weights: Sequence[float] | None = None, dim: int = DIM,
          epochs: int = 5, warm: int = 2, robust: float = 0.7, batch: int = 64, rate: float = 0.3,
          seed: int = 5) -> ToxicityModel:
    """Vectors and softmax by Adagrad on the documents' log loss.

    Without rows of both classes the model is constant: the share of toxic
    rows, or a very small score without any row.
    """
    y = np.asarray(toxic, np.float64)
    share = y.mean() if len(y) else 0.0
    if not 0 < share < 1:
        return ToxicityModel(np.zeros(BUCKETS), float(np.log((share + 1e-3) / (1 - share + 1e-3))), constant=True)
    weight = np.ones(len(y)) if weights is None else np.asarray(weights, np.float64)
    rng = np.random.default_rng(seed)
    vectors = (rng.random((BUCKETS, dim)) - 0.5) / dim
    softmax = (rng.random((dim, 2)) - 0.5) * 2.0
    bias = -3.0
    seen_v, seen_s, seen_b = np.full(BUCKETS, 1e-6), np.full((dim, 2), 1e-6), 1e-6
    docs = [t.lower().split() for t in texts]
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        step = rate * (1 - epoch / epochs)
        for lo in range(0, len(order), batch):
            rows = [r for r in order[lo:lo + batch] if docs[r]]
            if not rows:
                continue
            known: dict[bytes, int] = {}
            word = np.array([known.setdefault(w, len(known)) for r in rows for w in docs[r]])
            buckets, counts = subwords(list(known))
            mean = np.add.reduceat(vectors[buckets], _starts(counts)) / counts[:, None]
            direction = softmax[:, 1] - softmax[:, 0]
            z = (mean @ direction)[word]
            n_words = np.array([len(docs[r]) for r in rows])
            of, starts = np.repeat(np.arange(len(rows)), n_words), _starts(n_words)
            top = np.maximum.reduceat(z, starts)
            e = np.exp(z - top[of])
            total = np.add.reduceat(e, starts)
            p = 1 / (1 + np.exp(-np.clip(top + np.log(total) + bias, -60, 60)))
            g_doc = (p - y[rows]) * weight[rows] / len(rows)
            if epoch >= warm:
                g_doc *= np.where(y[rows] > 0, p, 1 - p) ** robust
            g_word = np.bincount(word, g_doc[of] * e / total[of], len(known))
            g_dir = mean.T @ g_word
            # Every subword's gradient is a multiple of the same direction.
            g_bucket = np.bincount(buckets, np.repeat(g_word / counts, counts), BUCKETS)
            hit = np.flatnonzero(g_bucket)
            seen_v[hit] += g_bucket[hit] ** 2 * (direction @ direction) / dim
            vectors[hit] -= step * (g_bucket[hit] / np.sqrt(seen_v[hit]))[:, None] * direction
            g_soft = np.stack([-g_dir, g_dir], 1)
            seen_s += g_soft**2
            softmax -= step * g_soft / np.sqrt(seen_s)
            g_b = g_doc.sum()
            seen_b += g_b**2
            bias -= step * g_b / np.sqrt(seen_b)
    return ToxicityModel(vectors @ (softmax[:, 1] - softmax[:, 0]), float(bias))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, text, toxic, weight) of at most ``per_class`` labelled rows of each class outside the held-out fold.

    Ids are taken in the order of a seeded hash; one whose texts would bring the total above
    ``TRAIN_BYTES`` is left out. Only ids and lengths reach the driver for that.
    ``weight`` restores the classes' shares among all labelled rows of the other folds.
    """
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != HELD_OUT)
    )
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.lit(31), "doc_id"), F.col("doc_id"), F.col("toxic")
    picked = rows.where("toxic = 1").orderBy(*order).limit(per_class).unionByName(
        rows.where("toxic = 0").orderBy(*order).limit(per_class)
    )
    length = F.octet_length(F.coalesce("text", F.lit("")))
    lengths = docs.select("doc_id", length.alias("size")).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic"))
    size, found, kept, left_out = 0, [0, 0], [0, 0], []
    for r in lengths.orderBy(*order[:2]).collect():
        fits = size + r["size"] <= TRAIN_BYTES
        if fits:
            size += r["size"]
        else:
            left_out.append(r["doc_id"])
        for k, n in enumerate((r["n"] - r["toxic"], r["toxic"])):
            found[k] += n
            kept[k] += n * fits
    if left_out:
        picked = picked.where(~F.col("doc_id").isin(left_out))
    shares = [max(1.0, sizes.get(k, 0) / per_class) * (found[k] / kept[k] if kept[k] else 1.0) for k in (0, 1)]
    weight = F.create_map(*[F.lit(x) for k in (0, 1) for x in (k, shares[k])])[F.col("toxic")]
    return docs.select("doc_id", "text").join(F.broadcast(picked.withColumn("weight", weight)), "doc_id")


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Train on the bounded sample; rows in the order of (doc_id, text), so that reruns agree."""
    rows = sorted((r["doc_id"], (r["text"] or "").encode(), r["toxic"], r["weight"])
                  for r in training_sample(docs, labels).toLocalIterator())
    mean = sum(w for *_, w in rows) / len(rows) if rows else 1.0
    return train([t for _, t, *_ in rows], [y for *_, y, _ in rows], [w / mean for *_, w in rows])


def _with_score(df: DataFrame, model: ToxicityModel, name: str) -> DataFrame:
    """All columns of ``df`` and the score of its text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    state: list = []  # the scorer of this Python worker, with its cache

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state.append(shared.value.scorer())
        scores = state[0](utf8(batch.column("text")))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, name])

    return map_batches(df, run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts have no words and get the model's bias as their
    score. Repeated rows get equal scores; a null doc_id is in no fold (held_out
    null). Only the text is an input; other columns take no part.
    """
    return _with_score(docs.select("doc_id", "text"), model, "score").select(
        "doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents that the model does not call toxic, columns unchanged."""
    name = free_name(docs, "_toxicity")
    return _with_score(docs, model, name).where(F.col(name) < 0.5).drop(name)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
