"""N-gram Jaccard join with signature trees.

Documents with equal shingle sets form one class; its smallest id stands for it. Bands of
minimum hashes bring classes into loose groups (a pair at the threshold of 0.8 meets in
none of the 64 bands of four with a chance below 3e-15), and within a group:

1. A block of documents becomes a signature tree. A leaf is a document: a bitmap with a bit set for every
   shingle, by its hash, and the number of shingles that share a bit with another one (``excess``). A node above
   has the OR of its children's bitmaps, the range of their set sizes and their largest excess. Leaves with like smallest
   hashes are side by side.
2. Two trees, or one with itself, are descended together, a level at a time. No two documents below a pair of nodes share more than
   the bits that both bitmaps have plus the smaller excess; a pair that cannot reach the threshold at its smallest
   sizes is left, as is one whose sizes are too far apart.
3. Pairs of leaves that remain, and are not joined yet, are compared by their full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, mix64, utf8, written
from .links import Forest, components, linked_components, links
from .neardup import Shingler

THRESHOLD, WORDS = 80, 5
FAN_OUT = 4
#: Bits of a bitmap: a power of two, four for each shingle of the largest set, within these bounds.
LEAST_BITS, MOST_BITS = 256, 1 << 16
BANDS, BAND = 64, 4
_AT_ONCE = 1 << 20  # 64-bit words that one array pass over pairs of nodes reads
_SPLIT = 1 << 13

_FACTORS = mix64(np.arange(1001, 1001 + BANDS * BAND // 2, dtype=np.uint64)) | np.uint64(1)


class SignatureTree:
    """Levels of nodes, leaves first; node k of a level covers the nodes from FAN_OUT * k of the one below."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.order = sorted(range(len(sets)), key=lambda k: sets[k][:3].tolist())
        own = [sets[k] for k in self.order]
        flags = np.zeros((len(own), bits), bool)
        shift = np.uint64(64 - bits.bit_length() + 1)
        for row, s in zip(flags, own, strict=True):
            row[(s >> shift).astype(np.int64)] = True
        size = np.array([len(s) for s in own])
        bitmap = np.packbits(flags, axis=1).view(np.uint64)
        self.levels = [(bitmap, size, size, size - flags.sum(1))]
        while len(self.levels[-1][0]) > 1:
            bitmap, low, high, excess = self.levels[-1]
            at = np.arange(0, len(bitmap), FAN_OUT)
            self.levels.append((np.bitwise_or.reduceat(bitmap, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at)))


def possible(x: tuple, i: np.ndarray, y: tuple, j: np.ndarray, threshold: int) -> np.ndarray:
    """Whether some document below node i and some below node j can reach the threshold, for each pair."""
    ok = (100 * x[2][i] >= threshold * y[1][j]) & (100 * y[2][j] >= threshold * x[1][i])
    at = np.flatnonzero(ok)
    step = max(1, _AT_ONCE // x[0].shape[1])
    for k in range(0, len(at), step):
        part = at[k:k + step]
        a, b = i[part], j[part]
        most = np.bitwise_count(x[0][a] & y[0][b]).sum(1, dtype=np.int64) + np.minimum(x[3][a], y[3][b])
        most = np.minimum(most, np.minimum(x[2][a], y[2][b]))
        ok[part] = (100 + threshold) * most >= threshold * (x[1][a] + y[1][b])
    return ok


def candidates(left: SignatureTree, right: SignatureTree | None, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves that the bounds leave, as places in the two lists (in one, if ``right`` is None: first < second in the tree's order)."""
    other = right or left
    a, b = len(left.levels) - 1, len(other.levels) - 1
    i = j = np.zeros(1, np.int64)
    while True:
        kept = possible(left.levels[a], i, other.levels[b], j, threshold)
        i, j = i[kept], j[kept]
        if not a and not b:
            break
        for side in (0, 1):
            if (a, b)[side]:
                level = (left.levels, other.levels)[side][(a, b)[side] - 1]
                near, far = (i, j) if side == 0 else (j, i)
                kids = (near[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
                far = np.repeat(far, FAN_OUT)
                inside = kids < len(level[0])
                i, j = (kids[inside], far[inside]) if side == 0 else (far[inside], kids[inside])
        a, b = max(0, a - 1), max(0, b - 1)
        if right is None:
            upper = i <= j
            i, j = i[upper], j[upper]
    if right is None:
        i, j = i[i < j], j[i < j]
    return np.array(left.order, np.int64)[i], np.array(other.order, np.int64)[j]


def linked_by_trees(sets: list[np.ndarray], others: list[np.ndarray] | None, threshold: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= threshold * union, by dual traversal."""
    largest = max(map(len, [*sets, *(others or [])]))
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (4 * largest - 1).bit_length()))
    left = SignatureTree(sets, bits)
    i, j = candidates(left, SignatureTree(others, bits) if others is not None else None, threshold)
    forest, shift, to, out = Forest(len(sets) + len(others or [])), len(sets) if others is not None else 0, others if others is not None else sets, []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        if forest.root(x) != forest.root(y + shift) and links(sets[x], to[y], threshold):
            forest.join(x, y + shift)
            out.append((x, y))
    return out


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """Keys of the bands over the smallest and the largest hash under each multiplier."""
    low, high = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(_FACTORS), np.uint64)
    for at in range(0, len(shingles), _SPLIT):
        hashes = np.multiply.outer(_FACTORS, shingles[at:at + _SPLIT])
        np.minimum(low, hashes.min(1), out=low)
        np.maximum(high, hashes.max(1), out=high)
    rows = np.concatenate((low, high)).reshape(BANDS, BAND)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(BAND):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return h.view(np.int64)


_SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("key1", T.LongType()),
                        T.StructField("key2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """Set size, a 128-bit key of the set and the band keys of every document."""
    shingle = Shingler(words)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle(t) for t in utf8(batch.column("text"))]
        keys = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets])
        bands = [band_keys(s) if len(s) else np.zeros(0, np.int64) for s in sets]
        ends = np.concatenate(([0], np.cumsum([len(b) for b in bands])))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(bands), pa.int64()))], names=_SIGNED.names)

    return map_batches(docs.select("doc_id", "text"), run, _SIGNED)


def jaccard_join(docs: DataFrame, threshold: int = THRESHOLD, words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Two documents link when 100 * intersection >= ``threshold`` (at least 80, for which the bands are laid out) * union of their sets of
    ``words``-word shingles; A-Z count as a-z. ``component_id`` is the smallest doc_id reachable by links. Texts with fewer words have one
    shingle, the whole sequence; null and empty texts have none and stand alone. Repeated rows
    are repeated in the result; a null doc_id links with nothing (component_id null). Columns other than
    doc_id and text take no part; an empty table gives no rows.
    """
    signed = written(_signed(docs, words), "signed")
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # A table of its own, so that no join takes over the partitions of this sum, where all copies of a text meet.
    classes = written(full.groupBy("key1", "key2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = full.join(classes.select(F.col("rep").alias("doc_id"), "key1", "key2"), ["doc_id", "key1", "key2"], "left_semi")
    reps = written(reps.dropDuplicates(["doc_id", "key1", "key2"]), "representatives")
    bands = reps.select("doc_id", F.explode("bands").alias("band"))
    low = bands.groupBy("band").agg(F.min("doc_id").alias("v"), F.max("doc_id").alias("top")).where("v < top").drop("top")
    loose = components(bands.join(low, "band").select(F.col("doc_id").alias("u"), "v"))
    roots = loose.select("root").distinct().select(F.col("root").alias("node"), "root")
    members = loose.unionByName(roots).withColumnRenamed("node", "doc_id").join(reps.drop("bands"), "doc_id")
    parts = linked_components(docs, members, threshold, Shingler(words), linked_by_trees)
    of_class = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("key1", "key2", F.coalesce("root", "rep").alias("_component"))
    return signed.select("doc_id", "n_shingles", "key1", "key2").join(of_class, ["key1", "key2"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("_component"))).otherwise(F.col("doc_id")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[p:p + {WORDS - 1}], ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {WORDS - 2}, 2))) AS p FROM w WHERE len(ws) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT u, v FROM (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL)
  JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * common >= {THRESHOLD} * (x.n + y.n - common)
),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.u, r.c FROM r JOIN e ON e.v = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id
FROM w JOIN m ON m.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
