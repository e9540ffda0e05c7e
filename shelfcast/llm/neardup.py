"""MinHash near-dedup with min-max hashing.

Each permutation of a document's shingle hashes gives two signature values, its
minimum and its maximum, so 100 permutations give 200 values. Bands of five
values bring together documents that may be similar; at a similarity of 0.85 a
pair meets in none of the 40 bands with a chance below 1e-10 (0.8: 1.3e-7).

1. Documents with equal shingle sets form one class; only its smallest id goes on.
2. Band buckets link their members to the bucket's smallest id: loose groups,
   which contain every link.
3. Within a loose group full shingle sets are compared exactly: first all with a few
   leaders, then what these have not joined, in pairs of blocks (:mod:`links`).
4. Connected components of the links by alternating star contraction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Rolling, WordHashes, map_batches, mix64, utf8, written
from .links import Forest, components, linked_components

WORDS = 5
PERMUTATIONS, BAND = 100, 5
BANDS = 2 * PERMUTATIONS // BAND

_FACTORS = mix64(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)
_SPLIT = 1 << 14  # shingles of one array pass

SIGNATURES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()),
    T.StructField("key1", T.LongType()), T.StructField("key2", T.LongType()),
    T.StructField("bands", T.ArrayType(T.LongType())),
])


class Shingler:
    """Distinct 64-bit shingle hashes of a text, ascending; A-Z count as a-z."""

    def __init__(self, words: int = WORDS):
        self.words, self.known, self.rolling = words, WordHashes(), Rolling(0x9E3779B97F4A7C15)

    def __call__(self, text: bytes) -> np.ndarray:
        found = text.lower().split()
        if not found:
            return np.zeros(0, np.uint64)
        if len(found) < self.words:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
        return np.unique(self.rolling(self.known.array(found), self.words))


def min_max_signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum of every permutation, side by side."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), _SPLIT):
        permuted = np.multiply.outer(_FACTORS, shingles[at:at + _SPLIT])
        np.minimum(low, permuted.min(1), out=low)
        np.maximum(high, permuted.max(1), out=high)
    return np.stack([low, high], 1).ravel()


def band_hashes(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, BAND)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(BAND):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return h.view(np.int64)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Set size, a 128-bit key of the whole set and the band hashes of every document."""
    shingler = Shingler(words)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingler(t) for t in utf8(batch.column("text"))]
        keys = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets])
        bands = [band_hashes(min_max_signature(s)) if len(s) else np.zeros(0, np.int64) for s in sets]
        flat = pa.ListArray.from_arrays(
            pa.array(np.concatenate(([0], np.cumsum([len(b) for b in bands]))), pa.int32()), pa.array(np.concatenate(bands), pa.int64())
        )
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
             pa.array(keys[:, 0]), pa.array(keys[:, 1]), flat], names=SIGNATURES.names,
        )

    return map_batches(docs.select("doc_id", "text"), run, SIGNATURES)


def linked(sets: list[np.ndarray], threshold: int, across: int = 0) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= threshold * union; with ``across``, of the first so many sets with the others only.

    Intersections of all pairs are counted at once over the shingles that at
    least two sets hold. Shingles held by the same sets count as one with a weight.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    owner, flat = owner[order], flat[order]
    start = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    held = np.diff(np.append(start, len(flat)))
    many = held > 1
    column = np.repeat(np.cumsum(many) - 1, held)
    inside = np.repeat(many, held)
    row, column, wide = owner[inside], column[inside], int(many.sum())
    common = np.zeros((n, n), np.float32)
    for lo in range(0, wide, 8192):
        part = (column >= lo) & (column < lo + 8192)
        m = np.zeros((n, min(8192, wide - lo)), np.float32)
        m[row[part], column[part] - lo] = 1
        common += m @ m.T
    common = np.rint(common).astype(np.int64)
    hit = np.triu(100 * common >= threshold * (size[:, None] + size - common), 1)
    if across:
        hit[:across, :across] = hit[across:, across:] = False
    hit = np.argwhere(hit)
    forest = Forest(n)
    return [(a, b) for a, b in hit.tolist() if forest.join(a, b)]


def linked_sets(sets: list[np.ndarray], others: list[np.ndarray] | None, threshold: int) -> list[tuple[int, int]]:
    """The same within one list, or between two."""
    if others is None:
        return linked(sets, threshold)
    n = len(sets)
    return [(a, b - n) for a, b in linked([*sets, *others], threshold, n)]


def _loose_groups(signed: DataFrame) -> DataFrame:
    """(node, root) over the band buckets of the class representatives."""
    bands = signed.select("doc_id", F.explode("bands").alias("band"))
    low = bands.groupBy("band").agg(F.min("doc_id").alias("v"), F.max("doc_id").alias("top")).where("v < top").drop("top")
    return components(bands.join(low, "band").select(F.col("doc_id").alias("u"), "v"))


def near_duplicates(docs: DataFrame, threshold: int = 85, words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= ``threshold`` * union of
    their shingle sets; ``component_id`` is the smallest doc_id reachable. Texts
    with fewer than ``words`` words have one shingle, the whole sequence; null
    and empty texts have none and stand alone. Repeated rows are repeated in
    the result; a null doc_id links with nothing (component_id and kept null).
    Columns other than doc_id and text take no part.
    """
    signed = written(signatures(docs, words), "signatures")
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # A table of its own, so that no join takes over the partitions of this sum, where all copies of a text meet.
    classes = written(full.groupBy("key1", "key2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = full.join(classes.select(F.col("rep").alias("doc_id"), "key1", "key2"), ["doc_id", "key1", "key2"], "left_semi").dropDuplicates(["doc_id", "key1", "key2"])
    reps = written(reps, "representatives")
    loose = written(_loose_groups(reps), "loose")
    roots = loose.select("root").distinct().select(F.col("root").alias("node"), "root")
    members = loose.unionByName(roots).withColumnRenamed("node", "doc_id").join(reps.drop("bands"), "doc_id")
    parts = linked_components(docs, members, threshold, Shingler(words), linked_sets)
    of_class = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key1", "key2", F.coalesce("root", "rep").alias("_component")
    )
    return signed.select("doc_id", "n_shingles", "key1", "key2").join(of_class, ["key1", "key2"], "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("_component"))).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep_one(docs: DataFrame, threshold: int = 80, words: int = WORDS) -> DataFrame:
    """One document of each group of near-duplicates (its smallest id), columns unchanged.

    Repeated rows of a document that stays, and rows with a null doc_id, all stay.
    """
    result = near_duplicates(docs, threshold, words)
    gone = result.where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


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
  JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * common >= 85 * (x.n + y.n - common)
),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.u, r.c FROM r JOIN e ON e.v = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN m ON m.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
