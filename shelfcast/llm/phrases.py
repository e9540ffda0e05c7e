"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases: from the end of the last phrase, the
shortest run of code points that is no phrase yet becomes one. The set of phrases is
hashed, and the minima of the hashes under ``VALUES`` permutations are the
fingerprint. The share of equal minima estimates the Jaccard likeness of two phrase
sets, which is high for texts that a compressor would find alike.

The parse of a text's beginning doesn't depend on its end. So a text whose end
was replaced goes on from the state that the original had reached there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Rolling, mix64, spread, utf8, written

VALUES = 64
_FACTORS = mix64(np.arange(1, VALUES + 1, dtype=np.uint64) << np.uint64(20)) | np.uint64(1)
_SPLIT = 1 << 14
PER_TASK = 20_000  # documents


def _parse(text: str, seen: set[str], phrase: str, at: int, ends: list[int]) -> str:
    """Parse on; ``ends`` gets where each new phrase ends, counted from ``at``. Returns the phrase left open."""
    add, end = seen.add, ends.append
    for i, c in enumerate(text, at + 1):
        phrase += c
        if phrase not in seen:
            add(phrase)
            end(i)
            phrase = ""
    return phrase


class PhraseFingerprint:
    """Fingerprints of texts; holds the tables of powers for its hashes."""

    def __init__(self):
        self.rolling = Rolling(0xA24BAED4963EE407)

    def _minima(self, points: np.ndarray, ends: list[int], start: int) -> np.ndarray:
        """Smallest 64-bit values of the phrases that end at ``ends``; the first begins at ``start``."""
        stop = np.array(ends, np.int64)
        hashes = self.rolling.spans(points, np.concatenate(([start], stop[:-1]))[: len(stop)].astype(np.int64), stop)
        low = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
        for k in range(0, len(hashes), _SPLIT):
            np.minimum(low, np.multiply.outer(_FACTORS, hashes[k:k + _SPLIT]).min(1), out=low)
        return low

    @staticmethod
    def _points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)

    def __call__(self, text: str, keep: int | None = None, tail: str = "") -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of ``text`` and of its first ``keep`` code points followed by ``tail``, as 16-bit values."""
        keep = len(text) if keep is None else keep
        seen: set[str] = set()
        ends: list[int] = []
        phrase = _parse(text[:keep], seen, "", 0, ends)
        last = ends[-1] if ends else 0
        points = self._points(text)
        shared = self._minima(points, ends, 0)
        other, seen_other = shared, seen.copy()
        own: list[int] = []
        _parse(text[keep:], seen, phrase, keep, own)
        mine = np.minimum(shared, self._minima(points, own, last))
        if tail:
            new: list[int] = []
            _parse(tail, seen_other, phrase, keep, new)
            other = np.minimum(shared, self._minima(self._points(text[:keep] + tail), new, last))
        return mix64(mine).astype(np.uint16), mix64(other).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def to_hex(values: np.ndarray) -> str:
    return values.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> tuple[int, str]:
    """(code points kept, replacement): the last half of ``text`` gives way to as much of ``following``, or all of it."""
    half = len(text) // 2
    return len(text) - half, following[:half]


_ROW = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
])
#: A task's first and last text come with its number, for the neighbours.
_OUT = T.StructType([*_ROW.fields, T.StructField("part", T.IntegerType()), T.StructField("first_text", T.StringType()),
                     T.StructField("last_text", T.StringType())])


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields])


def _finish(maker: PhraseFingerprint, doc_id: int, text: str, following: str) -> tuple:
    """A row but for near_next, and the fingerprint."""
    keep, tail = edited(text, following)
    mine, other = maker(text, keep, tail)
    digest = hashlib.sha256((text[:keep] + tail).encode()).hexdigest()
    return (doc_id, len(text), digest, to_hex(mine), to_hex(other), likeness(mine, other)), mine


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the next in the order of (doc_id, text), nulls first;
    after the last comes the first, so a single document is its own next. Null texts count
    as empty; an empty text has no phrases, and two such fingerprints are alike
    (1.0). Repeated rows are documents of their own. Columns other than doc_id
    and text take no part.

    The texts are shuffled once, by ranges of doc_id, and streamed in order; a task
    passes on its first and last text, and those few neighbours are joined afterwards.
    """
    schema = _arrow(_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, part = PhraseFingerprint(), TaskContext.get().partitionId()
        held: tuple[int, str] | None = None  # waits for its next document
        before = None  # row and fingerprint that wait for near_next
        for batch in batches:
            rows = []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
                text = raw.decode()
                if held is None:
                    rows.append((doc_id, *[None] * 6, part, text, None))
                else:
                    row, mine = _finish(maker, *held, text)
                    if before:
                        rows.append((*before[0], likeness(before[1], mine), None, None, None))
                    before = row, mine
                held = doc_id, text
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if held:
            rows = [(held[0], *[None] * 6, part, None, held[1])]
            if before:
                last, _ = maker(held[1])
                rows.append((*before[0], likeness(before[1], last), None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(spread(docs.select("doc_id"), PER_TASK), "doc_id").sortWithinPartitions("doc_id", "text")
    out = written(ordered.mapInArrow(run, _OUT), "phrases")
    firsts = out.where("first_text IS NOT NULL").select("part", "first_text")
    lasts = out.where("last_text IS NOT NULL").select("doc_id", "part", "last_text")
    # One row for each task: which task's first text follows.
    numbers = firsts.select("part")
    every = Window.partitionBy(F.lit(0))
    follows = numbers.select("part", F.coalesce(F.lead("part").over(Window.partitionBy(F.lit(0)).orderBy("part")), F.min("part").over(every)).alias("next"))
    edge = lasts.join(follows, "part").join(firsts.withColumnRenamed("part", "next"), "next").select("doc_id", "last_text", "first_text")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, kind = PhraseFingerprint(), _arrow(_ROW)
        for batch in batches:
            rows = []
            for doc_id, text, following in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "last_text", "first_text")), strict=True):
                row, mine = _finish(maker, doc_id, text, following)
                rows.append((*row, likeness(mine, maker(following)[0])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    return out.where("part IS NULL").select(*_ROW.names).unionByName(edge.mapInArrow(close, _ROW))


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
