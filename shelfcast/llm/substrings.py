"""Substring dedup by difference-cover anchors.

A word is removed when a window of ``WINDOW`` consecutive words that covers it also
starts in a document with a smaller id.

``COVER`` is a difference cover modulo ``PERIOD``: any two residues have a common
shift into the cover. So two places that share a window share an aligned anchor, a
run of ``ANCHOR`` = WINDOW - PERIOD + 1 words at a position of the cover, inside it;
only 6 of 31 positions are hashed and shuffled.

1. Documents with the same words form a class; all but its smallest id are copies
   and lose everything (if they have a window at all).
2. An anchor that occurs in two classes marks the windows around it as candidates.
3. Candidates are extended to whole windows: hashed over all their words (96
   bits), grouped for their smallest document, and flagged where that is smaller.
4. Words under flagged windows are cut.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Rolling, WordHashes, free_name, list_array, lists, map_batches, mix64, pack, unpack, utf8, written

WINDOW = 50
PERIOD = 31
#: Perfect difference set modulo 31 (fixed values of a known construction).
COVER = (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1

_WORD_AND_BLANKS = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
_LONG, _INT = T.LongType(), T.IntegerType()


class WindowHashes:
    """Hashes of anchors and windows of a list of words; one per Python worker, since it keeps a cache."""

    def __init__(self):
        self.words = WordHashes()
        self.first, self.second = Rolling(0x9E3779B97F4A7C15), Rolling(0xD6E8FEB86659FD93)

    def anchors(self, words: list[bytes]) -> np.ndarray:
        """Hashes of the runs at the positions of ``places``; none of a text without a window."""
        if len(words) < WINDOW:
            return np.zeros(0, np.uint64)
        return self.first(self.words.array(words), ANCHOR)[places(len(words))]

    def windows(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        values = self.words.array(words)
        return self.first(values, WINDOW), self.second(values, WINDOW).astype(np.uint32).view(np.int32)


def places(n_words: int) -> np.ndarray:
    """Positions of the cover at which an anchor fits."""
    at = np.arange(max(0, n_words - ANCHOR + 1))
    return at[np.isin(at % PERIOD, COVER)]


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text: together they name a row, even if ids repeat."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))


def heads(rows: DataFrame) -> DataFrame:
    """Of each document: words, a 128-bit key of its word sequence, and the digest of the words joined."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, keys, digests = [], [], []
        for text in utf8(batch.column("text")):
            words = text.split()
            joined = b" ".join(words)
            n.append(len(words))
            keys.append(np.frombuffer(xxhash.xxh3_128_digest(joined), np.int64))
            digests.append(hashlib.sha256(joined).hexdigest())
        keys = np.array(keys)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(digests)],
            names=["doc_id", "text_hash", "n_words", "key1", "key2", "sha256"],
        )

    return map_batches(rows, run, T.StructType([
        T.StructField("doc_id", _LONG), T.StructField("text_hash", _LONG), T.StructField("n_words", _LONG),
        T.StructField("key1", _LONG), T.StructField("key2", _LONG), T.StructField("sha256", T.StringType()),
    ]))


def _shared_anchors(rows: DataFrame) -> DataFrame:
    """(text_hash, place): the anchors that occur in different texts.

    An anchor that different texts of one Arrow batch share is known to be shared. Its
    places go to random keys, and only two rows stand for the batch at the anchor's
    key. So the rows of a very common anchor there grow with batches, not documents.
    """
    state = WindowHashes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = batch.column("text_hash").to_numpy()
        _, distinct = np.unique(hashes, return_index=True)
        texts = utf8(batch.column("text"))
        found = [state.anchors(texts[k].split()) for k in distinct.tolist()]
        n = [len(f) for f in found]
        anchor, place = np.concatenate(found), np.concatenate([np.arange(k, dtype=np.int32) for k in n])
        text = np.repeat(hashes[distinct], n)
        order = np.lexsort((text, anchor))
        anchor, place, text = anchor[order], place[order], text[order]
        first = np.flatnonzero(np.concatenate(([len(anchor) > 0], anchor[1:] != anchor[:-1]))[: len(anchor)])
        last = np.append(first[1:], len(anchor)) - 1 if len(first) else first
        both = text[first] != text[last]
        known = np.repeat(both, last - first + 1)
        ends = np.concatenate((first[both], last[both]))
        spread = mix64(text.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((np.where(known, spread, anchor), anchor[ends])).view(np.int64)),
             pa.array(np.concatenate((text, text[ends]))), pa.array(np.concatenate((place, np.full(len(ends), -1, np.int32)))),
             pa.array(np.concatenate((known, np.zeros(len(ends), bool))))], names=["anchor", "text_hash", "place", "known"],
        )

    anchors = map_batches(rows, run, T.StructType([
        T.StructField("anchor", _LONG), T.StructField("text_hash", _LONG), T.StructField("place", _INT), T.StructField("known", T.BooleanType()),
    ]))
    same = Window.partitionBy("anchor")
    return anchors.withColumn("low", F.min("text_hash").over(same)).withColumn("high", F.max("text_hash").over(same)).where(
        "place >= 0 AND (known OR low < high)"
    ).select("text_hash", "place")


def _candidates(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """doc_id, text_hash, packed text and ``at``, the positions of all windows that hold a shared anchor."""

    def packed(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pack(utf8(batch.column("text")))],
                                          names=["doc_id", "text_hash", "packed"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = []
        marks, ends = lists(batch.column("marked"))
        marks = marks.to_numpy()
        for k, text in enumerate(unpack(batch.column("packed"))):
            n = len(text.split())
            step = np.zeros(n + 1, np.int32)
            spots = places(n)[marks[ends[k]:ends[k + 1]]]
            np.add.at(step, np.maximum(spots - (WINDOW - ANCHOR), 0), 1)
            np.add.at(step, spots + 1, -1)
            at.append(np.flatnonzero(np.cumsum(step)[: n - WINDOW + 1] > 0).astype(np.int32))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text_hash", "packed")), list_array(at, pa.int32())],
                                          names=["doc_id", "text_hash", "packed", "at"])

    schema = T.StructType([T.StructField("doc_id", _LONG), T.StructField("text_hash", _LONG), T.StructField("packed", T.BinaryType())])
    travelling = map_batches(rows, packed, schema)
    return map_batches(travelling.join(marked, ["doc_id", "text_hash"]), run, T.StructType([*schema.fields, T.StructField("at", T.ArrayType(_INT))]))


def _windows(found: DataFrame) -> DataFrame:
    """(doc_id, at, key, h2, known) of every candidate window.

    A window that a smaller document of the same Arrow batch has too is known to go. Its
    row gets a random key, so the rows at a common window's key grow with batches.
    """
    state = WindowHashes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        first, second, n = [], [], []
        at, ends = lists(batch.column("at"))
        spots = at.to_numpy()
        for k, text in enumerate(unpack(batch.column("packed"))):
            one, two = state.windows(text.split())
            own = spots[ends[k]:ends[k + 1]]
            first.append(one[own].view(np.int64))
            second.append(two[own])
            n.append(len(own))
        doc, h1, h2 = np.repeat(batch.column("doc_id").to_numpy(), n), np.concatenate(first), np.concatenate(second)
        order = np.lexsort((doc, h2, h1))
        doc, spots, h1, h2 = doc[order], spots[order], h1[order], h2[order]
        new = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
        start = np.flatnonzero(new)
        known = doc > np.repeat(doc[start], np.diff(np.append(start, len(doc))))
        spread = mix64(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + spots.astype(np.uint64)).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (doc, spots, np.where(known, spread, h1), h2, known)], names=["doc_id", "at", "key", "h2", "known"],
        )

    return map_batches(found.where("size(at) > 0"), run, T.StructType([
        T.StructField("doc_id", _LONG), T.StructField("at", _INT), T.StructField("key", _LONG), T.StructField("h2", _INT),
        T.StructField("known", T.BooleanType()),
    ]), part=2 << 20)


def cuts(docs: DataFrame, top: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_removed, sha256 (of the kept words), removed (their positions).

    One row for every document that loses words; ``top`` is the written table of
    ``heads``. For copies, which lose all, n_removed and removed are null.
    """
    wide = top.where((F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull())
    least = wide.groupBy("key1", "key2").agg(F.min("doc_id").alias("rep"))
    ranked = wide.join(least, ["key1", "key2"])
    copies = ranked.where("doc_id > rep").select("doc_id", "text_hash").distinct()
    reps = ranked.where("doc_id = rep").select("doc_id", "text_hash").distinct()
    rows = _identified(docs).where(F.col("doc_id").isNotNull())
    marked = _shared_anchors(rows).groupBy("text_hash").agg(F.collect_set("place").alias("marked")).join(reps, "text_hash")
    found = written(_candidates(rows, marked), "candidates")
    windows = _windows(found)
    sources = windows.where("NOT known").groupBy("key", "h2").agg(F.min("doc_id").alias("low"))
    flagged = windows.join(sources, ["key", "h2"], "left").where("known OR doc_id > low")
    flags = flagged.groupBy("doc_id").agg(F.collect_list(F.struct("at", "h2")).alias("flags"))
    state = WindowHashes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        removed, digests = [], []
        values, ends = lists(batch.column("flags"))
        spots, hashes = (values.field(c).to_numpy() for c in ("at", "h2"))
        for k, text in enumerate(unpack(batch.column("packed"))):
            own = state.windows(text.split())[1]
            at, h2 = spots[ends[k]:ends[k + 1]], hashes[ends[k]:ends[k + 1]]
            # Should ids repeat, a window only counts for a text that holds it there.
            inside = at < len(own)
            at = at[inside][own[at[inside]] == h2[inside]]
            removed.append(np.unique(at[:, None] + np.arange(WINDOW, dtype=np.int32)))
            digests.append(hashlib.sha256(b" ".join(kept_words(text, removed[-1]))).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(r) for r in removed], pa.int64()), pa.array(digests),
             list_array(removed, pa.int32())], names=["doc_id", "text_hash", "n_removed", "sha256", "removed"])

    schema = T.StructType([
        T.StructField("doc_id", _LONG), T.StructField("text_hash", _LONG), T.StructField("n_removed", _LONG),
        T.StructField("sha256", T.StringType()), T.StructField("removed", T.ArrayType(_INT)),
    ])
    partly = map_batches(found.drop("at").join(flags, "doc_id"), run, schema).dropDuplicates(["doc_id", "text_hash"])
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return partly.unionByName(copies.select(
        "doc_id", "text_hash", F.lit(None).cast("long").alias("n_removed"), nothing.alias("sha256"), F.lit(None).cast("array<int>").alias("removed")
    ))


def kept_words(text: bytes, removed: np.ndarray) -> list[bytes]:
    words = text.split()
    keep = np.ones(len(words), bool)
    keep[removed] = False
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def removed_words(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256.

    Null and empty texts have no words; texts below a window lose nothing.
    A row with a null doc_id is no source and loses nothing, since no id is smaller.
    Rows that repeat an id don't count against each other. Columns other than
    doc_id and text take no part.
    """
    top = written(heads(_identified(docs)), "heads")
    cut = cuts(docs, top).drop("removed").withColumnRenamed("sha256", "cut_sha256").withColumn("cut", F.lit(True))
    return top.join(cut, ["doc_id", "text_hash"], "left").select(
        "doc_id", "n_words",
        F.when(F.col("cut"), F.coalesce("n_removed", "n_words")).otherwise(F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("cut_sha256", "sha256").alias("kept_sha256"),
    )


def cut_text(text: bytes, removed: np.ndarray) -> bytes:
    """The text without the words at ``removed`` and the blanks behind them; everything else as it was."""
    out, at = [], 0
    gone = set(removed.tolist())
    for k, m in enumerate(_WORD_AND_BLANKS.finditer(text)):
        if k in gone:
            out.append(text[at:m.start()])
            at = m.end()
    return b"".join([*out, text[at:]])


def cut_documents(docs: DataFrame) -> DataFrame:
    """The documents without their removed words; other texts and all other columns unchanged, n_chars counted anew if there.

    A document that loses every word stays with an empty text.
    """
    top = written(heads(_identified(docs)), "heads")
    removed, cut, text_hash, doc_id = (free_name(docs, c) for c in ("_removed", "_cut", "_text_hash", "_cut_id"))
    changed = cuts(docs, top).select(F.col("doc_id").alias(doc_id), F.col("text_hash").alias(text_hash), F.col("removed").alias(removed), F.lit(True).alias(cut))
    joined = docs.join(changed, (docs["doc_id"] == F.col(doc_id)) & (F.xxhash64(docs["text"]) == F.col(text_hash)), "left").select(
        *[docs[c] for c in docs.columns], removed, cut
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        places, hits = columns.pop(removed).to_pylist(), columns.pop(cut).to_pylist()
        texts = columns["text"].to_pylist()
        for k, hit in enumerate(hits):
            if hit:
                texts[k] = "" if places[k] is None else cut_text(texts[k].encode(), np.array(places[k])).decode()
        columns["text"] = pa.array(texts, batch.schema.field("text").type)
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    out = map_batches(joined, run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def query(spark, sf_dir: str) -> DataFrame:
    return removed_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = rf"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
),
i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS p FROM w WHERE len(ws) >= {WINDOW}),
h AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + {WINDOW - 1}], ' ')) AS k FROM i),
m AS (SELECT k, min(doc_id) AS low FROM h GROUP BY k),
c AS (SELECT DISTINCT doc_id, p + o AS place FROM (SELECT doc_id, p FROM h JOIN m USING (k) WHERE doc_id > low), range(0, {WINDOW}) t(o)),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM w),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS kept FROM x ANTI JOIN c USING (doc_id, place) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
