"""Links within loose groups of documents, and connected components, for the operators on near-duplicates.

Loose groups contain every link, but not all of their pairs are links, and one group may hold a
third of all documents:

1. Every member is compared with up to ``LEADERS`` members of its group. In groups of real
   copies that links nearly all of them, at the price of one comparison each.
2. What is then one component needs no further comparison within itself. The members are cut into
   blocks, by component and set size: a block of one component skips the other blocks of the same one, and a pair of
   blocks whose sizes cannot reach the threshold is left out. A task compares two blocks and returns a spanning
   forest of their links.
3. Connected components of all links by alternating star contraction.

Pairs of blocks are a table of their own; documents meet it after their sets are written.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, map_batches, stored, utf8, written

LEADERS, SLICE, BLOCK = 4, 512, 128
#: (sets, further sets or None, threshold) -> pairs of places that link, a spanning forest of them: of a place in the
#: first list and one in the second, or of two in the first.
Compare = Callable[[list[np.ndarray], list[np.ndarray] | None, int], list[tuple[int, int]]]


class Forest:
    """Union-find over numbers below n."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether they were apart; now they are not."""
        x, y = self.root(a), self.root(b)
        self.parent[x] = y
        return x != y


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0


def links(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    common = overlap(a, b)
    return 100 * common >= threshold * (len(a) + len(b) - common)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (u, v), for every node of an edge.

    Alternates two contractions until every edge leads from a node to its root. First all larger neighbours of a node
    get its smallest neighbour (or the node); then all smaller ones, and the node, the smallest of these. The smallest neighbours are
    written before the first join, on the smaller end, where a component's root has most of the edges: both sides are
    then plain exchanges, which adaptive execution splits. A round's tables go when the next are written.
    """
    spark = edges.sparkSession

    def kept(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        marks = Observation()
        table, path = stored(df.observe(marks, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges")
        return table, path, (marks.get["n"], marks.get["h"])

    now, path, mark = kept(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while mark[0]:
        ends = F.explode(F.array(F.struct("u", F.col("v").alias("m")), F.struct(F.col("v").alias("u"), F.col("v").alias("m"))))
        low, low_path = stored(now.select(ends.alias("e")).select("e.*").groupBy("u").agg(F.min("m").alias("m")), "lowest")
        large = now.join(low.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v"))
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        both = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        after, after_path, seen = kept(small.select(both.alias("e")).select("e.*").where("u <> v").distinct())
        discard(spark, path)
        discard(spark, low_path)
        now, path, mark, before = after, after_path, seen, mark
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _sets(docs: DataFrame, members: DataFrame, shingle: Callable[[bytes], np.ndarray]) -> DataFrame:
    """doc_id, root, n_shingles and the packed set of every member, from the row whose set has the member's keys."""
    rows = docs.select("doc_id", "text").join(members.select("doc_id", "root", "n_shingles", "key1", "key2"), "doc_id")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle(t).tobytes() for t in utf8(batch.column("text"))]
        keys = np.array([np.frombuffer(xxhash.xxh3_128_digest(s), np.int64) for s in sets]).reshape(-1, 2)
        own = np.flatnonzero((keys[:, 0] == batch.column("key1").to_numpy()) & (keys[:, 1] == batch.column("key2").to_numpy()))
        batch = batch.take(pa.array(own))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "root", "n_shingles")), pa.array([sets[k] for k in own], pa.binary())],
                                          names=["doc_id", "root", "n_shingles", "shingles"])

    return written(map_batches(rows, run, T.StructType([*members.select("doc_id", "root", "n_shingles").schema.fields, T.StructField("shingles", T.BinaryType())])), "sets")


def _to_leaders(sets: DataFrame, threshold: int) -> DataFrame:
    """Links (u, v) of members to the leaders of their group, in slices of about ``SLICE`` members."""
    groups = sets.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / SLICE).alias("slices"))
    # A leader for each of a few parts of the group, in the order of hashes, so that it is none of a kind.
    leaders = sets.select("root", "doc_id", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(LEADERS)).alias("part")).groupBy("root", "part").agg(
        F.min(F.struct(F.xxhash64(F.lit(6), "doc_id").alias("h"), "doc_id")).alias("l")).select("root", F.col("l.doc_id").alias("doc_id"))
    leaders = written(sets.join(leaders, ["root", "doc_id"], "left_semi").join(groups, "root").select(
        F.col("root").alias("group"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), "doc_id", "shingles"), "leaders")
    sliced = sets.join(groups, "root").select("root", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.col("slices")).alias("slice"), "doc_id", "shingles")

    def compare(members: pd.DataFrame, lead: pd.DataFrame) -> pd.DataFrame:
        found = []
        lead = lead.drop_duplicates(["doc_id", "shingles"])
        for leader, raw in zip(lead["doc_id"], lead["shingles"], strict=True):
            own = np.frombuffer(raw, np.uint64)
            found += [(doc, leader) for doc, other in zip(members["doc_id"], members["shingles"], strict=True)
                      if doc != leader and links(own, np.frombuffer(other, np.uint64), threshold)]
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return sliced.groupBy("root", "slice").cogroup(leaders.groupBy("group", "slice")).applyInPandas(compare, "u long, v long")


def _blocks(members: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, root, n_shingles, big, own, block, for groups of more than one component.

    ``own`` is the component of members that have ``BLOCK`` or more with them (``big``), else 0. Blocks follow the
    set size, by counts per size, so that no window has to see a whole group: a slice is the members of one
    size, cut by a hash.
    """
    named = members.join(labels.select(F.col("node").alias("doc_id"), F.col("root").alias("label")), "doc_id", "left").select(
        "doc_id", "root", "n_shingles", F.coalesce("label", "doc_id").alias("label"))
    named = written(named, "labels")
    open_ = named.groupBy("root").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("root")
    big = named.groupBy("root", "label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= BLOCK).select("root", "label", F.lit(True).alias("big"))
    rows = named.join(open_, "root", "left_semi").join(big, ["root", "label"], "left").select(
        "doc_id", "root", "n_shingles", F.coalesce("big", F.lit(False)).alias("big"), F.when(F.col("big"), F.col("label")).otherwise(F.lit(0)).alias("own"))
    rows = written(rows, "open")
    keys = ["root", "big", "own"]
    per = rows.groupBy(*keys, "n_shingles").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("n_shingles").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = per.select(*keys, "n_shingles", F.floor(before / BLOCK).alias("first"), F.floor((before + F.col("n") - 1) / BLOCK).alias("last"))
    block = F.col("first") + F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.col("last") - F.col("first") + 1)
    return written(rows.join(placed, [*keys, "n_shingles"]).select("doc_id", *keys, "n_shingles", block.alias("block")), "blocks")


def _between_blocks(sets: DataFrame, blocks: DataFrame, threshold: int, compare: Compare) -> DataFrame:
    """Links (u, v) between members of one group that no component joins yet, a spanning forest for each pair of blocks."""
    place = F.struct("big", "own", "block")
    span = written(blocks.groupBy("root", place.alias("at")).agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high")), "spans")
    a, b = span.alias("a"), span.alias("b")
    # Pairs of blocks, not of documents.
    pairs = written(a.join(b, F.col("a.root") == F.col("b.root")).where(
        (F.col("a.at") <= F.col("b.at")) & (F.col("b.low") * threshold <= F.col("a.high") * 100) & (F.col("a.low") * threshold <= F.col("b.high") * 100)
        & ~(F.col("a.at.big") & F.col("b.at.big") & (F.col("a.at.own") == F.col("b.at.own")))
    ).select(F.col("a.root").alias("root"), F.col("a.at").alias("i"), F.col("b.at").alias("j")), "pairs")
    sides = pairs.select("root", "i", "j", F.lit(0).alias("side"), "i.*").unionByName(pairs.where("i < j").select("root", "i", "j", F.lit(1).alias("side"), "j.*"))
    dealt = blocks.select("doc_id", "root", "big", "own", "block").join(sides, ["root", "big", "own", "block"])
    dealt = dealt.join(sets.select("doc_id", "shingles"), "doc_id").select("root", "i", "j", "side", "doc_id", "shingles")

    def forest(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["side", "doc_id", "shingles"]).sort_values(["side", "doc_id"])
        n, ids = int((frame["side"] == 0).sum()), frame["doc_id"].tolist()
        all_ = [np.frombuffer(s, np.uint64) for s in frame["shingles"]]
        found = compare(all_[:n], all_[n:] or None, threshold)
        ends = ids[n:] or ids
        return pd.DataFrame({"u": [ids[x] for x, _ in found], "v": [ends[y] for _, y in found]}, dtype="int64")

    return dealt.groupBy("root", "i", "j").applyInPandas(forest, "u long, v long")


def linked_components(docs: DataFrame, members: DataFrame, threshold: int, shingle: Callable[[bytes], np.ndarray], compare: Compare) -> DataFrame:
    """(node, root): components of the links within loose groups, from members (doc_id, root, n_shingles, key1, key2).

    Rows of one doc_id with different texts are one node, with the links of all of them."""
    sets = _sets(docs, members, shingle)
    first = written(_to_leaders(sets, threshold), "links")
    labels = components(first)
    blocks = _blocks(sets.select("doc_id", "root", "n_shingles").distinct(), labels)
    if blocks.isEmpty():
        return labels
    return components(first.unionByName(_between_blocks(sets, blocks, threshold, compare)))
