"""Regression trees on binned features: each level of a tree comes from one pass that counts rows by node, feature and bin.

The splits are those of MLlib's tree learners (variance, the same thresholds where its sample is all rows, the first of equal
splits, no least gain). MLlib plans a fit anew for every tree and draws its thresholds each time, which is most of the time of a boosted fit of
hundreds of trees; here the features are binned once, into blocks of ``BLOCK`` rows of numpy arrays.

The blocks are either in the tasks of an RDD (:class:`Spread`: every pass is a job, what a task returns is bounded by nodes, features and bins)
or, up to ``LOCAL`` rows, all in one process (:class:`Local`: one task runs the whole fit, without a job for each level). Both run the same passes
over the same blocks, and give the same trees.
"""

from __future__ import annotations

import itertools
import json
import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a block, and up to how many rows one task has them all.
BLOCK, LOCAL = 1 << 16, 1_000_000
#: Rows of a partition of blocks (they are read one by one): no more partitions than the session runs tasks at once, unless the rows ask for it.
ROWS = 2_000_000
#: Rows that the thresholds come from: all rows up to here, else a seeded sample of as many (MLlib: 10,000).
SAMPLE = 100_000
#: Residuals that are sorted at once for the medians, and ranges that those of a leaf are counted in before.
GATHER, RANGES = 1_000_000, 256
#: Bytes of counts that one pass of a forest makes in a task.
COUNTS = 64 << 20


def gathered(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, of which there are ``n``, in as few partitions as keep all cores busy and hold ``ROWS`` rows or so."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(cores * max(1, -(-n // (ROWS * cores))))


def thresholds(values: np.ndarray, bins: int) -> np.ndarray:
    """The cuts between a feature's bins, as MLlib places them: between all its values, or else close to equal numbers of rows."""
    value, count = np.unique(values + 0.0, return_counts=True)
    between = value[:-1] / 2 + value[1:] / 2
    splits = min(bins, len(values)) - 1
    if len(between) <= splits:
        return between
    stride, found, reached = len(values) / (splits + 1), [], np.cumsum(count).tolist()
    target = stride
    for k in range(1, len(value)):
        if abs(reached[k - 1] - target) < abs(reached[k] - target):
            found.append(between[k - 1])
            target += stride
    return np.array(found)


@dataclass
class Block:
    """Some rows: ``bins`` has a row for each feature. ``held`` rows are not fitted to."""

    number: int
    bins: np.ndarray
    label: np.ndarray
    held: np.ndarray
    score: np.ndarray | None = None


@dataclass
class Tree:
    """Nodes in order of their making; a leaf is its own left child, and no bin is above its cut."""

    feature: list[int] = field(default_factory=lambda: [0])
    cut: list[int] = field(default_factory=lambda: [255])
    left: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    count: list[float] = field(default_factory=lambda: [0.0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, gain: float, sides: Sequence[tuple[float, float]]) -> list[int]:
        """Make ``node`` an inner one; ``sides`` has the count and the mean of its children, whose numbers are returned."""
        self.feature[node], self.cut[node], self.left[node], self.gain[node] = feature, cut, len(self.left), gain
        for count, mean in sides:
            self.feature.append(0)
            self.cut.append(255)
            self.left.append(len(self.left))
            self.gain.append(0.0)
            self.count.append(count)
            self.value.append(mean)
        return [self.left[node], self.left[node] + 1]

    def leaves(self) -> np.ndarray:
        return np.flatnonzero(np.array(self.left) == np.arange(len(self.left)))

    def descend(self, bins: np.ndarray, at: np.ndarray, levels: int) -> np.ndarray:
        """Where rows that are at the nodes ``at`` are so many levels deeper."""
        feature, cut, left = np.array(self.feature, np.int64) * bins.shape[1], np.array(self.cut, np.uint8), np.array(self.left)
        flat, row = bins.reshape(-1), np.arange(bins.shape[1])
        for _ in range(levels):
            at = left.take(at) + (flat.take(feature.take(at) + row) > cut.take(at))
        return at


def start(bins: np.ndarray) -> np.ndarray:
    return np.zeros(bins.shape[1], np.intp)


#: What a tree is fitted to: of a block and the tree's number, the rows, their weights (None: 1) and their targets.
Target = Callable[[Block, int], tuple[np.ndarray, np.ndarray | None, np.ndarray]]


def counts(block: Block, at: np.ndarray, tree: Tree, open_: Sequence[int], target: tuple, features: Sequence[int], bins: int) -> np.ndarray:
    """Weights and weighted targets of the rows in each open node, by feature and bin."""
    rows, weight, value = target
    slot = np.full(len(tree.left), -1, np.int64)
    slot[list(open_)] = np.arange(len(open_))
    own = slot.take(at.take(rows))
    if (own < 0).any():
        inside = own >= 0
        rows, own, value, weight = rows[inside], own[inside], value[inside], None if weight is None else weight[inside]
    whole, size = len(rows) == block.bins.shape[1], len(open_) * bins
    own = own * bins
    weighted = value if weight is None else value * weight
    out = np.empty((2, len(open_), len(features), bins))
    for k, f in enumerate(features):
        key = own + (block.bins[f] if whole else block.bins[f].take(rows))
        out[0, :, k] = np.bincount(key, weight, size).reshape(-1, bins)
        out[1, :, k] = np.bincount(key, weighted, size).reshape(-1, bins)
    return out


def best_splits(found: np.ndarray) -> list[tuple]:
    """Of each node's counts the best split: feature's place, cut, gain (nan: none), count and sum of the left side, and of all."""
    count, total = found
    below, sums = count.cumsum(2)[:, :, :-1], total.cumsum(2)[:, :, :-1]
    n, all_ = count[:, 0].sum(1), total[:, 0].sum(1)
    above, rest = n[:, None, None] - below, all_[:, None, None] - sums
    with np.errstate(divide="ignore", invalid="ignore"):
        base = np.where(n > 0, all_ ** 2 / n, 0.0)
        gain = np.where((below > 0) & (above > 0), sums ** 2 / below + rest ** 2 / above, -np.inf) - base[:, None, None]
    if not gain.shape[2]:
        return [(0, 0, np.nan, 0.0, 0.0, a, b) for a, b in zip(n.tolist(), all_.tolist(), strict=True)]
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(1)
    gained = flat[np.arange(len(flat)), at]
    # A gain that rounding alone can make is none.
    gained = np.where(gained > 1e-12 * np.maximum(base, 1e-300), gained / np.maximum(n, 1e-300), np.nan)
    f, cut = np.divmod(at, gain.shape[2])
    k = np.arange(len(flat))
    return [*zip(f.tolist(), cut.tolist(), gained.tolist(), below[k, f, cut].tolist(), sums[k, f, cut].tolist(), n.tolist(), all_.tolist(), strict=True)]


def widened(tree: Tree, open_: Sequence[int], splits: Sequence[tuple], features: Sequence[int]) -> list[int]:
    """Split the open nodes of ``tree``; the new nodes, two by two."""
    deeper = []
    for node, (f, cut, gain, below, sums, n, all_) in zip(open_, splits, strict=True):
        if node == 0:
            tree.count[0], tree.value[0] = n, all_ / n if n else 0.0
        if gain == gain:
            deeper += tree.split(node, features[f], cut, gain, [(below, sums / below), (n - below, (all_ - sums) / (n - below))])
    return deeper


def grow(rows: Local | Spread, number: int, target: Target, features: Sequence[int], depth: int) -> Tree:
    """The tree of that number. Of two nodes from one split the smaller is counted, the other has what is left of their parent's counts."""
    tree = Tree()
    open_, known = [0], {}
    if depth:
        known[0] = rows.counts(number, tree, 0, [0], target, features)[:, 0]
    for level in range(1, depth + 1):
        children = widened(tree, open_, best_splits(np.stack([known[k] for k in open_], 1)), features)
        if not children or level == depth:
            break
        parent = {left: k for k, left in enumerate(tree.left) if left != k}
        pairs = [(a, a + 1) if tree.count[a] <= tree.count[a + 1] else (a + 1, a) for a in children[::2] if max(tree.count[a:a + 2]) > 1]
        if not pairs:
            break
        found = rows.counts(number, tree, level, [less for less, _ in pairs], target, features)
        before, known = known, {}
        for k, (less, more) in enumerate(pairs):
            known[less] = found[:, k]
            known[more] = before[parent[min(less, more)]] - found[:, k]
        open_ = [k for pair in pairs for k in sorted(pair) if tree.count[k] > 1]
    return tree


class _Rows:
    """What :class:`Local` and :class:`Spread` share; they have ``total`` (a function's results for every block, put together)."""

    def medians(self, tree: Tree) -> dict[int, float]:
        """The median of each leaf's residuals (label less score) of rows that are not held out: the smallest that half of them don't pass.

        Exact: they are counted in ranges, and again within the range that has the median, until few enough are left to be sorted at once."""
        leaves, nodes = tree.leaves().tolist(), len(tree.left)
        ranges: dict[int, tuple] = {}  # of a leaf the rank sought among the values from low to high, and how many they are
        if self.n > GATHER:
            n, low, high = self.total(lambda b: _extent(b, self.at(b, tree), nodes), _joined)
            ranges = {leaf: (int(n[leaf] + 1) // 2, int(n[leaf]), low[leaf], high[leaf]) for leaf in leaves if n[leaf]}
            while sum(r[1] for r in ranges.values() if r[2] < r[3]) > max(GATHER, len(ranges)):
                some = {leaf: r for leaf, r in ranges.items() if r[2] < r[3]}
                found = self.total(lambda b: _ranged(b, self.at(b, tree), some, nodes, RANGES), _joined)
                for leaf, (k, (rank, *_)) in zip(some, enumerate(some.values()), strict=True):
                    n, low, high = (x[k * (RANGES + 1):(k + 1) * (RANGES + 1)] for x in found)
                    place = int(np.searchsorted(np.cumsum(n), rank))
                    ranges[leaf] = (rank - int(n[:place].sum()), int(n[place]), low[place], high[place])
        done = {leaf: float(low) for leaf, (_, _, low, high) in ranges.items() if low == high}
        few = {leaf: r for leaf, r in ranges.items() if leaf not in done}
        if ranges and not few:
            return done
        node, value = self.total(lambda b: _listed(b, self.at(b, tree), few, nodes), _appended)
        order = np.argsort(node.astype(np.uint16 if nodes <= 1 << 16 else np.uint32), kind="stable")
        node, value = node[order], value[order]
        ends = np.searchsorted(node, np.arange(nodes + 1))
        for leaf in few or leaves:
            own = value[ends[leaf]:ends[leaf + 1]]
            if len(own):
                k = (few[leaf][0] if few else (len(own) + 1) // 2) - 1
                done[leaf] = float(np.partition(own, k)[k])
        return done


def _joined(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], np.minimum(a[1], b[1]), np.maximum(a[2], b[2])


def _appended(a: tuple, b: tuple) -> tuple:
    return tuple(np.concatenate(x) for x in zip(a, b, strict=True))


def _residuals(block: Block, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seen = ~block.held
    return at[seen], (block.label - block.score)[seen]


def _grouped(key: np.ndarray, value: np.ndarray, size: int) -> tuple:
    low, high = np.full(size, np.inf), np.full(size, -np.inf)
    np.minimum.at(low, key, value)
    np.maximum.at(high, key, value)
    return np.bincount(key, minlength=size), low, high


def _extent(block: Block, at: np.ndarray, nodes: int) -> tuple:
    return _grouped(*_residuals(block, at), nodes)


def _bounds(ranges: dict[int, tuple], nodes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place, low, high = np.full(nodes, -1), np.full(nodes, np.inf), np.full(nodes, -np.inf)
    for k, (leaf, (_, _, least, most)) in enumerate(ranges.items()):
        place[leaf], low[leaf], high[leaf] = k, least, most
    return place, low, high


def _ranged(block: Block, at: np.ndarray, ranges: dict[int, tuple], nodes: int, parts: int) -> tuple:
    """Number, smallest and largest of the residuals in each range of each leaf. The highest value is a range of its own, so that each pass has less left."""
    node, value = _residuals(block, at)
    place, low, high = _bounds(ranges, nodes)
    inside = (value >= low[node]) & (value <= high[node])
    node, value = node[inside], value[inside]
    low, high = low[node], high[node]
    # Halves, as the difference of two doubles may pass the largest.
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.nan_to_num((value / 2 - low / 2) / (high / 2 - low / 2))
    k = np.where(value == high, parts, np.minimum((share * parts).astype(np.int64), parts - 1))
    return _grouped(place[node] * (parts + 1) + k, value, len(ranges) * (parts + 1))


def _listed(block: Block, at: np.ndarray, ranges: dict[int, tuple], nodes: int) -> tuple[np.ndarray, np.ndarray]:
    node, value = _residuals(block, at)
    if ranges:
        _, low, high = _bounds(ranges, nodes)
        inside = (value >= low[node]) & (value <= high[node])
        node, value = node[inside], value[inside]
    return node, value


class Local(_Rows):
    """All blocks in this process; it knows how far down its rows are."""

    def __init__(self, blocks: Iterable[Block], n: int, width: int, bins: int):
        self.blocks, self.n, self.width, self.bins = [*blocks], n, width, bins
        self.known: tuple = (None, {}, {})  # a tree, where its rows are, and what it is fitted to

    def at(self, block: Block, tree: Tree, level: int | None = None) -> np.ndarray:
        if self.known[0] is not tree:
            self.known = (tree, {}, {})
        at = self.known[1]
        to = depth_of(tree) if level is None else level
        was, place = at.get(block.number, (0, None))
        if place is None:
            place = start(block.bins)
        at[block.number] = (to, tree.descend(block.bins, place, to - was))
        return at[block.number][1]

    def total(self, fn: Callable[[Block], tuple], join: Callable):
        return reduce(join, map(fn, self.blocks))

    def counts(self, number: int, tree: Tree, level: int, open_: Sequence[int], target: Target, features: Sequence[int]) -> np.ndarray:
        def counted(b: Block) -> np.ndarray:
            at, known = self.at(b, tree, level), self.known[2]
            if b.number not in known:
                known[b.number] = target(b, number)
            return counts(b, at, tree, open_, known[b.number], features, self.bins)

        return self.total(counted, np.add)

    def scored(self, fn: Callable[[Block], tuple[np.ndarray, tuple]]) -> np.ndarray:
        """Give every block the score that ``fn`` returns for it, and add up what it returns besides."""
        found = []
        for b in self.blocks:
            b.score, more = fn(b)
            found.append(more)
        return np.sum(found, axis=0)

    def release(self) -> None:
        self.blocks = []


class Spread(_Rows):
    """The blocks in the tasks of an RDD."""

    def __init__(self, blocks: RDD, n: int, width: int, bins: int, checkpoint_interval: int = 10):
        self.blocks, self.n, self.width, self.bins, self.interval = blocks, n, width, bins, checkpoint_interval
        self.rounds, self.kept = 0, blocks

    def __getstate__(self):
        return {"bins": self.bins}  # for the functions that go to the tasks

    def at(self, block: Block, tree: Tree, level: int | None = None) -> np.ndarray:
        return tree.descend(block.bins, start(block.bins), depth_of(tree) if level is None else level)

    def total(self, fn: Callable, join: Callable):
        found = self.blocks.mapPartitions(lambda blocks: [reduce(join, some) for some in [[*map(fn, blocks)]] if some])
        if self.blocks.getNumPartitions() > 64:
            return found.treeReduce(join, 2)
        return reduce(join, found.collect())

    def counts(self, number: int, tree: Tree, level: int, open_: Sequence[int], target: Target, features: Sequence[int]) -> np.ndarray:
        bins = self.bins
        return self.total(lambda b: counts(b, tree.descend(b.bins, start(b.bins), level), tree, open_, target(b, number), features, bins), np.add)

    def scored(self, fn: Callable[[Block], tuple[np.ndarray, tuple]]) -> np.ndarray:
        def run(blocks: Iterator[Block]) -> Iterator[tuple]:
            for b in blocks:
                score, more = fn(b)
                yield replace(b, score=score), np.asarray(more, float)

        self.rounds += 1
        both = self.blocks.mapPartitions(run).persist(StorageLevel.MEMORY_AND_DISK)
        if self.interval > 0 and self.rounds % self.interval == 0:
            # Lineage ends here.
            if both.ctx.getCheckpointDir():
                both.checkpoint()
            else:
                both.localCheckpoint()
        found = both.map(lambda x: x[1]).collect()
        self.kept.unpersist()
        self.blocks, self.kept = both.map(lambda x: x[0]), both
        return np.sum(found, axis=0)

    def release(self) -> None:
        self.kept.unpersist()


def depth_of(tree: Tree) -> int:
    depth = [0] * len(tree.left)
    for node, left in enumerate(tree.left):
        if left != node:
            depth[left] = depth[left + 1] = depth[node] + 1
    return max(depth)


@dataclass
class Binned:
    """Rows as persisted blocks: ``n`` of them, ``seen`` not held out, and the thresholds of their features."""

    blocks: RDD
    n: int
    seen: int
    cuts: list[np.ndarray]
    bins: int

    @property
    def width(self) -> int:
        return len(self.cuts)

    def release(self) -> None:
        self.blocks.unpersist()


def binned(data: DataFrame, features: str, label: Column, held: Column, max_bins: int, seed: int) -> Binned:
    """``data`` (persisted, if its making is long) as blocks. The features are binned by rows that are not held out."""
    if max_bins > 256:
        raise ValueError("a bin's number is a byte: at most 256 bins")
    rows = data.select(vector_to_array(features).alias("x"), label.cast("double").alias("label"), F.coalesce(held, F.lit(False)).alias("held"))
    n, seen, bad = rows.agg(F.count(F.lit(1)), F.count_if(~F.col("held")), F.count_if(~F.col("held") & (F.col("label").isNull() | F.isnan("label")))).first()
    if not seen:
        raise ValueError("no row to fit on")
    if bad:
        raise ValueError(f"{bad} rows to fit on have no label")
    some = rows.where("NOT held").select("x")
    if seen > SAMPLE:
        some = some.sample(min(1.0, SAMPLE / seen), seed)
    drawn = _matrix(some.toArrow().column("x").combine_chunks())
    if not len(drawn):
        raise ValueError("no row to fit on")
    cuts = [thresholds(x, max_bins) for x in drawn.T]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held_, made in _blocks(batches, cuts):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((held_, *made))], pa.binary())], names=["block"])

    def loaded(index: int, found: Iterator) -> Iterator[Block]:
        for k, row in enumerate(found):
            held_, bins, label_ = pickle.loads(row[0])
            yield Block(index << 32 | k, bins, label_, held_)

    blocks = gathered(rows, n).mapInArrow(run, "block binary").rdd.mapPartitionsWithIndex(loaded).persist(StorageLevel.MEMORY_AND_DISK)
    return Binned(blocks, n, seen, cuts, max(len(c) for c in cuts) + 1)


def _matrix(x: pa.Array) -> np.ndarray:
    width = len(x[0]) if len(x) else 0
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if width else np.empty((0, 0))


def _blocks(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray]) -> Iterator[tuple]:
    def made(parts: list) -> tuple:
        bins, label, held = (np.concatenate(x, axis=-1) for x in zip(*parts, strict=True))
        return held, (bins, label)

    parts, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column(0))
        label = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
        held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        parts.append((np.stack([np.searchsorted(c, v).astype(np.uint8) for c, v in zip(cuts, x.T, strict=True)]), label, held))
        rows += len(label)
        if rows >= BLOCK:
            yield made(parts)
            parts, rows = [], 0
    if parts:
        yield made(parts)


def run_fit(data: Binned, fit: Callable[[Local | Spread], object], checkpoint_interval: int):
    """``fit`` of the rows: in one task if they are few, else here, with jobs for its passes. ``fit`` returns what can be sent."""
    n, width, bins = data.n, data.width, data.bins
    if n <= LOCAL:
        data.blocks.count()  # binned by all cores
        return data.blocks.coalesce(1).mapPartitions(lambda blocks: [fit(Local(blocks, n, width, bins))]).collect()[0]
    rows = Spread(data.blocks, n, width, bins, checkpoint_interval)
    try:
        return fit(rows)
    finally:
        rows.release()


def grow_forest(data: Binned, trees: int, target: Target, depth: int) -> list[Tree]:
    """Trees that don't depend on each other, on all features."""
    sc, n, width, bins, features = data.blocks.ctx, data.n, data.width, data.bins, range(data.width)
    if n <= LOCAL:
        shared = sc.broadcast(data.blocks.collect())
        try:
            return sc.parallelize(range(trees), min(trees, 4 * sc.defaultParallelism)).map(lambda t: grow(Local(shared.value, n, width, bins), t, target, features, depth)).collect()
        finally:
            shared.destroy()
    forest, open_ = [Tree() for _ in range(trees)], {t: [0] for t in range(trees)}
    per_node = 2 * 8 * width * bins
    for level in range(depth):
        deeper: dict[int, list[int]] = {}
        for some in _batches(open_, per_node):
            part = {t: forest[t] for t, _ in some}

            def run(blocks: Iterator[Block], level=level, some=some, part=part) -> Iterator[tuple]:
                sums: dict[tuple, np.ndarray] = {}
                for b in blocks:
                    for t, group in itertools.groupby(some, lambda x: x[0]):
                        at, fitted = part[t].descend(b.bins, start(b.bins), level), target(b, t)
                        for key in group:
                            found = counts(b, at, part[t], key[1], fitted, features, bins)
                            sums[key] = sums[key] + found if key in sums else found
                yield from sums.items()

            added = data.blocks.mapPartitions(run).reduceByKey(np.add, sc.defaultParallelism)
            for (t, nodes), splits in sorted(added.mapValues(best_splits).collect()):
                deeper.setdefault(t, []).extend(k for k in widened(forest[t], nodes, splits, features) if forest[t].count[k] > 1)
        open_ = {t: nodes for t, nodes in deeper.items() if nodes}
    return forest


def _batches(open_: dict[int, list[int]], per_node: int) -> Iterator[list[tuple[int, tuple[int, ...]]]]:
    """The open nodes of all trees in passes that a task has the memory for, as (tree, nodes)."""
    most = max(1, COUNTS // per_node)
    some, nodes = [], 0
    for t, mine in open_.items():
        for k in range(0, len(mine), most):
            part = tuple(mine[k:k + most])
            if nodes and nodes + len(part) > most:
                yield some
                some, nodes = [], 0
            some.append((t, part))
            nodes += len(part)
    if some:
        yield some


class Forge:
    """Makes MLlib models of trees."""

    def __init__(self, spark: SparkSession, cuts: list[np.ndarray]):
        self.gateway, self.cuts = spark.sparkContext._gateway, cuts
        jvm = self.gateway.jvm
        self.ml = jvm.org.apache.spark.ml
        self.builder = getattr(self.ml.tree, "DecisionTreeModelReadWrite$").__getattr__("MODULE$")
        self.nodes = self.gateway.new_array(getattr(self.ml.tree, "DecisionTreeModelReadWrite$NodeData"), 0).getClass()
        self.reader = jvm.com.fasterxml.jackson.databind.ObjectMapper()
        self.reader.registerModule(jvm.com.fasterxml.jackson.module.scala.DefaultScalaModule())
        self.reader.configure(getattr(jvm.com.fasterxml.jackson.core, "JsonParser$Feature").valueOf("ALLOW_NON_NUMERIC_NUMBERS"), True)

    def _named(self, kind: str) -> str:
        return f"{kind}_{uuid.uuid4().hex[:12]}"

    def tree(self, tree: Tree):
        """One MLlib tree, read at once from its nodes in pre-order, as MLlib saves them (a call for each node takes seconds for a deep tree).
        Leaves and nodes have counts and means, no impurity: no fit needs it."""
        order, stack = [], [0]
        while stack:
            node = stack.pop()
            order.append(node)
            if tree.left[node] != node:
                stack += [tree.left[node] + 1, tree.left[node]]
        number = {node: k for k, node in enumerate(order)}
        data = []
        for k, node in enumerate(order):
            inner = tree.left[node] != node
            split = {"featureIndex": tree.feature[node], "leftCategoriesOrThreshold": [float(self.cuts[tree.feature[node]][tree.cut[node]])], "numCategories": -1} if inner else \
                    {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}
            count, value = tree.count[node], tree.value[node]
            data.append({"id": k, "prediction": value, "impurity": 0.0, "impurityStats": [count, count * value, count * value * value], "rawCount": int(count),
                         "gain": tree.gain[node] if inner else -1.0, "leftChild": number[tree.left[node]] if inner else -1,
                         "rightChild": number[tree.left[node] + 1] if inner else -1, "split": split})
        root = self.builder.buildTreeFromNodes(self.reader.readValue(json.dumps(data), self.nodes), "variance")
        return self.ml.regression.DecisionTreeRegressionModel(self._named("dtr"), root, len(self.cuts))

    def trees(self, trees: Sequence[Tree]):
        out = self.gateway.new_array(self.ml.regression.DecisionTreeRegressionModel, len(trees))
        for k, tree in enumerate(trees):
            out[k] = self.tree(tree)
        return out

    def weights(self, weights: Sequence[float]):
        out = self.gateway.new_array(self.gateway.jvm.double, len(weights))
        for k, weight in enumerate(weights):
            out[k] = float(weight)
        return out

    def boosted_regressor(self, trees: Sequence[Tree], weights: Sequence[float]):
        return self.ml.regression.GBTRegressionModel(self._named("l1boost"), self.trees(trees), self.weights(weights), len(self.cuts))

    def boosted_classifier(self, trees: Sequence[Tree], weights: Sequence[float]):
        return self.ml.classification.GBTClassificationModel(self._named("gbtc"), self.trees(trees), self.weights(weights), len(self.cuts), 2)

    def forest(self, trees: Sequence[Tree]):
        return self.ml.regression.RandomForestRegressionModel(self._named("rfr"), self.trees(trees), len(self.cuts))
