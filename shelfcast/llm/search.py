"""Exact top-k inner-product search by dual cover trees.

1. A bounded sample of the vectors (``PIVOTS``) gives cells; every vector goes to the
   cell of its nearest pivot. A cell is cut into blocks of about ``BLOCK`` vectors,
   by a hash of the id, so equal vectors in any number fill many blocks.
2. A task builds the cover tree of a block: a node has a centre, the radius that covers
   its vectors, and children whose centres lie further than half that radius from each other and
   cover the node's vectors within half of it; the first child has the node's own centre. So the
   radius halves at least with every level. Queries are vectors
   of the blocks too and get a tree of their own in each; a first search in
   their own block gives every query a worst kth score.
3. The roots of query trees are compared with the roots of data blocks. For centres
   q and x with radii r and s, no inner product exceeds
   q.x + r|x| + s|q| + rs; a pair below the worst kth score of the query tree is left out.
4. Queries travel to the remaining blocks (they are few, the data stay) and both trees are
   descended together under the same bound, which rises as scores are found.
5. The best of each query over all blocks.

The sample only shapes the cells; any sample gives the same result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, written

K = 5
SCALE = 256
BLOCK = 2048  # vectors
LEAF = 64
TOGETHER = 256  # leaves below one node that are scored at once
#: Bounds of the sample: pivots, and their numbers in all.
PIVOTS, PIVOT_NUMBERS = 4096, 1 << 20
GROUPS = 1024  # query trees that a task holds at once
_EXACT = float(1 << 53)


class CoverTree:
    """Cover tree of the rows of ``points``; ``order`` puts each node's rows side by side.

    Node i has its centre at row ``middle[i]``, the vectors ``order[begin[i]:end[i]]`` within ``radius[i]`` of it, and
    the children ``kids(i)``, none if it is a leaf. Centres are read from the points, so a stored tree holds row numbers.
    """

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        squares = (points**2).sum(1)

        def distances(rows: np.ndarray, row: int) -> np.ndarray:
            far = np.sqrt(np.maximum(squares[rows] + squares[row] - 2 * (points[rows] @ points[row]), 0))
            far[rows == row] = 0
            return far

        middle = int(((points - points.mean(0)) ** 2).sum(1).argmin())
        # (row of the centre, radius, begin, end) of each node; children are appended side by side.
        nodes = [(middle, float(distances(self.order, middle).max()), 0, len(points))]
        first, count = [], []
        while len(first) < len(nodes):
            middle, radius, lo, hi = nodes[len(first)]
            first.append(len(nodes))
            if hi - lo > LEAF and radius > 0:
                nodes += self._children(distances, middle, radius, lo, hi)
            count.append(len(nodes) - first[-1])
        self.middle, self.begin, self.end = (np.array([n[c] for n in nodes]) for c in (0, 2, 3))
        # Distances come from squares and products; this is more than their rounding.
        self.room = np.sqrt(1e-15 * points.shape[1] * squares.max())
        self.radius = np.array([n[1] for n in nodes]) + self.room
        self.first, self.count = np.array(first), np.array(count)
        norms = np.sqrt(squares)[self.order]
        self.norm = np.array([norms[lo:hi].max() for lo, hi in zip(self.begin, self.end, strict=True)])
        leaves = np.concatenate(([0], np.cumsum(self.count == 0)))
        self.flat = leaves[self.first + self.count] - leaves[self.first] == self.count
        self.place(points)

    def _children(self, distances, middle: int, radius: float, lo: int, hi: int) -> list[tuple]:
        """A net of half the radius: the node's centre, then any vector that no centre so far covers."""
        left, found, parts = self.order[lo:hi].copy(), [], []
        while len(left):
            row = int(left[0]) if found else middle
            far = distances(left, row)
            near = far <= radius / 2
            parts.append(left[near])
            found.append((row, float(far[near].max())))
            left = left[~near]
        self.order[lo:hi] = np.concatenate(parts)
        ends = (lo + np.cumsum([len(x) for x in parts])).tolist()
        return [(row, r, end - len(x), end) for (row, r), x, end in zip(found, parts, ends, strict=True)]

    def kids(self, i: int) -> np.ndarray:
        return np.arange(self.first[i], self.first[i] + self.count[i])

    def place(self, points: np.ndarray) -> CoverTree:
        self.centre = points[self.middle]
        self.centre_norm = np.sqrt((self.centre**2).sum(1))
        return self

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("centre", "centre_norm")}


def bound(q: CoverTree, i, x: CoverTree, j) -> np.ndarray:
    """No inner product between the nodes is above this; a little is added for rounding."""
    b = q.centre[i] @ x.centre[j].T + q.radius[i] * x.centre_norm[j] + x.radius[j] * q.centre_norm[i] + q.radius[i] * x.radius[j]
    b = np.minimum(b, q.norm[i] * x.norm[j])
    return b + 1e-9 * np.abs(b) + 1e-6


class Best:
    """The ``k`` best (score, id) of each query so far: higher scores first, ties to smaller ids."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, k: int, worst: np.ndarray | None = None):
        self.ids, self.points, self.k = ids, points, k
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.zeros((len(ids), k), np.int64)
        self.floor = np.full(len(ids), -np.inf) if worst is None else worst

    def worst(self, rows: np.ndarray) -> float:
        """The least score that could still matter to any of these queries."""
        return float(np.maximum(self.score[rows, -1], self.floor[rows]).min())

    def offer(self, rows: np.ndarray, ids: np.ndarray, points: np.ndarray) -> None:
        s = self.points[rows] @ points.T
        s[self.ids[rows][:, None] == ids] = -np.inf
        limit = np.maximum(self.score[rows, -1], self.floor[rows])
        useful = np.flatnonzero((s >= limit[:, None]).any(0))
        if len(useful):
            score = np.concatenate((self.score[rows], s[:, useful]), 1)
            found = np.concatenate((self.found[rows], np.broadcast_to(ids[useful], (len(rows), len(useful)))), 1)
            top = np.lexsort((found, -score), axis=-1)[:, : self.k]
            self.score[rows], self.found[rows] = np.take_along_axis(score, top, 1), np.take_along_axis(found, top, 1)


def dual_search(best: Best, queries: CoverTree, ids: np.ndarray, points: np.ndarray, data: CoverTree) -> None:
    """Descend both trees together; node pairs that cannot reach the worst kth score of the query node are left.

    Leaves below one node are bounded by array and scored together, the most promising first.
    """
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        rows = queries.order[queries.begin[i]:queries.end[i]]
        if bound(queries, i, data, j) < best.worst(rows):
            continue
        if data.count[j] and (not queries.count[i] or (data.radius[j] >= queries.radius[i] and not data.flat[j])):
            kids = data.kids(j)
            b = bound(queries, i, data, kids)
            ranked = np.argsort(b)
            ranked = ranked[~(b[ranked] < best.worst(rows))]
            together = data.count[kids[ranked]] == 0 if not queries.count[i] else np.zeros(len(ranked), bool)
            leaves = ranked[together][::-1]
            for k in range(0, len(leaves), TOGETHER):
                some = leaves[k:k + TOGETHER]
                some = kids[some[~(b[some] < best.worst(rows))]]
                if not len(some):
                    break
                at = np.concatenate([data.order[data.begin[c]:data.end[c]] for c in some])
                best.offer(rows, ids[at], points[at])
            # The most promising child is taken from the stack first.
            todo += [(i, int(c)) for c in kids[ranked[~together]]]
        elif queries.count[i]:
            todo += [(int(c), j) for c in queries.kids(i)]
        else:
            at = data.order[data.begin[j]:data.end[j]]
            best.offer(rows, ids[at], points[at])


def exact_scores(query: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers of any size, held within the range of a long."""
    rows = [[int(v) for v in p] for p in points]
    dots = [sum(a * b for a, b in zip([int(v) for v in query], r, strict=True)) for r in rows]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, d)) for d in dots], dtype=object)


def _matrix(rows: list[bytes]) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    own = [np.frombuffer(r, np.float64) for r in rows]
    out = np.zeros((len(own), max(map(len, own), default=0)))
    for k, v in enumerate(own):
        out[k, : len(v)] = v
    return out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))


def scaled(embeddings: DataFrame) -> DataFrame:
    """vec_id and the vector floor(256 * x) as packed doubles; one row per vec_id."""
    good = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < float("inf"))
    )
    rows = embeddings.where(good & F.col("vec_id").isNotNull()).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(
        F.min(F.col("embedding").cast("array<double>")).alias("embedding")
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors = [np.floor(SCALE * np.array(v, np.float64)).tobytes() for v in batch.column("embedding").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(vectors, pa.binary())], names=["vec_id", "vector"])

    return map_batches(rows, run, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("vector", T.BinaryType())]))


def _in_cells(vectors: DataFrame, n: int) -> DataFrame:
    """vec_id, vector, cell: that of the nearest pivot of a bounded sample."""
    widest = vectors.agg(F.max(F.octet_length("vector"))).first()[0] or 8
    wanted = max(1, min(-(-n // BLOCK), PIVOTS, PIVOT_NUMBERS * 8 // max(8, widest)))
    sample = vectors.orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(wanted).collect()
    pivots = _matrix([r["vector"] for r in sample])
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        points, centres = _same_width(_matrix(batch.column("vector").to_pylist()), shared.value)
        cell = ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1) if len(centres) else np.zeros(len(points), np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], names=["vec_id", "vector", "cell"])

    return map_batches(vectors, run, T.StructType([*vectors.schema.fields, T.StructField("cell", T.LongType())]))


_BLOCKS = "cell long, part long, ids binary, points binary, tree binary, root binary, queries binary, query_root binary, worst double"


def _blocks(cells: DataFrame, k: int) -> DataFrame:
    """A row for each block: its ids, points and tree, and the same of the queries in it with their worst kth score."""
    sizes = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    dealt = cells.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).drop("parts")

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id")
        ids, points = frame["vec_id"].to_numpy(np.int64), _matrix(frame["vector"].tolist())
        tree, asked = CoverTree(points), frame["asked"].to_numpy(bool)
        queries, query_root, worst = None, None, None
        if asked.any():
            own_ids, own = ids[asked], points[asked]
            query_tree, best = CoverTree(own), Best(own_ids, own, k)
            if _fits(own, points):
                dual_search(best, query_tree, ids, points, tree)
            floor = best.score[:, -1]
            queries = pickle.dumps((own_ids, own, query_tree, floor))
            query_root, worst = pickle.dumps(_root(query_tree)), float(floor.min())
        return pd.DataFrame({"cell": frame["cell"].iloc[:1], "part": frame["part"].iloc[:1], "ids": [ids.tobytes()], "points": [pickle.dumps(points)],
                             "tree": [pickle.dumps(tree)], "root": [pickle.dumps(_root(tree))], "queries": [queries],
                             "query_root": [query_root], "worst": [worst]})

    return dealt.groupBy("cell", "part").applyInPandas(build, _BLOCKS)


def _fits(queries: np.ndarray, points: np.ndarray) -> bool:
    """Whether all inner products are exact in doubles."""
    return not points.size or np.abs(queries).max(initial=0) * np.abs(points).max(initial=0) * points.shape[1] < _EXACT


def _root(tree: CoverTree) -> tuple:
    return tree.centre[0], tree.radius[0], tree.norm[0], tree.centre_norm[0]


class _Roots:
    """Roots of many trees, side by side, in the form that ``bound`` reads."""

    def __init__(self, packed: list[bytes], width: int = 0):
        roots = [pickle.loads(p) for p in packed]
        self.centre = np.zeros((len(roots), max([width, *(len(r[0]) for r in roots)])))
        for k, r in enumerate(roots):
            self.centre[k, : len(r[0])] = r[0]
        self.radius, self.norm, self.centre_norm = (np.array([r[c] for r in roots]) for c in (1, 2, 3))


def _each(n: int) -> Column:
    """A row for each number below ``n``, as a long: cogrouped keys must be of one type."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def top_k(embeddings: DataFrame, asked: Column, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` best other vectors of every row that ``asked`` (of vec_id) picks.

    Scores are inner products of the vectors floor(256 * x); ties go to the smaller
    vec_id. Null vectors, vectors that hold a null or a number that is not finite, or not when times 256, and
    rows without vec_id take no part. Rows that repeat a vec_id count once, with
    the smallest vector. Of vectors of different length the shorter is filled up
    with zeros. Scores beyond the range of a long are held at its ends
    and compared so. Other columns take no part. With fewer than ``k`` others, all are returned.
    """
    vectors = written(scaled(embeddings), "vectors")
    cells = _in_cells(vectors, vectors.count()).withColumn("asked", asked)
    blocks = written(_blocks(cells, k), "blocks")
    number = F.xxhash64("cell", "part")
    # Query trees are dealt to chunks; a data block meets each chunk once.
    asking = blocks.where("queries IS NOT NULL")
    chunks = max(1, -(-asking.count() // GROUPS))
    groups = asking.select(F.pmod(number, F.lit(chunks)).cast("long").alias("chunk"), F.col("cell").alias("q_cell"), F.col("part").alias("q_part"),
                           "queries", "query_root", "worst")
    places = blocks.select("cell", "part", "root", _each(chunks).alias("chunk"))

    def near(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["cell", "part", "q_cell", "q_part"], dtype="int64")
        x, q = _Roots(left["root"].tolist()), _Roots(right["query_root"].tolist())
        q.centre, x.centre = _same_width(q.centre, x.centre)
        b = (q.centre @ x.centre.T + q.radius[:, None] * x.centre_norm + x.radius * q.centre_norm[:, None] + q.radius[:, None] * x.radius)
        b = np.minimum(b, q.norm[:, None] * x.norm)
        i, j = np.nonzero(~(b + 1e-9 * np.abs(b) + 1e-6 < right["worst"].to_numpy()[:, None]))
        return pd.DataFrame({"cell": left["cell"].to_numpy()[j], "part": left["part"].to_numpy()[j],
                             "q_cell": right["q_cell"].to_numpy()[i], "q_part": right["q_part"].to_numpy()[i]})

    # Roots only: a chunk's query roots against slices of the data blocks' roots.
    slices = max(1, -(-blocks.count() // (8 * GROUPS)))
    sliced = places.withColumn("slice", F.pmod(F.xxhash64(F.lit(9), "cell", "part"), F.lit(slices)).cast("long"))
    asked_roots = groups.select("chunk", "q_cell", "q_part", "query_root", "worst").withColumn("slice", _each(slices))
    pairs = written(sliced.groupBy("chunk", "slice").cogroup(asked_roots.groupBy("chunk", "slice")).applyInPandas(
        near, "cell long, part long, q_cell long, q_part long"
    ), "block-pairs")
    sent = pairs.join(groups.select("chunk", "q_cell", "q_part", "queries"), ["q_cell", "q_part"]).select("cell", "part", "chunk", "queries")

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        for ids, packed, own_tree in zip(left["ids"], left["points"], left["tree"], strict=True):
            ids, points, tree = np.frombuffer(ids, np.int64), pickle.loads(packed), pickle.loads(own_tree)
            for group in right["queries"]:
                q_ids, q_points, q_tree, floor = pickle.loads(group)
                wide_q, wide_x = _same_width(q_points, points)
                if not _fits(wide_q, wide_x):
                    for q, point in zip(q_ids, wide_q, strict=True):
                        score = exact_scores(point, wide_x)
                        top = [r for r in sorted(range(len(ids)), key=lambda r: (-score[r], ids[r])) if ids[r] != q][:k]
                        out.append(pd.DataFrame({"query_id": q, "vec_id": ids[top], "score": [int(score[r]) for r in top]}, dtype="int64"))
                    continue
                best = Best(q_ids, wide_q, k, floor)
                dual_search(best, q_tree.place(wide_q), ids, wide_x, tree.place(wide_x))
                hit = best.score >= np.maximum(floor, np.finfo(float).min)[:, None]
                rows = np.nonzero(hit)[0]
                out.append(pd.DataFrame({"query_id": q_ids[rows], "vec_id": best.found[hit], "score": best.score[hit].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame(columns=["query_id", "vec_id", "score"], dtype="int64")

    # A block is copied to those chunks only that have a query tree for it.
    by = ["cell", "part", "chunk"]
    wanted = pairs.select("cell", "part", F.pmod(F.xxhash64("q_cell", "q_part"), F.lit(chunks)).cast("long").alias("chunk")).distinct()
    data = blocks.select("cell", "part", "ids", "points", "tree").join(wanted, ["cell", "part"])
    found = data.groupBy(*by).cogroup(sent.groupBy(*by)).applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
