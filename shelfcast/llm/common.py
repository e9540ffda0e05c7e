"""Shared helpers: the cluster's shared folder, written tables, Arrow passes, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a maximal run without ASCII blanks; ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of input that a Python function gets at once, so that what it makes of them stays small.
PART = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a private one only for a local master without it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="shelfcast-llm-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, and where it is: lineage ends there and lost executors cost nothing."""
    path = fresh_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, what: str) -> DataFrame:
    return stored(df, what)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table that no plan reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores before it until no column of ``df`` has the name."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8 bytes, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def lists(column: pa.Array) -> tuple[pa.Array, list[int]]:
    """(values of a list column end to end, where each list begins and the last ends)."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    return column.flatten(), np.concatenate(([0], np.cumsum(sizes))).tolist()


def list_array(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(v) for v in values])))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values), kind))


def pack(texts: list[bytes]) -> pa.Array:
    """Texts under zstd, for those that have to travel: half the size that shuffles' own compression leaves."""
    press = zstandard.ZstdCompressor(level=3).compress
    return pa.array(map(press, texts), pa.binary())


def unpack(column: pa.Array) -> list[bytes]:
    out = zstandard.ZstdDecompressor().decompress
    return [out(x) for x in column.to_pylist()]


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType, part: int = PART
) -> DataFrame:
    """``mapInArrow`` with a function of one record batch, handed over in parts of about ``part`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, batch.num_rows * part // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def spread(df: DataFrame, per_task: int) -> int:
    """Tasks for rows dealt anew: the session's shuffle partitions, and more when the count asks for it."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // per_task))


_K1, _K2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), elementwise on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _K1
        x = (x ^ (x >> np.uint64(27))) * _K2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound; ``array`` gives those of a list."""

    LIMIT, LONGEST = 500_000, 64

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = value
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Rolling:
    """Polynomial hashes modulo 2**64 of all runs of ``width`` consecutive values, in a few array passes."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(0, np.uint64)

    def __call__(self, values: np.ndarray, width: int) -> np.ndarray:
        n = len(values)
        if n < width:
            return np.zeros(0, np.uint64)
        self._grow(n)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * self.down[:n], dtype=np.uint64)))
        return mix64((sums[width:] - sums[:-width]) * self.up[: n - width + 1])

    def _grow(self, n: int) -> None:
        """Powers for n values."""
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            powers = [np.full(size, b, np.uint64) for b in (self.base, self.inverse)]
            for p in powers:
                p[0] = 1
            self.up, self.down = (np.multiply.accumulate(p) for p in powers)

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the runs [start, end)."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        self._grow(len(values))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * self.down[: len(values)], dtype=np.uint64)))
        return mix64((sums[ends] - sums[starts]) * self.up[starts])
