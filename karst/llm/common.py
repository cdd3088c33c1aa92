"""Shared helpers: scratch tables in the cluster's shared folder, and vectorised work on UTF-8 buffers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --------------------------------------------------------------------------- scratch tables


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, one of our own on a local master, else an error:
    a folder of one machine would hide each executor's files from the others."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = found.get() if found.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file:///tmp/karst-scratch"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Scratch:
    """Parquet tables under the shared folder, written once so that every later reader sees the same rows.

    A result is read from them, so they stay until release(), or until the driver's JVM ends, session or not.
    """

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str, kept: bool = False):
        """kept: release() leaves it."""
        self.spark = spark
        self.root = f"{shared_folder(spark)}/karst-{name}-{uuid.uuid4().hex}"
        fs, where = self._place()
        fs.mkdirs(where)
        fs.deleteOnExit(where)
        if not kept:
            Scratch.made.append(self)

    def _place(self, table: str = ""):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(table) if table else self.root)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write(self, df: DataFrame, table: str, codec: str = "zstd") -> DataFrame:
        path = self.path(table)
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, table: str = "") -> None:
        fs, where = self._place(table)
        fs.delete(where, True)


def release(spark: SparkSession) -> None:
    """Drops all scratch tables made so far; for callers that have written what they wanted from them."""
    while Scratch.made:
        Scratch.made.pop().drop()


def buckets(spark: SparkSession) -> int:
    """How many even blocks hot groups are cut into: as many as the session's shuffles have partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def gapless(df: DataFrame, group: list[str], order: list, block, name: str, start: int = 0) -> DataFrame:
    """Adds a gapless rank within each group as column `name`, without gathering a group in one task.

    `block` is an int column that is non-decreasing in the order, so that a hot group is spread over its
    blocks: only the blocks' row counts are summed up per group (one row per block), never the rows.
    """
    from pyspark.sql import Window as W

    b, o = "__block", "__before"
    cut = df.withColumn(b, block)
    sizes = cut.groupBy(*group, b).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
        F.col(b).alias("__b"),
        (F.sum("__n").over(W.partitionBy(*group).orderBy(b).rowsBetween(W.unboundedPreceding, -1))).alias(o),
    )
    same = F.col(b) == F.col("__b")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    ranked = cut.withColumn(name, F.row_number().over(W.partitionBy(*group, b).orderBy(*order)) - 1)
    return (
        ranked.join(before, same)
        .withColumn(name, F.col(name) + F.coalesce(F.col(o), F.lit(0)) + F.lit(start))
        .drop(b, "__b", o, *[f"__g{i}" for i in range(len(group))])
    )


def tidied(work: Callable) -> Callable:
    """A function of Arrow batches that gives freed memory back to the system when it is done: Python workers are kept
    for later tasks, and would hold it meanwhile."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


# --------------------------------------------------------------------------- UTF-8 buffers

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's bounds in them; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20):
    """Cuts a batch by rows so that the column holds about `limit` bytes at most (one longer text stays whole)."""
    _, at = utf8(batch.column(column))
    n, i = batch.num_rows, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


class _Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    up = np.ones(1, U)
    down = np.ones(1, U)

    @classmethod
    def reach(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n + 1:
            size = 1 << int(n + 1).bit_length()
            step = np.full(size, _BASE, U)
            step[0] = 1
            back = np.full(size, _INVERSE, U)
            back[0] = 1
            cls.up, cls.down = np.multiply.accumulate(step), np.multiply.accumulate(back)
        return cls.up, cls.down


_BYTES = np.random.Generator(np.random.PCG64(20240101)).integers(0, 1 << 64, 256, dtype=U) | U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix(raw: np.ndarray) -> np.ndarray:
    """Prefix sums from which range_hash takes the hash of any byte range."""
    _, down = _Powers.reach(len(raw))
    out = np.zeros(len(raw) + 1, U)
    np.cumsum(_BYTES[raw] * down[: len(raw)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges; equal ranges have equal hashes wherever they stand."""
    up, _ = _Powers.reach(len(sums))
    return mix((sums[end] - sums[begin]) * up[begin] + (end - begin).astype(U) * U(0xD6E8FEB86659FD93))


def words(raw: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each run of word bytes, and the row each run is in; runs don't cross rows.

    is_word: 256 booleans, by byte.
    """
    n = len(raw)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, none
    inside = is_word[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    begin = np.flatnonzero(begins)
    return begin, np.flatnonzero(ends) + 1, np.searchsorted(at, begin, side="right") - 1


#: Bytes of [^\x20\x09-\x0D]; every byte of a longer UTF-8 sequence counts.
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

WORD = r"[^\x20\x09-\x0D]+"


def shingles(word_hash: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of k words, and the index of each window's first word."""
    n = len(word_hash)
    if n < k:
        return np.empty(0, U), np.empty(0, np.int64)
    m = n - k + 1
    total = np.zeros(m, U)
    for t in range(k):
        total += word_hash[t : t + m] * U((0xD1342543DE82EF95 * (2 * t + 1)) & 0xFFFFFFFFFFFFFFFF)
    whole = np.flatnonzero(row[:m] == row[k - 1 :])
    return mix(total[whole]), whole
