"""What the operators share: written stages, checked broadcasts, joins that a hot key can't stop, components.

No function here collects rows of the corpus.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.workspace import BROADCAST_ROWS, in_few_files, remove, scratch, shared_dir, small_or_shuffled, staged

__all__ = ["BROADCAST_ROWS", "remove", "scratch", "shared_dir", "small_or_shuffled", "staged"]

#: A key with more than 1/HOT_SHARE of all rows is hot: there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000
#: White space of every contract: U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: What operators hold in a Python worker from task to task. Workers outlive operators.
HELD: list[dict] = []


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most `rows` rows for the jobs that run inside: for long binary values."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def attach(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows left-joined with facts, which has one row per key; size names the column with the key's number of rows.

    Keys with more than total / HOT_SHARE rows (at most HOT_SHARE of them) are broadcast, so that their rows stay
    where they are; all other keys are shuffled. facts is read twice: pass a staged table.
    """
    bar = max(100, total // HOT_SHARE)
    hot, cold = F.broadcast(facts.where(F.col(size) > bar)), facts.where(F.col(size) <= bar)
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(facts.where(F.col(size) > bar).select(key)), key, "left_anti").join(cold, key, "left"))


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't in ids (a staged table of distinct keys). Null keys stay."""
    return rows.join(small_or_shuffled(ids), key, "left_anti")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column in UTF-8, without copying; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def release(own: dict | None = None) -> None:
    """Gives memory of a Python worker back, at the end of a task: workers live on, and share an executor's limit.

    What other operators hold from task to task goes too; own is what the caller holds.
    """
    for held in HELD:
        if held is not own:
            held.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `most` bytes each; a longer text stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, end
        at = end


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the least node reachable. Both columns are long.

    Alternating large-star and small-star steps (Kiveris et al., 2014) until only stars are left, each step written to
    the shared folder; the number of steps grows with the logarithm of the longest path. Before the first step, each
    task contracts the edges it holds to a forest, so that a dense group arrives as a star.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").mapInArrow(_forest, "a long, b long")
    now, path = _written(pairs.distinct(), name)
    while not _stars(now):
        total = now.count()
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("size")).withColumn("m", F.least("a", "m"))
        least, least_path = _written(least, name, 2 * total)
        # Large star: each larger neighbour of a node is joined with the node's least neighbour.
        large = attach(both.where("b > a"), least, "a", "size", max(1, 2 * total)).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large, large_path = _written(large, name, 2 * total)
        # Small star: each smaller neighbour, and the node itself, is joined with the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("size"))
        low, low_path = _written(low, name, 2 * total)
        step = attach(large, low, "a", "size", max(1, total)).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now, after = _written(step.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), name, 4 * total)
        for x in (path, least_path, large_path, low_path):
            remove(spark, x)
        path = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one lesser neighbour and no greater one, or no lesser one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    return ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")).where("child > 1 or (child = 1 and parent = 1)").isEmpty()


def _written(df: DataFrame, name: str, rows: int | None = None) -> tuple[DataFrame, str]:
    where = scratch(df.sparkSession, name)
    (df if rows is None else in_few_files(df, rows)).write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where), where


class UnionFind:
    """Over 0 .. n-1; the root is the least member."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's edges as stars of its own components."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
        sets = UnionFind(len(nodes))
        for x, y in zip(flat[: len(a)].tolist(), flat[len(a) :].tolist(), strict=True):
            sets.join(x, y)
        roots = np.fromiter((sets.find(i) for i in range(len(nodes))), np.int64, len(nodes))
        away = roots != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[away]), pa.array(nodes[roots[away]])], names=["a", "b"])
