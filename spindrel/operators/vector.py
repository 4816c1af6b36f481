"""Cosine top-k of a set of query vectors over a collection: exact, filtered, and approximate by cells."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrel.config import IndexSettings
from spindrel.errors import EmptyCollectionError, StoreError

#: Query vectors that one pass over the collection takes along; each further block is another pass.
QUERY_BLOCK = 4096
#: Decimals by which scores rank: equal to this many, they tie and the lesser id comes first.
DECIMALS = 9
#: Scores that a task computes at a time, and rows found that it holds: its memory grows neither with queries nor rows.
TILE, HELD = 1 << 20, 1 << 21


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def check_k(k: int) -> int:
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise StoreError(f"k must be a whole number from 1 on: {k!r}")
    return k


def violations(collection: DataFrame, dimension: int, vector: str = "vector", tolerance: float = 1e-3) -> DataFrame:
    """One row of counts: rows, null vectors, wrong dimension, not finite, not of unit norm."""
    v = F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    bad = lambda c: F.count_if(c).alias
    return collection.agg(
        F.count(F.lit(1)).alias("n_rows"),
        bad(v.isNull())("n_null"),
        bad(F.size(v) != dimension)("n_dimension"),
        bad(F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))("n_not_finite"),
        bad(F.abs(norm - 1) > tolerance)("n_norm"),
    )


def matrix_of(column: pa.Array) -> np.ndarray:
    """A column of vectors of one dimension as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if column.null_count or len(flat) % max(1, len(column)) or len(set(np.diff(column.offsets.to_numpy()).tolist())) > 1:
        raise StoreError("vectors are missing or differ in dimension")
    return flat.reshape(len(column), -1)


class _Best:
    """The k best (score, then least id) of each query so far."""

    def __init__(self, n: int, k: int, own: np.ndarray | None = None) -> None:
        """own: for each query an id that doesn't count."""
        self.k, self.own = k, own
        self.bar, self.last = np.full(n, -np.inf), np.zeros(n, np.int64)  # score and id of each query's k-th
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, places: np.ndarray | None = None) -> None:
        """scores: queries x rows, not rounded, -inf where a row doesn't count; places: of these queries, all if None."""
        places = np.arange(len(self.bar)) if places is None else places
        bar, n = self.bar[places], self.k + (self.own is not None)
        fresh = bar == -np.inf
        if scores.shape[1] > n and fresh.any():  # rows that tie with the k-th stay: ids decide
            bar[fresh] = np.partition(scores if fresh.all() else scores[fresh], -n, axis=1)[:, -n]
        q, c = np.nonzero(scores >= (bar - 2 * 10.0**-DECIMALS)[:, None])
        score, q, ids = np.round(scores[q, c], DECIMALS) + 0.0, places[q], ids[c]
        keep = (score > self.bar[q]) | ((score == self.bar[q]) & (score > -np.inf) & (ids < self.last[q]))
        if self.own is not None:
            keep &= ids != self.own[q]
        self.parts.append((q[keep], score[keep], ids[keep]))
        self.held += int(keep.sum())
        if self.held > min(HELD, 4 * self.k * len(self.bar) + 4096):
            self.shrink()

    def shrink(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, score, ids = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.bar[q[last]], self.last[q[last]] = score[last], ids[last]
        keep = place < self.k
        self.parts, self.held = [(q[keep], score[keep], ids[keep])], int(keep.sum())
        return self.parts[0]

    def taken(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is held, which is held no longer. The bars stay: as many rows as good have gone on."""
        out = self.shrink()
        self.parts, self.held = [], 0
        return out


def tiles(groups: pa.Array, asked: Callable[[object], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of queries and of rows that are to be held against each other, TILE scores at a time. asked: the places of the
    queries that want rows of a group."""
    if isinstance(groups, pa.ChunkedArray):
        groups = groups.combine_chunks()
    coded = groups.dictionary_encode(null_encoding="encode")
    codes = coded.indices.to_numpy(zero_copy_only=False)
    order, ends = np.argsort(codes, kind="stable"), np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))
    for value, low, high in zip(coded.dictionary.to_pylist(), [0, *ends], ends, strict=False):
        places = asked(value)
        step = max(1, TILE // max(1, len(places)))
        for at in range(low, high if len(places) else low, step):
            yield places, order[at : min(high, at + step)]


def places_of(values: list) -> dict[object, np.ndarray]:
    """Where each value stands."""
    found: dict[object, list[int]] = {}
    for n, value in enumerate(values):
        found.setdefault(value, []).append(n)
    return {value: np.array(at) for value, at in found.items()}


def found_rows(ids: np.ndarray, best: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    q, score, found = best
    return pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(q), pa.array(found), pa.array(score)], names=[c.split()[0] for c in FOUND.split(", ")])


def _local_top(shared, k: int, skip_self: bool):
    """The best k of each query among the task's rows. shared: (ids, brands or None, matrix, cells or None) of the
    queries; brands restrict the rows of a query to those with its brand, cells to the cells that it visits. With several
    numbers of visited cells there are so many times more ids and rows of cells than vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, brands, matrix, cells = shared.value
        best = _Best(len(ids), k, ids if skip_self else None)
        every, none = np.arange(len(ids)), np.zeros(0, np.int64)
        of = {} if brands is None else places_of(brands)
        asked = (lambda cell: np.flatnonzero(cells[:, cell])) if cells is not None else (lambda _: every) if brands is None else lambda brand: of.get(brand, none)
        for batch in batches:
            if not batch.num_rows:
                continue
            mine, vectors = batch.column(0).to_numpy(zero_copy_only=False), matrix_of(batch.column(2))
            for places, at in tiles(batch.column(1), asked):
                best.add(matrix[places % len(matrix)] @ vectors[at].T, mine[at], places)
                if best.held > HELD // 2:
                    yield found_rows(ids, best.taken())
        if best.parts:
            yield found_rows(ids, best.taken())

    return run


FOUND = "query_id long, place long, product_id long, score double"


def _ranked(found: DataFrame, k: int, keys: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "product_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def least_of_each(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The rows with the n least product ids of each group: those that can be in a ranking of n if its rows tie."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("product_id"))
    return rows.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


def blocks(rows: Iterator) -> Iterator[list]:
    """QUERY_BLOCK rows at a time."""
    while block := list(itertools.islice(rows, QUERY_BLOCK)):
        yield block


def query_blocks(queries: DataFrame, names: list[str], dimension: int) -> Iterator[tuple[list, np.ndarray]]:
    """(rows, matrix) of QUERY_BLOCK queries at a time; one block is on the driver at a time."""
    for held in blocks(queries.select(*names).toLocalIterator()):
        if any(r["vector"] is None or len(r["vector"]) != dimension for r in held):
            raise StoreError(f"a query vector hasn't the collection's {dimension} dimensions")
        yield held, np.array([r["vector"] for r in held], float)


def dimension_of(collection: DataFrame) -> int:
    first = collection.select(F.size("vector").alias("n")).first()
    if first is None:
        raise EmptyCollectionError("the collection has no rows")
    return first["n"]


def exact_topk(queries: DataFrame, collection: DataFrame, k: int, brand: bool = False, skip_self: bool = False) -> DataFrame:
    """query_id, rank, product_id, score of the k best rows by dot product of unit vectors.

    queries: query_id, vector (and brand); collection: product_id, vector (and brand). The brand is part of the query:
    only rows with it are ranked, and a brand without rows gives no rows. Ties rank by product_id. QUERY_BLOCK queries
    at a time go along as a broadcast matrix; each block is a pass over the collection in which a task returns k rows a
    query, so the collection is never shuffled.
    """
    check_k(k)
    dimension = dimension_of(collection)
    rows = collection.select("product_id", F.col("brand") if brand else F.lit(None).cast("string").alias("brand"), F.col("vector").cast("array<double>").alias("vector"))
    context, found = rows.sparkSession.sparkContext, None
    for block, matrix in query_blocks(queries, ["query_id", *(["brand"] if brand else []), "vector"], dimension):
        shared = context.broadcast((np.array([r["query_id"] for r in block]), [r["brand"] for r in block] if brand else None, matrix, None))
        part = rows.mapInArrow(_local_top(shared, k, skip_self), FOUND)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], FOUND)
    return _ranked(found, k, ["query_id"]).select("query_id", "rank", "product_id", "score")


def hits(ranked: DataFrame, payload: DataFrame) -> DataFrame:
    """Ranked rows with their metadata, the kind of score and its direction."""
    return ranked.join(payload, "product_id").withColumns({"score_kind": F.lit("similarity"), "higher_is_better": F.lit(True)})


def _nearest(pivots: np.ndarray, vectors: np.ndarray, n: int) -> np.ndarray:
    """The n nearest pivots of each vector, the first among equals."""
    step, out = max(1, TILE // len(pivots)), [np.zeros((0, n), np.int64)]
    for at in range(0, len(vectors), step):
        scores = np.round(vectors[at : at + step] @ pivots.T, DECIMALS) + 0.0
        out.append(np.argmax(scores, axis=1)[:, None] if n == 1 else np.argsort(-scores, axis=1, kind="stable")[:, :n])
    return np.concatenate(out)


def _assigned(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = _nearest(shared.value, matrix_of(batch.column("vector")), 1)[:, 0] if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "cell"])

    return run


class CellIndex:
    """Rows dealt to the cell of their nearest pivot, written once, a folder for each cell.

    Pivots are the vectors of a bounded sample: the rows with the least MD5 of their id, as many as the settings say, or
    about the square root of the number of rows. Every row is indexed, in one pass and without a join. A search reads
    the cells that its queries visit.
    """

    def __init__(self, collection: DataFrame, where: str, settings: IndexSettings | None = None) -> None:
        settings = settings or IndexSettings()
        spark = collection.sparkSession
        rows = collection.select("product_id", F.col("vector").cast("array<double>").alias("vector"))
        seen = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
        if not seen["n"]:
            raise EmptyCollectionError("the collection has no rows")
        if seen["low"] != seen["high"] or seen["low"] < 1:
            raise StoreError("vectors are missing or differ in dimension")
        self.settings, self.where, self.dimension = settings, where, seen["low"]
        self.cells = min(settings.sample, settings.cells or math.ceil(math.sqrt(seen["n"])))
        sample = rows.withColumn("h", F.md5(F.col("product_id").cast("string"))).orderBy("h", "product_id").limit(self.cells).collect()
        self.pivots = np.array([r["vector"] for r in sample], float)
        self.cells = len(self.pivots)
        kind = rows.schema["product_id"].dataType.simpleString()
        dealt = rows.mapInArrow(_assigned(spark.sparkContext.broadcast(self.pivots)), f"product_id {kind}, vector array<double>, cell int")
        dealt.hint("rebalance", "cell").write.partitionBy("cell").parquet(where)
        self.rows = spark.read.schema(f"product_id {kind}, vector array<double>, cell int").parquet(where)

    def search(self, queries: DataFrame, k: int, probes: int | list[int] | None = None, skip_self: bool = False) -> DataFrame:
        """query_id, probes, rank, product_id, score: the k best rows of the cells nearest to each query; all cells give
        the exact result. Several numbers of probes are searched in one pass."""
        check_k(k)
        many = [probes or self.settings.probes] if not isinstance(probes, list) else probes
        if any(n < 1 for n in many):
            raise StoreError("a search visits one cell at least")
        context, out = self.rows.sparkSession.sparkContext, None
        for block, matrix in query_blocks(queries, ["query_id", "vector"], self.dimension):
            near = _nearest(self.pivots, matrix, min(self.cells, max(many)))
            visits = np.zeros((len(many) * len(block), self.cells), bool)
            for m, n in enumerate(many):
                np.put_along_axis(visits[m * len(block) : (m + 1) * len(block)], near[:, :n], True, axis=1)
            shared = context.broadcast((np.tile([r["query_id"] for r in block], len(many)), None, matrix, visits))
            rows = self.rows
            if not visits.any(0).all():
                rows = rows.where(F.col("cell").isin(np.flatnonzero(visits.any(0)).tolist()))
            part = rows.select("product_id", "cell", "vector").mapInArrow(_local_top(shared, k, skip_self), FOUND)
            numbers = F.array(*[F.lit(n) for n in many])
            part = part.withColumn("probes", F.element_at(numbers, (F.floor(F.col("place") / len(block)) + 1).cast("int")))
            out = part if out is None else out.unionByName(part)
        if out is None:
            out = self.rows.sparkSession.createDataFrame([], FOUND + ", probes int")
        return _ranked(out, k, ["probes", "query_id"]).select("query_id", "probes", "rank", "product_id", "score")
