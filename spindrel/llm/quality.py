"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader.

Tokens are words and runs of other signs. Features are hashed n-grams of tokens (1 and 2), of their shapes (1 to 3) and
of "same as one or two tokens before" marks; a feature's value is its share of the text's tokens. A score is the
sparse dot product of the shares with the weights, taken over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.llm import words as W
from spindrel.llm.common import release, slices, staged, text_bytes

#: The model is fitted on at most this many labelled documents, those with the least hash of doc_id, and on as many of
#: them as have features of so many bytes together.
TRAIN_ROWS, TRAIN_BYTES = 4000, 256 << 20
#: Feature slots, and the factor of all feature values.
SLOTS, SCALE = 1 << 18, 20.0

_KIND = np.full(256, 1, np.uint8)  # 1 lower case and digits and what isn't ASCII, 2 upper case, 3 signs, 0 blanks
_KIND[list(range(0, 33)) + [127]] = 0
_KIND[65:91] = 2
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, shape 0 to 6, first token of each text and the end)."""
    kind = _KIND[data]
    group = kind.copy()
    group[group == 2] = 1
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = group[1:] != group[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    real = group[starts] != 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[real], ends[real]
    firsts = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), firsts
    up, down = W._power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(W._RANDOM[W._FOLD[data]] * up[: len(data)], out=sums[1:])
    hashes = W.mix((sums[ends] - sums[starts]) * down[starts])
    uppers = np.r_[0, np.cumsum(kind == 2)]
    n_upper, size = uppers[ends] - uppers[starts], ends - starts
    digit = (data[starts] >= 48) & (data[starts] <= 57)
    shape = np.select([kind[starts] == 3, digit, n_upper == 0, (n_upper > 1) & (2 * n_upper >= size), kind[starts] == 2], [np.where(size > 1, 1, 0), 2, 3, 4, 5], 6)
    return hashes, shape.astype(np.int64), firsts


def _shifted(x: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[k:] = x[:-k]
    return out


def features(hashes: np.ndarray, shape: np.ndarray, firsts: np.ndarray) -> list[np.ndarray]:
    """Slots, one array for each template, each with a slot for every token; n-grams don't reach over a text's start."""
    n = len(hashes)
    place = np.arange(n) - np.repeat(firsts[:-1], np.diff(firsts))
    one, two = place >= 1, place >= 2
    before = np.where(one, _shifted(hashes, 1), np.uint64(0)) if n else hashes
    before2 = np.where(two, _shifted(hashes, 2), np.uint64(0)) if n else hashes
    s1 = np.where(one, _shifted(shape, 1), 7) if n else shape
    s2 = np.where(two, _shifted(shape, 2), 7) if n else shape
    same = (hashes == before).astype(np.int64) + 2 * (hashes == before2)
    small = [shape, 8 + shape * 8 + s1, 128 + (shape * 8 + s1) * 8 + s2, 1024 + same]
    large = [hashes, W.mix(before * W._WEIGHTS[0] + hashes)]
    return [*small, *((x % np.uint64(SLOTS - 2048)).astype(np.int64) + 2048 for x in large)]


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        """Scores of whole texts from 0 to 1; an empty or null text gets the bias alone."""
        data, offsets = text_bytes(column)
        out = np.full(len(column), self.bias)
        for i, j in slices(offsets, W.CHUNK):
            part = offsets[i : j + 1]
            hashes, shape, firsts = tokens(data[part[0] : part[-1]], part - part[0])
            if not len(hashes):
                continue
            each = np.zeros(len(hashes) + 1)
            np.cumsum(sum(self.weights[x] for x in features(hashes, shape, firsts)), out=each[1:])
            size = np.diff(firsts)
            out[i:j] += np.where(size > 0, SCALE * (each[firsts[1:]] - each[firsts[:-1]]) / np.maximum(size, 1), 0)
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 6, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> Model:
    """FTRL-Proximal with a learning rate for each weight. examples: (distinct slots, values, label)."""
    z, n, last = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1), SLOTS

    def solve(at: np.ndarray) -> np.ndarray:
        free = np.where(at == last, 0.0, l1)
        return np.where(np.abs(z[at]) <= free, 0.0, -(z[at] - np.sign(z[at]) * free) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for slots, values, label in examples:
            at, x = np.append(slots, last), np.append(values, 1.0)
            w = solve(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -40, 40))) - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = solve(np.arange(SLOTS + 1))
    return Model(w[:-1], float(w[-1]))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of each document once a task."""
    seen: set[int] = set()
    for batch in batches:
        fresh = [k for k, d in enumerate(batch.column("doc_id").to_pylist()) if d not in seen and not seen.add(d)]
        batch = batch.take(pa.array(fresh, pa.int64()))
        data, offsets = text_bytes(batch.column("text"))
        slots, values = [], []
        for i, j in slices(offsets, W.CHUNK):
            part = offsets[i : j + 1]
            hashes, shape, firsts = tokens(data[part[0] : part[-1]], part - part[0])
            every = features(hashes, shape, firsts)
            for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
                slot, count = np.unique(np.concatenate([x[a:b] for x in every]), return_counts=True)
                slots.append(slot.astype(np.int32).tobytes())
                values.append((SCALE * count / max(1, b - a)).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "order", "label")), pa.array(slots, pa.binary()), pa.array(values, pa.binary())], names=["doc_id", "order", "label", "slots", "values"])
    release()


def held_out(doc_id):
    """crc32(doc_id as text) mod 3 is 1: such rows never train. False for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """A model of the labelled rows that aren't held out, at most `rows` documents; null labels are left out.

    Of a doc_id with several labels the least counts, of one with several texts that with the least hash. Without any
    label all scores are 0.5.
    """
    order = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = chosen.withColumn("order", order).orderBy("order", "doc_id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = staged(texts.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("hash")), "training-texts")
    texts = texts.join(F.broadcast(one), "doc_id").where(F.xxhash64("text") == F.col("hash"))
    each = texts.select("doc_id", "order", "label", "text").mapInArrow(_examples, "doc_id long, order long, label int, slots binary, values binary")
    each = staged(each.groupBy("doc_id", "order", "label").agg(F.first(F.struct("slots", "values")).alias("f")).select("doc_id", "order", "label", "f.*"), "training-rows")
    sizes = sorted(tuple(r) for r in each.select("order", "doc_id", F.length("slots") + F.length("values")).collect())  # at most `rows`
    fit_in = np.searchsorted(np.cumsum([n for _, _, n in sizes]), TRAIN_BYTES, side="right")
    found = each.where(F.col("order") <= sizes[fit_in - 1][0]).collect() if fit_in else []
    found.sort(key=lambda r: (r["order"], r["doc_id"]))
    return fit([(np.frombuffer(r["slots"], np.int32), np.frombuffer(r["values"], np.float32).astype(float), int(r["label"] > 0)) for r in found])


def scorer(docs: DataFrame, model: Model):
    """A column function: text to score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(text))

    return score


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    A null or empty text gets the score of the bias alone. Rows that repeat an id are each scored by their own text; a
    null id is not held out. Texts are scored whole; columns of docs with the names of the result are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), scorer(docs, model)(F.col(text_col)).alias("score"))
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", bar: float = 0.5) -> DataFrame:
    """The rows of docs with a score of at least `bar`, with all their columns."""
    return docs.where(scorer(docs, model)(F.col(text_col)) >= bar)
