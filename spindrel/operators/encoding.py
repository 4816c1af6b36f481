"""Encoders: text columns to unit vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.errors import EncodingError
from spindrel.functions import scalars as S

TOKEN = r"([\p{L}\p{N}_]{2,})"
#: Tokens that a task works on at a time, unless one text has more.
TOKENS = 1 << 18


def in_spans(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of TOKENS entries of a column of lists, or of one row."""
    offsets, at = batch.column(column).offsets.to_numpy(), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + TOKENS, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


class Encoder(Protocol):
    """Adds a column `vector` of unit vectors to rows with a text."""

    dimension: int

    def encode(self, rows: DataFrame, key: str, text: str) -> DataFrame: ...


class HashingEncoder:
    """Token counts by hash bucket, L2-normalised; a deterministic stand-in for a model. A row never leaves its task."""

    def __init__(self, dimension: int = 64) -> None:
        if dimension < 1:
            raise EncodingError("an encoder has one dimension at least")
        self.dimension = dimension

    def encode(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        """key, vector. A text without tokens, or null, has a zero vector."""
        dimension = self.dimension

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in in_spans(batch, 1):
                    tokens = part.column(1)
                    coded = tokens.flatten().dictionary_encode()
                    bucket = np.array([int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dimension for t in coded.dictionary.to_pylist()], np.int64)
                    row = np.repeat(np.arange(part.num_rows), np.diff(tokens.offsets.to_numpy()))
                    place = row * dimension + (bucket[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else row)
                    counts = np.bincount(place, minlength=part.num_rows * dimension).reshape(part.num_rows, dimension).astype(float)
                    counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1)
                    vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, counts.size + 1, dimension, dtype=np.int32)), pa.array(counts.ravel()))
                    yield pa.RecordBatch.from_arrays([part.column(0), vectors], names=[key, "vector"])

        kind = rows.schema[key].dataType.simpleString()
        words = F.coalesce(F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN), F.lit(1)), F.array().cast("array<string>"))
        return rows.select(key, words.alias("_words")).mapInArrow(run, f"{key} {kind}, vector array<double>")


class ModelEncoder:
    """Any callable from a list of texts to a matrix, made once for each Python worker; its rows are normalised."""

    _made: dict[str, Callable] = {}

    def __init__(self, name: str, dimension: int, factory: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64) -> None:
        if batch < 1:
            raise EncodingError("a batch holds one text at least")
        self.name, self.dimension, self.factory, self.batch = name, dimension, factory, batch

    def encode(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        name, factory, batch, dimension, made = self.name, self.factory, self.batch, self.dimension, self._made

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if name not in made:
                made[name] = factory()
            for part in batches:
                for at in range(0, part.num_rows, batch):
                    some = part.slice(at, batch)
                    x = np.asarray(made[name](some.column(1).to_pylist()), np.float32)
                    norm = np.linalg.norm(x, axis=1, keepdims=True)
                    if x.ndim != 2 or x.shape[1] != dimension or not np.isfinite(x).all() or (norm == 0).any():
                        raise EncodingError(f"{name} gives vectors of shape {x.shape}, or without a norm; {dimension} columns are declared")
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array(list(x / norm), pa.list_(pa.float32()))], names=[key, "vector"])

        kind = rows.schema[key].dataType.simpleString()
        return rows.select(key, text).mapInArrow(run, f"{key} {kind}, vector array<float>")


def cached_encode(encoder: Encoder, rows: DataFrame, key: str, text: str, cache: DataFrame | None, model: str, role: str) -> tuple[DataFrame, DataFrame]:
    """(key, vector of all rows; new cache rows model, role, digest, vector). Only texts that the cache lacks are encoded."""
    digest = F.sha2(F.col(text), 256)
    wanted = rows.select(key, F.col(text).alias("_text"), digest.alias("digest"))
    texts = wanted.groupBy("digest").agg(F.first("_text").alias("_text"))
    if cache is not None:
        cache = cache.where((F.col("model") == model) & (F.col("role") == role))
        texts = texts.join(cache, "digest", "left_anti")
    fresh = encoder.encode(texts, "digest", "_text").select(F.lit(model).alias("model"), F.lit(role).alias("role"), "digest", F.col("vector").cast("array<float>").alias("vector"))
    every = fresh if cache is None else cache.select(*fresh.columns).unionByName(fresh)
    return wanted.join(every.select("digest", "vector"), "digest").select(key, "vector"), fresh


def encode_role(encoder: Encoder, rows: DataFrame, key: str, text: str, role: str, model: str) -> DataFrame:
    """key, vector of texts with the prefix of their role ("query" or "passage"); blank texts are an error."""
    texts = rows.select(key, S.strip(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    if not texts.where(F.col("_text") == "").isEmpty():
        raise EncodingError(f"a {role} has no text")
    return encoder.encode(texts.select(key, S.apply_prefix(F.col("_text"), role, F.lit(model)).alias("_text")), key, "_text")


def provenance(vectors: DataFrame, model: str, role: str, dimension: int) -> DataFrame:
    """The vectors with where they come from: model, role, dimension, and the prefix that the model's texts get."""
    e5 = S.is_e5(F.lit(model))
    return vectors.withColumns({"model": F.lit(model), "role": F.lit(role), "dimension": F.lit(dimension), "prefix": F.when(e5, S.PREFIXES[role]).otherwise("")})
