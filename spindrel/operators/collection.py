"""Vector collections as tables: creation, keyed writes, state, ingestion."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.config import Settings
from spindrel.errors import StoreError
from spindrel.functions.scalars import positions
from spindrel.operators.encoding import Encoder, encode_role, provenance


def status(collection: DataFrame, vector: str = "vector") -> DataFrame:
    """n_rows, least and greatest dimension, distance, KB of vectors."""
    size = F.size(vector)
    return collection.agg(F.count(F.lit(1)).alias("n_rows"), F.min(size).alias("dim_min"), F.max(size).alias("dim_max"), F.lit("cosine").alias("distance"), (F.sum(size) * 4 / 1024.0).alias("kilobytes"))


def upsert(base: DataFrame, changes: DataFrame, key: str, sequence: str) -> DataFrame:
    """base with the last change of each key put over it; changes have base's columns and the sequence."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(*[c for c in base.columns if c != key]), sequence).alias("_r")).select(key, "_r.*").select(*base.columns)
    return base.join(last.select(key), key, "left_anti").unionByName(last)


def delete(base: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return base.join(ids.select(key).distinct(), key, "left_anti")


def get(base: DataFrame, key: str, value) -> DataFrame:
    return base.where(F.col(key) == value)


def batch_offsets(rows: DataFrame, order: str, size: int) -> DataFrame:
    """batch and pos of each row in the given order."""
    if size < 1:
        raise StoreError("a batch holds one row at least")
    return positions(rows, order).withColumn("batch", F.floor(F.col("pos") / size).cast("long"))


class Collections:
    """Collections as Parquet folders under a root, in ranges of brands: a brand's search skips files by their statistics."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings) -> None:
        self.spark, self.where, self.settings = spark, f"{root.rstrip('/')}/{settings.collection}", settings

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.where)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self) -> bool:
        fs, path = self._fs()
        return fs.exists(path)

    def read(self) -> DataFrame:
        if not self.exists():
            raise StoreError(f"there is no collection at {self.where}")
        return self.spark.read.parquet(self.where)

    def write(self, rows: DataFrame, recreate: bool = False) -> None:
        """A new collection of vectors of the settings' dimension; an existing one is replaced only if recreate is given."""
        if self.exists() and not recreate:
            raise StoreError("the collection exists")
        if not rows.where(~F.coalesce(F.size("vector") == self.settings.dimension, F.lit(False))).isEmpty():
            raise StoreError(f"a vector hasn't {self.settings.dimension} dimensions")
        rows.repartitionByRange("brand", "product_id").sortWithinPartitions("brand").write.mode("overwrite").parquet(self.where)

    def reset(self, confirmed: bool = False) -> None:
        if not self.settings.may_reset(confirmed):
            raise StoreError("a reset needs the setting and a confirmation")
        fs, path = self._fs()
        fs.delete(path, True)

    def ingest(self, catalog: DataFrame, encoder: Encoder, text: str = "text", recreate: bool = False) -> DataFrame:
        """Encodes and writes a catalog with its provenance, then verifies it; the report is one row.

        n_rows, dim_min, dim_max, distance, kilobytes, and model, batches, seconds.
        """
        began, model = time.perf_counter(), self.settings.model
        vectors = provenance(encode_role(encoder, catalog, "product_id", text, "passage", model), model, "passage", encoder.dimension)
        self.write(catalog.drop(text).join(vectors, "product_id"), recreate)
        rows = catalog.count()
        report = self.verify(rows, encoder.dimension)
        return report.withColumns({"model": F.lit(model), "batches": F.lit(-(-rows // self.settings.batch_size)), "seconds": F.lit(time.perf_counter() - began)})

    def verify(self, expected: int, dimension: int) -> DataFrame:
        report = status(self.read())
        row = report.first()
        if row["n_rows"] != expected or (expected and (row["dim_min"], row["dim_max"]) != (dimension, dimension)):
            raise StoreError(f"the collection has {row['n_rows']} rows of {row['dim_min']} to {row['dim_max']} dimensions; expected {expected} of {dimension}")
        return report
