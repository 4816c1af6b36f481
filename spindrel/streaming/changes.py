"""The change log as a stream (an extension): each micro-batch is merged into a state table by batch number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from spindrel.operators.changes import final_state


def state_path(root: str, batch: int) -> str:
    return f"{root}/state-{batch:010d}"


def latest(spark, root: str) -> DataFrame | None:
    """The state after the last finished batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    done = sorted(f.getPath().getName() for f in fs.listStatus(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")))
    return spark.read.parquet(f"{root}/{done[-1]}") if done else None


def merge_stream(events: DataFrame, base: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Folds a stream of events (sequence, key, op, title) into states under root; a batch that runs again overwrites
    its own state only, so a restart changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(state_path(root, number - 1)) if number else base
        final_state(batch, before).write.mode("overwrite").parquet(state_path(root, number))

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
