"""Tables in the folder that driver and executors share, and broadcasts behind a check of their size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.errors import ConfigurationError

#: Rows that a broadcast may hold; beyond it, the same join is shuffled.
BROADCAST_ROWS = 1_000_000
#: Rows that a file of a written table of known size is meant to hold, if every core gets one.
FILE_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Without it, a temporary folder of a local session; on a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ConfigurationError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spindrel-")
        spark.conf.set("spark.checkpoint.dir", named)
        path = spark._jvm.org.apache.hadoop.fs.Path(named)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver's JVM ends."""
    where = f"{shared_dir(spark)}/spindrel-{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return where


def remove(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def in_few_files(df: DataFrame, rows: int) -> DataFrame:
    """df, of at most `rows` rows, in no more partitions than they need, and no fewer than there are cores: a task opens
    a file, for which a local file system may start processes."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, rows // FILE_ROWS + 1))


def staged(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df written to the shared folder and read again: computed once, with no lineage to lose. rows: at most so many."""
    where = scratch(df.sparkSession, name)
    (df if rows is None else in_few_files(df, rows)).write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def small_or_shuffled(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df marked for broadcast if it has at most BROADCAST_ROWS rows; else as it is, for a shuffled join."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
