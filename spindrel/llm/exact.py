"""Exact dedup by a heavy-hitter split.

Misra-Gries counters in every task find the frequent digests; one aggregation of their rows verifies counts and
winners; the winners are broadcast and their rows are settled where they lie. All other digests are shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrel.llm.common import BLANKS, staged, without

#: Counters of each Misra-Gries summary, and the most digests that are broadcast. A digest of more than
#: 2 / (COUNTERS + 1) of all rows is certain to be among them, so a shuffled group holds at most that share.
COUNTERS = 2048


class MisraGries:
    """At most k counters; each counts at least the true number less n / (k + 1)."""

    def __init__(self, k: int) -> None:
        self.k, self.counts = k, {}

    def add(self, values: list, numbers: list[int]) -> None:
        for value, n in zip(values, numbers, strict=True):
            self.counts[value] = self.counts.get(value, 0) + n
            if len(self.counts) >= 2 * self.k:
                self.shrink()

    def shrink(self) -> None:
        if len(self.counts) > self.k:
            bar = sorted(self.counts.values(), reverse=True)[self.k]
            self.counts = {v: n - bar for v, n in self.counts.items() if n > bar}


def _summaries(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = MisraGries(k)
        for batch in batches:
            found = pc.value_counts(batch.column(0))
            seen.add(found.field(0).to_pylist(), found.field(1).to_pylist())
        seen.shrink()
        yield pa.RecordBatch.from_arrays([pa.array(seen.counts.keys(), pa.binary()), pa.array(seen.counts.values(), pa.int64())], names=["digest", "seen"])

    return run


def normalised(text):
    """The text without the characters of [\\x20\\x09-\\x0D]; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, chars, digest (32 bytes) and uid, which tells repeated rows apart; written, so that uid is fixed."""
    text = F.col(text_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).alias("chars"), F.unhex(F.sha2(normalised(text), 256)).alias("digest"))
    return staged(slim.withColumn("uid", F.monotonically_increasing_id()), "fingerprints")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 and uid.

    Of texts that are equal without white space, the row with most code points stays, then that with the least doc_id
    (a null doc_id last), then the first of rows that repeat both. A null text is an empty one. Other columns of docs
    are not read. An empty table gives an empty result.
    """
    rows = fingerprints(docs, id_col, text_col)
    order = F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("uid").alias("u"))
    summary = rows.select("digest").mapInArrow(_summaries(counters), "digest binary, seen long").groupBy("digest").agg(F.sum("seen").alias("seen"))
    frequent = summary.orderBy(F.desc("seen"), "digest").limit(counters).select("digest")
    heavy = staged(rows.join(F.broadcast(frequent), "digest", "left_semi").groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("top")).where("group_size > 1"), "heavy")
    settled = rows.join(F.broadcast(heavy), "digest")
    group = Window.partitionBy("digest")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").withColumns({"group_size": F.count(F.lit(1)).over(group), "top": F.min(order).over(group)})
    return settled.unionByName(rest).select("doc_id", F.col("top.d").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), (F.col("uid") == F.col("top.u")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "uid")


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups drops, with all their columns.

    Rows are told apart by doc_id: a doc_id of which one row stays and another goes keeps one row of each text that
    stays. Rows with a null doc_id stay.
    """
    rows = staged(exact_groups(docs, id_col, text_col).where(F.col("doc_id").isNotNull()).select("doc_id", "kept", "text_sha256"), "kept-rows")
    groups = staged(rows.groupBy("doc_id").agg(F.max("kept").alias("some"), F.min("kept").alias("all")), "kept")
    kept = without(docs, groups.where("not some").select(F.col("doc_id").alias(id_col)), id_col)
    mixed = groups.where("some and not all").select(F.col("doc_id").alias(id_col))
    if mixed.isEmpty():
        return kept
    sha, n = (f"_{x}_{uuid.uuid4().hex}" for x in ("sha", "n"))  # docs may have columns of any name
    stays = rows.where("kept").select(F.col("doc_id").alias(id_col), F.col("text_sha256").alias(sha)).distinct()
    row = Window.partitionBy(id_col, sha).orderBy(F.desc(F.length(text_col)))
    some = docs.join(mixed, id_col, "left_semi").withColumn(sha, F.sha2(normalised(F.col(text_col)), 256)).join(stays, [id_col, sha]).withColumn(n, F.row_number().over(row)).where(F.col(n) == 1).drop(sha, n)
    return without(kept, mixed, id_col).unionByName(some.select(kept.columns))
