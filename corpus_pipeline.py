"""The corpus pipeline: STAGES, each a function of (spark, docs, sf_dir) over all that its predecessor kept.

Every stage's result is written as Parquet to the shared folder and read again. Unlabelled rows, null texts and rows
with a null doc_id pass through the stages as their operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrel.llm import exact, quality, sigtree, suffix, wfst
from spindrel.llm.common import staged
from spindrel.llm.queries import TOKENIZERS


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go (operator 8). Trained on labelled rows of docs."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays (operator 5)."""
    return exact.drop_exact(docs)


def similar_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (operator 4)."""
    return sigtree.drop_similar(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verbatim match of 8 words or a whole shorter item go, even if it is of one item only (operator 2)."""
    return suffix.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of whole texts, and the texts that they decode to (operator 1)."""
    return wfst.tokenised(docs, f"{TOKENIZERS}/piece_bpe_32k.model")


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", similar_stage),
    ("benchmark decontamination", benchmark_stage),
    ("SentencePiece encoding and decoding", tokens_stage),
]

#: SQL can express neither the trained classifier nor the tokenizer; tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "".join(c if c.isalnum() else "-" for c in name))
    return docs
