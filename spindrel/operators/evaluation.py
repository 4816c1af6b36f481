"""Graded ranking evaluation, index fidelity, filter compliance and latency.

Rankings: query_id, rank, product_id. Judgments: query_id, product_id, grade.
"""

from __future__ import annotations

import math
import platform
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrel.config import RELEVANT
from spindrel.errors import MetricError


def check_arguments(k: int, threshold: float) -> None:
    if isinstance(k, bool) or not isinstance(k, int) or k < 1 or not math.isfinite(threshold) or threshold <= 0:
        raise MetricError("k must be a whole number from 1 on, the threshold finite and above 0")


def repeats(rankings: DataFrame, k: int) -> DataFrame:
    """Products that a query's top k has more than once, or without an id."""
    top = rankings.where(F.col("rank") <= k)
    return top.groupBy("query_id", "product_id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col("product_id").isNull() | (F.col("product_id").cast("string") == ""))


def unknown(rankings: DataFrame, judgments: DataFrame) -> DataFrame:
    """Queries with a ranking but no judgment."""
    return rankings.select("query_id").distinct().join(judgments.select("query_id").distinct(), "query_id", "left_anti")


def _gain(grade: str):
    return (F.pow(F.lit(2.0), F.col(grade)) - 1.0) / F.log2(F.col("rank") + 1.0)


def graded(rankings: DataFrame, judgments: DataFrame) -> DataFrame:
    """The rankings with the grade of each product, 0 for unjudged ones."""
    return rankings.join(judgments, ["query_id", "product_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0.0)).cast("double"))


def grade_counts(judgments: DataFrame) -> DataFrame:
    """query_id, grade, n: how many products each query has with each grade."""
    return judgments.groupBy("query_id", F.col("grade").cast("double").alias("grade")).agg(F.count(F.lit(1)).alias("n"))


def per_query(rankings: DataFrame, judgments: DataFrame, k: int = 10, threshold: float = RELEVANT) -> DataFrame:
    """query_id, ndcg, recall, mrr, ceiling, n_relevant, n_found, n_retrieved of each judged query.

    Unjudged products have grade 0. The ideal ranking takes the k best of all the query's judgments. A judged query
    without a ranking scores 0; without relevant judgments recall and ceiling are 0.
    """
    return per_query_of(graded(rankings.where(F.col("rank") <= k), judgments), grade_counts(judgments), k, threshold)


def per_query_of(rankings: DataFrame, counts: DataFrame, k: int = 10, threshold: float = RELEVANT) -> DataFrame:
    """As per_query, from rankings with grades and the number of judgments of each grade (query_id, grade, n): no list
    of judgments is needed where grades follow from properties of query and product."""
    check_arguments(k, threshold)
    good = F.col("grade") >= threshold
    got = rankings.where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(_gain("grade")).alias("dcg"), F.count_if(good).alias("n_found"), F.count(F.lit(1)).alias("n_retrieved"), F.min(F.when(good, F.col("rank"))).alias("first"))
    # The ideal ranking has all products of the best grade, then all of the next, up to k: sums of discounts by place.
    discounts = F.array(*[F.lit(sum(1 / math.log2(r + 1) for r in range(1, n + 1))) for n in range(k + 1)])
    upto = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("grade")))
    share = F.element_at(discounts, (F.least(F.lit(k), "upto") + 1).cast("int")) - F.element_at(discounts, (F.least(F.lit(k), F.col("upto") - F.col("n")) + 1).cast("int"))
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1.0) * share
    relevant = counts.where("n > 0").withColumn("upto", upto).groupBy("query_id").agg(F.sum(gain).alias("idcg"), F.sum(F.when(good, F.col("n")).otherwise(0)).alias("n_relevant"))
    rows = relevant.join(got, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(
        "query_id",
        zero(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg"))).alias("ndcg"),
        zero(F.when(F.col("n_relevant") > 0, F.col("n_found") / F.col("n_relevant"))).alias("recall"),
        zero(1.0 / F.col("first")).alias("mrr"),
        zero(F.when(F.col("n_relevant") > 0, F.least(F.lit(k), "n_relevant") / F.col("n_relevant"))).alias("ceiling"),
        "n_relevant",
        F.coalesce("n_found", F.lit(0)).alias("n_found"),
        F.coalesce("n_retrieved", F.lit(0)).alias("n_retrieved"),
    )


def macro(rankings: DataFrame, judgments: DataFrame, k: int = 10, threshold: float = RELEVANT) -> DataFrame:
    """Means over all judged queries; a ranking of an unjudged query is an error."""
    return macro_of(graded(rankings.where(F.col("rank") <= k), judgments), grade_counts(judgments), k, threshold)


def macro_of(rankings: DataFrame, counts: DataFrame, k: int = 10, threshold: float = RELEVANT) -> DataFrame:
    if not unknown(rankings, counts).isEmpty():
        raise MetricError("a ranking belongs to no judged query")
    return per_query_of(rankings, counts, k, threshold).agg(F.count(F.lit(1)).alias("n_queries"), *[F.avg(c).alias(f"mean_{c}") for c in ("ndcg", "recall", "mrr", "ceiling")])


def summary(metrics: DataFrame) -> DataFrame:
    """query_id and its metrics as one JSON object, to 4 decimals: 0.0003, not 3.0E-4."""
    rounded = lambda c: (F.round(F.col(c) * 10_000.0) / 10_000.0).alias(c)
    text = F.to_json(F.struct(*[rounded(c) for c in ("ndcg", "recall", "mrr", "ceiling")], "n_relevant"))
    return metrics.select("query_id", F.regexp_replace(text, r":(-?)([1-9])\.0E-4\b", ":$10.000$2").alias("summary"))


def fidelity(engine: DataFrame, exact: DataFrame, k: int = 10) -> DataFrame:
    """query_id, fidelity, rank_agreement, n_missed of each query that either ranking has.

    fidelity: products of the exact top k that the engine has, of as many as there are. rank_agreement: places with
    the same product, of the shorter ranking; 0 if one is empty.
    """
    e = engine.where(F.col("rank") <= k).select("query_id", "product_id", F.col("rank").alias("rank_e"))
    x = exact.where(F.col("rank") <= k).select("query_id", "product_id", F.col("rank").alias("rank_x"))
    both = e.join(x, ["query_id", "product_id"], "full_outer")
    counts = both.groupBy("query_id").agg(F.count("rank_e").alias("n_e"), F.count("rank_x").alias("n_x"), F.count_if(F.col("rank_e").isNotNull() & F.col("rank_x").isNotNull()).alias("n_both"), F.count_if(F.col("rank_e") == F.col("rank_x")).alias("n_same"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return counts.select("query_id", ratio(F.col("n_both"), F.least(F.lit(k), "n_x")).alias("fidelity"), ratio(F.col("n_same"), F.least("n_e", "n_x")).alias("rank_agreement"), (F.col("n_x") - F.col("n_both")).alias("n_missed"))


def missed(engine: DataFrame, exact: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, product_id of the exact top k that the engine lacks."""
    return exact.where(F.col("rank") <= k).join(engine.where(F.col("rank") <= k), ["query_id", "product_id"], "left_anti").select("query_id", "rank", "product_id")


def fidelity_report(rows: DataFrame, groups: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(groups or [])).agg(F.count(F.lit(1)).alias("n_queries"), F.avg("fidelity").alias("mean_fidelity"), F.avg("rank_agreement").alias("mean_rank_agreement"), F.count_if(F.col("fidelity") >= 1).alias("n_perfect"))


def compliance(rankings: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, n_returned, n_matching, offending, compliant; rankings carry the brand of each row, queries the asked one."""
    if not queries.where(F.col("brand").isNull() | (F.col("brand").cast("string") == "")).isEmpty():
        raise MetricError("a query has no brand")
    rows = queries.select("query_id", F.col("brand").alias("_asked")).join(rankings, "query_id", "left")
    ok = F.col("brand") == F.col("_asked")
    out = rows.groupBy("query_id").agg(F.count("product_id").alias("n_returned"), F.count_if(ok).alias("n_matching"), F.sort_array(F.collect_set(F.when(~ok, F.col("brand")))).alias("offending"))
    return out.withColumn("compliant", F.col("n_returned") == F.col("n_matching"))


def compliance_summary(rows: DataFrame) -> DataFrame:
    """n_queries, n_compliant, all_compliant of the rows of compliance."""
    return rows.agg(F.count(F.lit(1)).alias("n_queries"), F.count_if("compliant").alias("n_compliant"), F.coalesce(F.bool_and("compliant"), F.lit(True)).alias("all_compliant"))


def latency(rows: DataFrame, value: str, groups: list[str] | None = None) -> DataFrame:
    """n, mean, least, greatest, p50 and p95 (linear interpolation)."""
    x = F.col(value).cast("double")
    return rows.groupBy(*(groups or [])).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("least"), F.max(x).alias("greatest"), F.percentile(x, F.lit(0.5)).alias("p50"), F.percentile(x, F.lit(0.95)).alias("p95"))


def measure(run: Callable[[], DataFrame], repetitions: int = 5, warm_up: int = 2) -> list[float]:
    """Milliseconds of complete runs; the warm-up isn't counted."""
    out = []
    for n in range(warm_up + repetitions):
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        if n >= warm_up:
            out.append(1000 * (time.perf_counter() - began))
    return out


def environment(spark) -> dict[str, str]:
    return {"python": sys.version.split()[0], "platform": platform.platform(), "spark": spark.version, "parallelism": str(spark.sparkContext.defaultParallelism)}
