"""Rows of the delivered artifacts and their contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrel.errors import ArtifactError


def search_rows(rankings: DataFrame) -> DataFrame:
    """evaluation_id, rank (counted anew), product_id, score to 6 decimals; a repeated product is an error."""
    if not rankings.groupBy("query_id", "product_id").count().where("count > 1").isEmpty():
        raise ArtifactError("a ranking has a product twice")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return rankings.select(F.col("query_id").cast("string").alias("evaluation_id"), rank.alias("rank"), F.col("product_id").cast("string").alias("product_id"), F.round("score", 6).alias("score")).orderBy("evaluation_id", "rank")


def duplicate_rows(decided: DataFrame) -> DataFrame:
    """incoming_id, predicted_duplicate, matched_product_id (empty unless predicted), score to 6 decimals."""
    match = F.when(F.col("predicted"), F.col("matched_id").cast("string")).otherwise("")
    return decided.select(F.col("listing_id").cast("string").alias("incoming_id"), F.col("predicted").alias("predicted_duplicate"), match.alias("matched_product_id"), F.round("score", 6).alias("score")).orderBy("incoming_id")


SEARCH_CONTRACT = {
    "evaluation_id missing": "evaluation_id is null or evaluation_id = ''",
    "rank outside 1 to 10": "rank is null or rank not between 1 and 10",
    "product_id missing": "product_id is null or product_id = ''",
    "score missing": "score is null or isnan(score)",
}
DUPLICATE_CONTRACT = {
    "incoming_id missing": "incoming_id is null or incoming_id = ''",
    "decision missing": "predicted_duplicate is null",
    "match missing": "predicted_duplicate and (matched_product_id is null or matched_product_id = '')",
    "match without decision": "not predicted_duplicate and matched_product_id <> ''",
    "score outside -1 to 1": "score is null or score not between -1 and 1",
}


METRICS_CONTRACT = {
    "mean outside 0 to 1": "not (coalesce(mean_ndcg, -1) between 0 and 1 and coalesce(mean_recall, -1) between 0 and 1 and coalesce(mean_mrr, -1) between 0 and 1)",
    "no queries": "coalesce(n_queries, 0) < 1",
}


def recheck(search: DataFrame, decisions: DataFrame, metrics: DataFrame) -> DataFrame:
    """artifact, n_rows, n_groups, n_positive, n_broken of the artifacts as read back: a row each.

    n_groups counts queries or listings, n_positive predicted duplicates, n_broken rows that break the contract.
    """
    broken = lambda c: F.count_if(F.coalesce(F.expr(" or ".join(f"coalesce({x}, false)" for x in c.values())), F.lit(False)))
    one = lambda name, rows, group, positive, contract: rows.agg(F.lit(name).alias("artifact"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct(group).alias("n_groups"), positive.alias("n_positive"), broken(contract).alias("n_broken"))
    none = F.lit(0).cast("long")
    out = one("search", search, "evaluation_id", none, SEARCH_CONTRACT)
    out = out.unionByName(one("duplicates", decisions, "incoming_id", F.count_if("predicted_duplicate"), DUPLICATE_CONTRACT))
    return out.unionByName(one("metrics", metrics, "n_queries", none, METRICS_CONTRACT))


def violations(rows: DataFrame, contract: dict[str, str]) -> DataFrame:
    """rule, n: how many rows break each rule, in one pass."""
    names = list(contract)
    if not names:
        return rows.sparkSession.createDataFrame([], "rule string, n long")
    counted = rows.agg(*[F.count_if(F.coalesce(F.expr(contract[n]), F.lit(False))).alias(f"r{i}") for i, n in enumerate(names)])
    pairs: list[Column] = [F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("n")) for i, n in enumerate(names)]
    return counted.select(F.inline(F.array(*pairs)))


def require(rows: DataFrame, contract: dict[str, str]) -> None:
    broken = violations(rows, contract).where("n > 0").collect()
    if broken:
        raise ArtifactError("; ".join(f"{r['rule']}: {r['n']} rows" for r in broken))
