"""Which layer a weak query is due to, and the comparison of experiments."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.config import RELEVANT
from spindrel.errors import ConfigurationError, MetricError
from spindrel.operators.evaluation import grade_counts, graded, macro_of, per_query_of
from spindrel.workspace import staged

INDEX, REPRESENTATION, DATA = "indice", "representacion", "datos_o_filtros"


#: Why a query is weak, by layer.
EXPLANATIONS = {
    INDEX: "relevant products of the exact ranking are missing from the index's",
    REPRESENTATION: "the exact ranking finds too few of the relevant products",
    DATA: "the ranking is about as good as the number of relevant products allows",
}


def attribute(engine: DataFrame, exact: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
    """query_id, layer, n_lost, ndcg, recall, ceiling, lost, explanation. The first rule that holds decides:

    relevant products of the exact ranking that the engine lost: the index; none in the exact ranking: the
    representation; a ceiling below 1 and recall of 0.9 of it or more: data or filters; else the representation.
    lost is the evidence: the lost products, in the exact ranking's order.
    """
    return attribute_of(graded(engine.where(F.col("rank") <= k), judgments), graded(exact.where(F.col("rank") <= k), judgments), grade_counts(judgments), k)


def attribute_of(engine: DataFrame, exact: DataFrame, counts: DataFrame, k: int = 10) -> DataFrame:
    """As attribute, from rankings with grades and grade counts."""
    exact_good = exact.where((F.col("rank") <= k) & (F.col("grade") >= RELEVANT))
    there = engine.where(F.col("rank") <= k).select("query_id", "product_id", F.lit(True).alias("_kept"))
    seen = exact_good.join(there, ["query_id", "product_id"], "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_exact"), F.count_if(F.col("_kept").isNull()).alias("n_lost"), F.array_sort(F.collect_list(F.when(F.col("_kept").isNull(), F.struct("rank", "product_id")))).alias("lost")
    )
    rows = per_query_of(engine, counts, k).join(seen, "query_id", "left").withColumns({"n_lost": F.coalesce("n_lost", F.lit(0)), "n_exact": F.coalesce("n_exact", F.lit(0))})
    layer = F.when(F.col("n_lost") > 0, INDEX).when(F.col("n_exact") == 0, REPRESENTATION).when((F.col("ceiling") < 1) & (F.col("recall") >= 0.9 * F.col("ceiling")), DATA).otherwise(REPRESENTATION)
    why = F.create_map(*[F.lit(x) for pair in EXPLANATIONS.items() for x in pair])
    lost = F.coalesce(F.array_join(F.col("lost.product_id").cast("array<string>"), ","), F.lit(""))
    return rows.withColumn("layer", layer).select("query_id", "layer", "n_lost", "ndcg", "recall", "ceiling", lost.alias("lost"), F.element_at(why, F.col("layer")).alias("explanation"))


def index_failure(attributed: DataFrame) -> DataFrame:
    """The first query, by id, that lost relevant products to the index, with what it lost; no row if there is none."""
    return attributed.where("n_lost > 0").orderBy("query_id").limit(1).select("query_id", "n_lost", "lost")


def weakest(metrics: DataFrame, n: int = 3) -> DataFrame:
    """The n queries (3 at least) with the least nDCG."""
    return metrics.orderBy("ndcg", "query_id").limit(max(n, 3))


def by_layer(attributed: DataFrame) -> DataFrame:
    return attributed.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


def missed_duplicates(decided: DataFrame, low: float, high: float) -> DataFrame:
    """Missed duplicates, and whether their score lies in the calibration gap."""
    return decided.where("is_duplicate and not predicted").withColumn("in_gap", F.col("score").between(low, high))


@dataclass(frozen=True)
class Experiment:
    """A retrieval set-up: a name, what is varied in it, and what it returns for the query set."""

    name: str
    configuration: dict[str, str]
    search: Callable[[], DataFrame]

    def __post_init__(self) -> None:
        if not re.fullmatch("E[0-9]+[a-z]?", self.name):
            raise ConfigurationError("an experiment's name is E, a number, and a letter if need be")


def run_experiment(experiment: Experiment, grade: Callable[[DataFrame], DataFrame], counts: DataFrame, k: int = 10) -> DataFrame:
    """One row: experiment, configuration (JSON), its macro means and retrieved (query_id to product ids, in order)."""
    found = staged(grade(experiment.search().where(F.col("rank") <= k)), "experiment")
    ids = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("product_id").cast("string").alias("p")))), lambda x: x["p"]).alias("ids"))
    retrieved = ids.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("query_id").cast("string"), "ids")))).alias("retrieved"))
    return macro_of(found, counts, k).join(F.broadcast(retrieved)).withColumns({"experiment": F.lit(experiment.name), "configuration": F.lit(json.dumps(experiment.configuration, sort_keys=True))})


def compare(experiments: list[Experiment], grade: Callable[[DataFrame], DataFrame], counts: DataFrame, k: int = 10) -> DataFrame:
    """The rows of all experiments; grade puts grades to rankings, counts are the grade counts."""
    out = None
    for e in experiments:
        row = run_experiment(e, grade, counts, k)
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise MetricError("there is no experiment")
    return out


EXPERIMENT_CONTRACT = {
    "name missing": "experiment is null or not experiment rlike '^E[0-9]+[a-z]?$'",
    "configuration missing": "configuration is null or configuration in ('', '{}')",
    "mean outside 0 to 1": "not (mean_ndcg between 0 and 1 and mean_recall between 0 and 1 and mean_mrr between 0 and 1)",
    "retrieved ids missing": "retrieved is null or size(retrieved) = 0",
}


def winner(compared: DataFrame, among: list[str]) -> DataFrame:
    """The best mean nDCG of the named experiments; the first named wins a tie."""
    place = F.array_position(F.array(*[F.lit(x) for x in among]), F.col("experiment"))
    return compared.where(F.col("experiment").isin(*among)).orderBy(F.desc("mean_ndcg"), place).limit(1)
