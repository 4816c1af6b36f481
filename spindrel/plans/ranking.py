"""Search, evaluation, fidelity, attribution and artifacts over `embeddings` and `part`.

A label is a brand. The query set is every row whose id is divisible by 100, against all rows but itself. Grades follow
from labels: 3 for the same one, 2 and 1 for a distance of 1 and 2, else 0; all products are judged for all queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.operators import artifacts, attribution, collection, evaluation, vector
from spindrel.operators.lexical import TfidfIndex
from spindrel.session import table
from spindrel.workspace import scratch, small_or_shuffled

#: PROBES cells give a fidelity of 0.95 or more on the test data; LOW_PROBES are few on purpose, so that there are losses.
K, PROBES, LOW_PROBES, SWEEP = 10, 40, 2, [1, 2, 4, 8, 16, 32]


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("product_id"), F.col("label").alias("brand"), F.col("embedding").alias("vector"))


def _queries(rows: DataFrame) -> DataFrame:
    return rows.where("product_id % 100 = 0").withColumnRenamed("product_id", "query_id")


def _exact(spark: SparkSession, sf: str, k: int = K, brand: bool = False) -> DataFrame:
    rows = _rows(spark, sf)
    return vector.exact_topk(_queries(rows), rows, k, brand, skip_self=True)


_indexes: dict[tuple[str, str], vector.CellIndex] = {}


def _index(spark: SparkSession, sf: str) -> vector.CellIndex:
    """The index of a folder's collection, written once a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _indexes:
        _indexes[key] = vector.CellIndex(_rows(spark, sf), scratch(spark, "cells"))
    return _indexes[key]


def _cells(spark: SparkSession, sf: str, probes: int = PROBES, k: int = K) -> DataFrame:
    return _index(spark, sf).search(_queries(_rows(spark, sf)), k, probes, skip_self=True).drop("probes")


def _grade(spark: SparkSession, sf: str):
    """Puts grades to rankings: they follow from the labels of query and product."""
    labels = table(spark, sf, "embeddings").select("vec_id", "label")

    def graded(ranked: DataFrame) -> DataFrame:
        rows = ranked.join(labels.select(F.col("vec_id").alias("product_id"), F.col("label").alias("_label")), "product_id")
        rows = rows.join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("_asked")), "query_id")
        return rows.withColumn("grade", _of(F.abs(F.col("_label") - F.col("_asked")))).drop("_label", "_asked")

    return graded


def _of(far):
    return F.when(far == 0, 3.0).when(far == 1, 2.0).when(far == 2, 1.0).otherwise(0.0)


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, grade, n: products of each grade, from the number of products of each label."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label")
    labels = small_or_shuffled(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")))
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("asked"))
    grade = _of(F.abs(F.col("label") - F.col("asked")))
    others = F.col("n") - F.when(F.col("label") == F.col("asked"), 1).otherwise(0)
    return queries.join(labels).groupBy("query_id", grade.alias("grade")).agg(F.sum(others).alias("n"))


def _shown(ranked: DataFrame) -> DataFrame:
    return ranked.select("query_id", F.col("rank").cast("long").alias("rank"), "product_id", F.round("score", 6).alias("score"))


def _rounded(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.round(n, 6) for n in names})


def exact_topk(spark, sf):
    return _shown(_exact(spark, sf))


def exact_topk_brand(spark, sf):
    return _shown(_exact(spark, sf, brand=True))


def exact_topk_brand_absent(spark, sf):
    """Every other query asks for a brand that no row has: these get no hits, the others theirs."""
    rows = _rows(spark, sf)
    asked = F.when(F.col("query_id") % 200 == 0, F.lit(-1)).otherwise(F.col("brand")).cast(rows.schema["brand"].dataType)
    return _shown(vector.exact_topk(_queries(rows).withColumn("brand", asked), rows, K, brand=True, skip_self=True))


def topk_cap(spark, sf):
    """k beyond the number of rows of the brand: each query gets them all."""
    return _exact(spark, sf, k=100_000, brand=True).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("rank").cast("long").alias("last_rank"))


def search_hits(spark, sf):
    payload = table(spark, sf, "embeddings").select(F.col("vec_id").alias("product_id"), F.col("label").alias("brand"))
    return vector.hits(_shown(_exact(spark, sf)), payload).select("query_id", "rank", "product_id", "score", F.col("brand").cast("long").alias("brand"), "score_kind", "higher_is_better")


def vector_norm_check(spark, sf):
    return vector.violations(_rows(spark, sf), 64)


def collection_status(spark, sf):
    return collection.status(_rows(spark, sf)).select("n_rows", F.col("dim_min").cast("long").alias("dim_min"), F.col("dim_max").cast("long").alias("dim_max"), "distance", F.round("kilobytes", 6).alias("kilobytes"))


def _metrics(spark, sf):
    return _rounded(evaluation.per_query_of(_grade(spark, sf)(_exact(spark, sf)), _counts(spark, sf), K), "ndcg", "recall", "mrr", "ceiling")


def per_query_metrics(spark, sf):
    return _metrics(spark, sf)


def ndcg_at_10(spark, sf):
    return _metrics(spark, sf).select("query_id", "ndcg")


def recall_at_10(spark, sf):
    return _metrics(spark, sf).select("query_id", "recall")


def mrr_at_10(spark, sf):
    return _metrics(spark, sf).select("query_id", "mrr")


def recall_ceiling(spark, sf):
    return _metrics(spark, sf).select("query_id", "ceiling", "n_relevant")


def macro_metrics(spark, sf):
    """Over all judged queries, with rankings for a brand filter: queries of a brand without other rows score 0."""
    return _rounded(evaluation.macro_of(_grade(spark, sf)(_exact(spark, sf, brand=True)), _counts(spark, sf), K), "mean_ndcg", "mean_recall", "mean_mrr", "mean_ceiling")


def unknown_rankings(spark, sf):
    """Rankings of all queries against the judgments of every other one."""
    return evaluation.unknown(_exact(spark, sf), _counts(spark, sf).where("query_id % 200 = 0"))


def duplicate_in_ranking(spark, sf):
    ranked = _exact(spark, sf).select("query_id", "rank", "product_id")
    return evaluation.repeats(ranked.unionByName(_exact(spark, sf, brand=True).select("query_id", "rank", "product_id")), K)


def ivf_topk(spark, sf):
    return _shown(_cells(spark, sf))


def ivf_all_cells(spark, sf):
    return _shown(_cells(spark, sf, _index(spark, sf).cells))


def ann_fidelity(spark, sf):
    return _rounded(evaluation.fidelity(_cells(spark, sf), _exact(spark, sf), K), "fidelity", "rank_agreement")


def rank_agreement(spark, sf):
    return _rounded(evaluation.fidelity(_cells(spark, sf, LOW_PROBES), _exact(spark, sf), K), "fidelity", "rank_agreement")


def ann_missed(spark, sf):
    return evaluation.missed(_cells(spark, sf, LOW_PROBES), _exact(spark, sf), K).withColumn("rank", F.col("rank").cast("long"))


def nprobe_sweep(spark, sf):
    """One pass over the cells for all numbers of probes, each against the same exact ranking."""
    asked = lambda rows, probes: rows.withColumn("query_id", F.col("query_id") * len(SWEEP) + probes)
    place = F.array_position(F.array(*[F.lit(n) for n in SWEEP]), F.col("probes")) - 1
    engine = asked(_index(spark, sf).search(_queries(_rows(spark, sf)), K, SWEEP, skip_self=True), place).drop("probes")
    exact = asked(_exact(spark, sf).withColumn("n", F.explode(F.array(*[F.lit(n) for n in range(len(SWEEP))]))), F.col("n")).drop("n")
    rows = evaluation.fidelity(engine, exact, K).withColumn("probes", F.element_at(F.array(*[F.lit(n).cast("long") for n in SWEEP]), (F.pmod("query_id", F.lit(len(SWEEP))) + 1).cast("int")))
    return _rounded(evaluation.fidelity_report(rows, ["probes"]), "mean_fidelity", "mean_rank_agreement")


def brand_compliance(spark, sf):
    """Unfiltered rankings held against the brand of the query: most offend."""
    rows = _rows(spark, sf)
    ranked = _exact(spark, sf).join(rows.select("product_id", "brand"), "product_id")
    out = evaluation.compliance(ranked, _queries(rows).select("query_id", "brand"))
    return out.select("query_id", "n_returned", "n_matching", F.array_join(out["offending"].cast("array<string>"), ",").alias("offending"), "compliant")


def latency_percentiles(spark, sf):
    out = evaluation.latency(table(spark, sf, "events"), "value", ["event_type"])
    return _rounded(out, "mean", "least", "greatest", "p50", "p95")


def compliance_summary(spark, sf):
    return evaluation.compliance_summary(brand_compliance(spark, sf))


def metric_summaries(spark, sf):
    return evaluation.summary(_metrics(spark, sf))


def _attributed(spark, sf) -> DataFrame:
    grade = _grade(spark, sf)
    return attribution.attribute_of(grade(_cells(spark, sf, LOW_PROBES)), grade(_exact(spark, sf)), _counts(spark, sf), K)


def attribution_layers(spark, sf):
    return _rounded(_attributed(spark, sf), "ndcg", "recall", "ceiling")


def attribution_summary(spark, sf):
    return attribution.by_layer(_attributed(spark, sf))


def index_failure(spark, sf):
    return attribution.index_failure(_attributed(spark, sf))


def weakest_queries(spark, sf):
    return attribution.weakest(_metrics(spark, sf)).select("query_id", "ndcg")


def search_artifact_rows(spark, sf):
    return artifacts.search_rows(_exact(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


def contract_violations(spark, sf):
    """Rows that break each of the rules, some of them several."""
    rank = F.col("rank")
    spoilt = {"evaluation_id": F.when(rank % 5 == 0, "").otherwise(F.col("evaluation_id")), "product_id": F.when(rank % 3 != 0, F.col("product_id")), "score": F.when(rank % 2 == 0, F.col("score")), "rank": rank + 2}
    return artifacts.violations(artifacts.search_rows(_exact(spark, sf)).withColumns(spoilt), artifacts.SEARCH_CONTRACT)


def _part(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("text"), F.col("p_brand").alias("brand"))


def _asked(rows: DataFrame) -> DataFrame:
    return rows.where("product_id % 100 = 0").withColumnRenamed("product_id", "query_id")


def tfidf_vocab(spark, sf):
    return _rounded(TfidfIndex(_part(spark, sf)).vocabulary, "idf")


def tfidf_topk(spark, sf):
    rows = _part(spark, sf)
    return _shown(TfidfIndex(rows).search(_asked(rows), K))


def tfidf_topk_brand(spark, sf):
    rows = _part(spark, sf)
    return _shown(TfidfIndex(rows).search(_asked(rows), K, brand=True))


_NAMES = (
    "exact_topk exact_topk_brand exact_topk_brand_absent topk_cap search_hits vector_norm_check collection_status per_query_metrics ndcg_at_10 recall_at_10 mrr_at_10 recall_ceiling macro_metrics unknown_rankings "
    "duplicate_in_ranking ivf_topk ivf_all_cells ann_fidelity rank_agreement ann_missed nprobe_sweep brand_compliance compliance_summary metric_summaries latency_percentiles attribution_layers attribution_summary index_failure weakest_queries "
    "search_artifact_rows contract_violations tfidf_vocab tfidf_topk tfidf_topk_brand"
).split()
QUERIES = {name: globals()[name] for name in _NAMES}

_BASE = """
    e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    pairs AS (
        SELECT q.vec_id AS query_id, e.vec_id AS product_id, q.label AS asked, e.label AS brand, round(list_dot_product(q.v, e.v), 9) + 0.0 AS score
        FROM e q JOIN e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)"""


def _ranked(name: str, source: str = "pairs", keep: str = "rank <= 10") -> str:
    return f"""
    {name} AS (
        SELECT * FROM (SELECT query_id, product_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM {source})
        WHERE {keep})"""


def _cell_sql(name: str, probes: int) -> str:
    return _ranked(name, f"(SELECT p.* FROM pairs p JOIN homes h ON h.id = p.product_id AND h.place = 1 JOIN homes w ON w.id = p.query_id AND w.place <= {probes} AND w.cell = h.cell)")


_CELLS = """
    pivots AS (SELECT v, row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) AS cell FROM e QUALIFY cell <= ceil(sqrt((SELECT count(*) FROM e)::DOUBLE))),
    homes AS (
        SELECT e.vec_id AS id, cell, row_number() OVER (PARTITION BY e.vec_id ORDER BY round(list_dot_product(e.v, p.v), 9) DESC, cell) AS place FROM e, pivots p)"""
_JUDGED = """
    judgments AS (
        SELECT query_id, product_id, CASE abs(brand - asked) WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS grade FROM pairs)"""
_SHOW = "SELECT query_id, rank, product_id, round(score, 6) AS score FROM"


def _metric_sql(name: str, ranking: str) -> str:
    return f"""
    {name}_got AS (
        SELECT r.query_id, sum((pow(2.0::DOUBLE, coalesce(grade, 0)) - 1) / log2(rank + 1)) AS dcg, count(*) FILTER (grade >= 2) AS n_found, count(*) AS n_retrieved, min(rank) FILTER (grade >= 2) AS first
        FROM {ranking} r LEFT JOIN judgments USING (query_id, product_id) GROUP BY r.query_id),
    {name}_ideal AS (
        SELECT query_id, sum((pow(2.0::DOUBLE, grade) - 1) / log2(n + 1)) AS idcg
        FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS n FROM judgments) WHERE n <= 10 GROUP BY query_id),
    {name}_rel AS (SELECT query_id, count(*) FILTER (grade >= 2) AS n_relevant FROM judgments GROUP BY query_id),
    {name} AS (
        SELECT query_id, round(coalesce(CASE WHEN idcg > 0 THEN dcg / idcg END, 0), 9) AS ndcg, coalesce(CASE WHEN n_relevant > 0 THEN n_found / n_relevant::DOUBLE END, 0) AS recall,
               coalesce(1.0::DOUBLE / first, 0) AS mrr, coalesce(CASE WHEN n_relevant > 0 THEN least(10, n_relevant) / n_relevant::DOUBLE END, 0) AS ceiling,
               n_relevant, coalesce(n_found, 0) AS n_found, coalesce(n_retrieved, 0) AS n_retrieved
        FROM {name}_rel JOIN {name}_ideal USING (query_id) LEFT JOIN {name}_got USING (query_id))"""


def _fidelity_sql(name: str, engine: str) -> str:
    return f"""
    {name} AS (
        SELECT query_id, CASE WHEN count(x.rank) > 0 THEN count(x.rank) FILTER (c.rank IS NOT NULL) / least(10, count(x.rank))::DOUBLE ELSE 0 END AS fidelity,
               CASE WHEN least(count(x.rank), count(c.rank)) > 0 THEN count(*) FILTER (x.rank = c.rank) / least(count(x.rank), count(c.rank))::DOUBLE ELSE 0 END AS rank_agreement,
               count(x.rank) FILTER (c.rank IS NULL) AS n_missed
        FROM {engine} c FULL JOIN exact x USING (query_id, product_id) GROUP BY query_id)"""


_EXACT = f"WITH {_BASE}, {_ranked('exact')}"
_BRAND = f"WITH {_BASE}, {_ranked('exact', '(SELECT * FROM pairs WHERE brand = asked)')}"
_MEASURED = f"{_EXACT}, {_JUDGED}, {_metric_sql('m', 'exact')}"
_LOW = f"{_EXACT}, {_CELLS}, {_cell_sql('cells', LOW_PROBES)}"
_METRICS = "round(ndcg, 6) AS ndcg, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ceiling, 6) AS ceiling"
_MEANS = "count(*) AS n_queries, round(avg(ndcg), 6) AS mean_ndcg, round(avg(recall), 6) AS mean_recall, round(avg(mrr), 6) AS mean_mrr, round(avg(ceiling), 6) AS mean_ceiling"
_LAYERS = f"""{_LOW}, {_JUDGED}, {_metric_sql('m', 'cells')},
    good AS (SELECT x.*, c.rank AS engine_rank FROM exact x JOIN judgments j USING (query_id, product_id) LEFT JOIN cells c USING (query_id, product_id) WHERE grade >= 2),
    counts AS (SELECT query_id, count(*) AS n_exact, count(*) FILTER (engine_rank IS NULL) AS n_lost, string_agg(product_id::VARCHAR, ',' ORDER BY rank) FILTER (engine_rank IS NULL) AS lost FROM good GROUP BY query_id),
    layers AS (
        SELECT m.query_id, coalesce(lost, '') AS lost, CASE WHEN coalesce(n_lost, 0) > 0 THEN 'indice' WHEN coalesce(n_exact, 0) = 0 THEN 'representacion' WHEN ceiling < 1 AND recall >= 0.9 * ceiling THEN 'datos_o_filtros' ELSE 'representacion' END AS layer,
               coalesce(n_lost, 0) AS n_lost, {_METRICS}
        FROM m LEFT JOIN counts USING (query_id))"""
_TERMS = r"""
    words AS (SELECT p_partkey AS id, p_brand AS brand, regexp_extract_all(lower(p_name), '[\p{L}\p{N}_]{2,}') AS w FROM part),
    terms AS (
        SELECT id, term, count(*) AS n FROM (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words) GROUP BY ALL),
    vocab AS (SELECT term, count(*) AS df, ln((1.0::DOUBLE + (SELECT count(*) FROM part)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM terms GROUP BY term)"""
_TFIDF = f"""WITH {_TERMS},
    raw AS (SELECT id, term, (1 + ln(n)) * idf AS x FROM terms JOIN vocab USING (term)),
    weights AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM raw),
    dots AS (SELECT q.id AS query_id, d.id AS product_id, round(sum(q.w * d.w), 9) AS score FROM weights q JOIN weights d USING (term) WHERE q.id % 100 = 0 GROUP BY ALL),
    pairs AS (
        SELECT q.id AS query_id, d.id AS product_id, q.brand AS asked, d.brand, coalesce(score, 0) AS score
        FROM words q CROSS JOIN words d LEFT JOIN dots ON dots.query_id = q.id AND dots.product_id = d.id WHERE q.id % 100 = 0)"""

SQL = {
    "exact_topk": f"{_EXACT} {_SHOW} exact",
    "exact_topk_brand": f"{_BRAND} {_SHOW} exact",
    "exact_topk_brand_absent": f"{_BRAND} {_SHOW} exact WHERE query_id % 200 <> 0",
    "topk_cap": f"WITH {_BASE} SELECT query_id, count(*) AS n, count(*) AS last_rank FROM pairs WHERE brand = asked GROUP BY query_id",
    "search_hits": f"{_EXACT} SELECT query_id, rank, product_id, round(score, 6) AS score, label::BIGINT AS brand, 'similarity' AS score_kind, true AS higher_is_better FROM exact JOIN e ON vec_id = product_id",
    "vector_norm_check": """
        SELECT count(*) AS n_rows, count(*) FILTER (embedding IS NULL) AS n_null, count(*) FILTER (len(embedding) <> 64) AS n_dimension,
               count(*) FILTER (len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0) AS n_not_finite,
               count(*) FILTER (abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 0.001::DOUBLE) AS n_norm
        FROM embeddings""",
    "collection_status": "SELECT count(*) AS n_rows, min(len(embedding)) AS dim_min, max(len(embedding)) AS dim_max, 'cosine' AS distance, round(sum(len(embedding)) * 4 / 1024.0::DOUBLE, 6) AS kilobytes FROM embeddings",
    "per_query_metrics": f"{_MEASURED} SELECT query_id, {_METRICS}, n_relevant, n_found, n_retrieved FROM m",
    "ndcg_at_10": f"{_MEASURED} SELECT query_id, round(ndcg, 6) AS ndcg FROM m",
    "recall_at_10": f"{_MEASURED} SELECT query_id, round(recall, 6) AS recall FROM m",
    "mrr_at_10": f"{_MEASURED} SELECT query_id, round(mrr, 6) AS mrr FROM m",
    "recall_ceiling": f"{_MEASURED} SELECT query_id, round(ceiling, 6) AS ceiling, n_relevant FROM m",
    "macro_metrics": f"{_BRAND}, {_JUDGED}, {_metric_sql('m', 'exact')} SELECT {_MEANS} FROM m",
    "unknown_rankings": f"{_EXACT} SELECT DISTINCT query_id FROM exact WHERE query_id % 200 <> 0",
    "duplicate_in_ranking": f"WITH {_BASE}, {_ranked('exact')}, {_ranked('same', '(SELECT * FROM pairs WHERE brand = asked)')} SELECT query_id, product_id, count(*) AS n FROM (SELECT * FROM exact UNION ALL SELECT * FROM same) GROUP BY ALL HAVING count(*) > 1",
    "ivf_topk": f"WITH {_BASE}, {_CELLS}, {_cell_sql('cells', PROBES)} {_SHOW} cells",
    "ivf_all_cells": f"{_EXACT} {_SHOW} exact",
    "ann_fidelity": f"{_EXACT}, {_CELLS}, {_cell_sql('cells', PROBES)}, {_fidelity_sql('f', 'cells')} SELECT query_id, round(fidelity, 6) AS fidelity, round(rank_agreement, 6) AS rank_agreement, n_missed FROM f",
    "rank_agreement": f"{_LOW}, {_fidelity_sql('f', 'cells')} SELECT query_id, round(fidelity, 6) AS fidelity, round(rank_agreement, 6) AS rank_agreement, n_missed FROM f",
    "ann_missed": f"{_LOW} SELECT query_id, exact.rank, product_id FROM exact ANTI JOIN cells USING (query_id, product_id)",
    "nprobe_sweep": f"{_EXACT}, {_CELLS}, "
    + ", ".join(f"{_cell_sql(f'c{n}', n)}, {_fidelity_sql(f'f{n}', f'c{n}')}" for n in SWEEP)
    + " "
    + " UNION ALL ".join(f"SELECT count(*) AS n_queries, round(avg(fidelity), 6) AS mean_fidelity, round(avg(rank_agreement), 6) AS mean_rank_agreement, count(*) FILTER (fidelity >= 1) AS n_perfect, {n}::BIGINT AS probes FROM f{n}" for n in SWEEP),
    "brand_compliance": f"""{_EXACT}
        SELECT r.query_id, count(*) AS n_returned, count(*) FILTER (p.brand = p.asked) AS n_matching,
               coalesce(array_to_string(list_sort(list_distinct(list(p.brand) FILTER (p.brand <> p.asked))), ','), '') AS offending, count(*) = count(*) FILTER (p.brand = p.asked) AS compliant
        FROM exact r JOIN pairs p USING (query_id, product_id) GROUP BY r.query_id""",
    "latency_percentiles": """
        SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS greatest,
               round(quantile_cont(value::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(value::DOUBLE, 0.95), 6) AS p95
        FROM events GROUP BY event_type""",
    "compliance_summary": f"{_EXACT}, rows AS (SELECT r.query_id, bool_and(p.brand = p.asked) AS ok FROM exact r JOIN pairs p USING (query_id, product_id) GROUP BY r.query_id) SELECT count(*) AS n_queries, count(*) FILTER (ok) AS n_compliant, bool_and(ok) AS all_compliant FROM rows",
    "metric_summaries": f"""{_MEASURED} SELECT query_id, '{{"ndcg":' || round(round(ndcg, 6), 4) || ',"recall":' || round(round(recall, 6), 4) || ',"mrr":' || round(round(mrr, 6), 4) || ',"ceiling":' || round(round(ceiling, 6), 4) || ',"n_relevant":' || n_relevant || '}}' AS summary FROM m""",
    "attribution_layers": f"""{_LAYERS} SELECT query_id, layer, n_lost, ndcg, recall, ceiling, lost,
        CASE layer WHEN 'indice' THEN 'relevant products of the exact ranking are missing from the index''s' WHEN 'representacion' THEN 'the exact ranking finds too few of the relevant products' ELSE 'the ranking is about as good as the number of relevant products allows' END AS explanation FROM layers""",
    "index_failure": f"{_LAYERS} SELECT query_id, n_lost, lost FROM layers WHERE n_lost > 0 ORDER BY query_id LIMIT 1",
    "attribution_summary": f"{_LAYERS} SELECT layer, count(*) AS n FROM layers GROUP BY layer",
    "weakest_queries": f"{_MEASURED} SELECT query_id, round(ndcg, 6) AS ndcg FROM m ORDER BY round(ndcg, 6), query_id LIMIT 3",
    "search_artifact_rows": f"{_EXACT} SELECT query_id::VARCHAR AS evaluation_id, rank, product_id::VARCHAR AS product_id, round(score, 6) AS score FROM exact",
    "contract_violations": f"""{_EXACT} SELECT unnest(['evaluation_id missing', 'rank outside 1 to 10', 'product_id missing', 'score missing']) AS rule,
        unnest([(SELECT count(*) FROM exact WHERE rank % 5 = 0), (SELECT count(*) FROM exact WHERE rank + 2 > 10), (SELECT count(*) FROM exact WHERE rank % 3 = 0), (SELECT count(*) FROM exact WHERE rank % 2 = 1)])::BIGINT AS n""",
    "tfidf_vocab": f"WITH {_TERMS} SELECT term, df, round(idf, 6) AS idf FROM vocab",
    "tfidf_topk": f"{_TFIDF}, {_ranked('r')} {_SHOW} r",
    "tfidf_topk_brand": f"{_TFIDF}, {_ranked('r', '(SELECT * FROM pairs WHERE brand = asked)')} {_SHOW} r",
}
