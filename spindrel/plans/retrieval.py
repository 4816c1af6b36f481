"""Text search, experiments and delivery: texts of `benchmark` in `documents`, names of `part` among its own rows.

Experiments: the queries are the parts whose key is divisible by 100, against all other parts. A part of the same brand
and type has grade 3, of the brand 2, of the type 1, any other 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.functions import scalars as S
from spindrel.operators import artifacts, attribution, evaluation, vector
from spindrel.operators.encoding import HashingEncoder, encode_role
from spindrel.operators.lexical import TfidfIndex
from spindrel.operators.retrieval import Retriever
from spindrel.plans import catalog, ranking
from spindrel.session import table
from spindrel.sources.catalog import read_duplicate_results, read_search_results, write_all, write_metrics
from spindrel.workspace import scratch, small_or_shuffled, staged

K = 10
#: An encoder that is called so gets the prefixes of its kind.
MODEL = "spindrel/e5-hashing"


def _retriever(spark: SparkSession, sf: str) -> Retriever:
    docs = table(spark, sf, "documents").where(S.strip(F.col("text")) != "").select(F.col("doc_id").alias("product_id"), F.col("lang").alias("brand"), "text")
    encoder = HashingEncoder()
    vectors = encode_role(encoder, docs, "product_id", "text", "passage", MODEL)
    return Retriever(staged(vectors.join(docs.drop("text"), "product_id"), "text-collection"), encoder, MODEL)


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def _hits(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "product_id", F.round("score", 6).alias("score"), "brand", "score_kind", "higher_is_better")


def text_search(spark, sf):
    """Every benchmark text against all documents."""
    return _hits(_retriever(spark, sf).search_many(_asked(spark, sf), K))


def text_search_brand(spark, sf):
    """The same, each query among the documents of one language only."""
    languages = F.array(*[F.lit(x) for x in ("en", "fr", "de", "es", "none")])
    return _hits(_retriever(spark, sf).search_many(_asked(spark, sf).withColumn("brand", F.element_at(languages, (F.pmod("query_id", F.lit(5)) + 1).cast("int"))), K))


def title_prefixes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.title_prefix(F.col("text")).alias("title"), S.title_prefix(F.col("text"), 22).alias("short"))


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part")
    return rows.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("color"))


def _grade(spark: SparkSession, sf: str):
    rows = _parts(spark, sf).select("product_id", "brand", "color")

    def graded(ranked: DataFrame) -> DataFrame:
        both = ranked.join(rows, "product_id").join(rows.select(F.col("product_id").alias("query_id"), F.col("brand").alias("_b"), F.col("color").alias("_c")), "query_id")
        return both.withColumn("grade", F.when(F.col("brand") == F.col("_b"), 2.0).otherwise(0.0) + F.when(F.col("color") == F.col("_c"), 1.0).otherwise(0.0)).select(*ranked.columns, "grade")

    return graded


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, grade, n from the numbers of parts of each brand and type."""
    rows = _parts(spark, sf)
    one = lambda *keys: rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_" + "_".join(keys)))
    asked = rows.where("product_id % 100 = 0").select(F.col("product_id").alias("query_id"), "brand", "color")
    for keys in (("brand", "color"), ("brand",), ("color",)):
        asked = asked.join(small_or_shuffled(one(*keys)), list(keys))
    total = rows.agg(F.count(F.lit(1)).alias("n_all"))
    asked = asked.join(F.broadcast(total))
    both, brand, color = F.col("n_brand_color"), F.col("n_brand"), F.col("n_color")
    grades = {3.0: both - 1, 2.0: brand - both, 1.0: color - both, 0.0: F.col("n_all") - brand - color + both}
    return asked.select("query_id", F.inline(F.array(*[F.struct(F.lit(g).alias("grade"), n.alias("n")) for g, n in grades.items()])))


def _experiments(spark: SparkSession, sf: str) -> list[attribution.Experiment]:
    rows = _parts(spark, sf)
    none = F.lit("")
    texts = {"raw_text": rows.select("product_id", S.compose("raw_text", F.col("title"), F.col("brand"), F.col("color"), none).alias("text")), "title_brand_color": rows.select("product_id", S.compose("title_brand_color", F.col("title"), F.col("brand"), F.col("color"), none).alias("text"))}

    def lexical() -> DataFrame:
        collection = texts["raw_text"]
        asked = collection.where("product_id % 100 = 0").withColumnRenamed("product_id", "query_id")
        ranked = TfidfIndex(collection).search(asked, K + 1).where("query_id <> product_id")  # without the query itself
        return ranked.withColumn("rank", F.row_number().over(vector.Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= K)

    def dense(strategy: str, dimension: int) -> DataFrame:
        encoded = lambda rows: HashingEncoder(dimension).encode(rows, "product_id", "text")
        # Equal texts tie, so of each only the least ids can be in a ranking: one more than K, as a query leaves itself out.
        vectors = staged(encoded(vector.least_of_each(texts[strategy], ["text"], K + 1)), "experiment-vectors")
        asked = staged(encoded(texts[strategy].where("product_id % 100 = 0")), "experiment-queries").withColumnRenamed("product_id", "query_id")
        return vector.exact_topk(asked, vectors, K, skip_self=True)

    made = lambda name, retriever, strategy, dimension=0: attribution.Experiment(
        name, {"retriever": retriever, "strategy": strategy, "dimension": str(dimension)}, lexical if retriever == "tfidf" else lambda: dense(strategy, dimension)
    )
    return [made("E0", "tfidf", "raw_text"), made("E1", "dense_exact", "raw_text", 64), made("E2", "dense_exact", "title_brand_color", 64), made("E3", "dense_exact", "title_brand_color", 256)]


def _compared(spark: SparkSession, sf: str) -> DataFrame:
    return attribution.compare(_experiments(spark, sf), _grade(spark, sf), _counts(spark, sf), K)


def experiment_comparison(spark, sf):
    rows = _compared(spark, sf)
    return rows.select("experiment", "n_queries", *[F.round(f"mean_{m}", 6).alias(f"mean_{m}") for m in ("ndcg", "recall", "mrr", "ceiling")], F.size("retrieved").cast("long").alias("n_retrieved"))


def experiment_winner(spark, sf):
    return attribution.winner(experiment_comparison(spark, sf), ["E1", "E2"]).select("experiment", "mean_ndcg")


def experiment_contract(spark, sf):
    """Rules that the experiments break: none, and all of them once they are spoilt."""
    rows = staged(_compared(spark, sf), "experiments")
    spoilt = rows.withColumns({"experiment": F.lit("run"), "configuration": F.lit("{}"), "mean_ndcg": F.lit(1.5), "retrieved": F.lit(None).cast(rows.schema["retrieved"].dataType)})
    one = lambda x, name: artifacts.violations(x, attribution.EXPERIMENT_CONTRACT).withColumn("rows", F.lit(name))
    return one(rows, "made").unionByName(one(spoilt, "spoilt"))


def deliver(spark: SparkSession, sf: str, where: str) -> DataFrame:
    """The delivery: rankings of the blind queries, duplicate decisions at a frozen threshold, metrics with fidelity,
    compliance, latency and attribution. All artifacts are checked before the first is written, then read back and
    checked again: a row for each (see artifacts.recheck)."""
    exact = staged(ranking._exact(spark, sf), "delivered-exact")
    engine = staged(ranking._cells(spark, sf), "delivered-ranking")
    grade, counts = ranking._grade(spark, sf), ranking._counts(spark, sf)
    search = artifacts.search_rows(engine)
    decisions = catalog.duplicate_artifact_rows(spark, sf)
    means = evaluation.macro_of(grade(engine), counts, K)
    parts = [
        evaluation.fidelity_report(evaluation.fidelity(engine, exact, K)).select("mean_fidelity", "n_perfect"),
        evaluation.compliance_summary(ranking.brand_compliance(spark, sf)).select("n_compliant"),
        evaluation.latency(table(spark, sf, "events"), "value").select("p50", "p95"),
        attribution.attribute_of(grade(engine), grade(exact), counts, K).agg(F.count_if(F.col("layer") == attribution.INDEX).alias("n_index"), F.count_if(F.col("layer") == attribution.REPRESENTATION).alias("n_representation")),
    ]
    for part in parts:
        means = means.join(F.broadcast(part))
    metrics = staged(means, "delivered-metrics")
    artifacts.require(metrics, artifacts.METRICS_CONTRACT)
    write_all([(search, f"{where}/search", artifacts.SEARCH_CONTRACT), (decisions, f"{where}/duplicates", artifacts.DUPLICATE_CONTRACT)])
    write_metrics(metrics, f"{where}/metrics", artifacts.METRICS_CONTRACT)
    written = spark.read.schema(metrics.schema).json(f"{where}/metrics")
    return artifacts.recheck(read_search_results(spark, f"{where}/search"), read_duplicate_results(spark, f"{where}/duplicates"), written)


def deliver_recheck(spark, sf):
    return staged(deliver(spark, sf, scratch(spark, "delivery")), "recheck")


_NAMES = "text_search text_search_brand title_prefixes experiment_comparison experiment_winner experiment_contract deliver_recheck".split()
QUERIES = {name: globals()[name] for name in _NAMES}


def _hashed(name: str, source: str, dimension: int = 64) -> str:
    """Weights of hash buckets of a source's texts (id, text)."""
    return rf"""
    {name}_tokens AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS token FROM {source}),
    {name}_buckets AS (SELECT id, ('0x' || substr(md5(token), 1, 8))::BIGINT % {dimension} AS bucket, count(*)::DOUBLE AS n FROM {name}_tokens GROUP BY ALL),
    {name} AS (SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS w FROM {name}_buckets)"""


_TEXTS = f"""WITH
    docs AS (SELECT doc_id AS id, lang, 'passage: ' || text AS text FROM documents WHERE trim(text) <> ''),
    asked AS (SELECT item_id AS id, 'query: ' || text AS text, ['en', 'fr', 'de', 'es', 'none'][item_id % 5 + 1] AS brand FROM benchmark),
    {_hashed('dw', 'docs')}, {_hashed('qw', 'asked')},
    dots AS (SELECT qw.id AS q, dw.id AS d, sum(qw.w * dw.w) AS s FROM qw JOIN dw USING (bucket) GROUP BY ALL),
    scored AS (SELECT asked.id AS query_id, docs.id AS product_id, docs.lang AS brand, asked.brand AS asked, round(coalesce(s, 0), 9) + 0.0 AS score FROM asked CROSS JOIN docs LEFT JOIN dots ON q = asked.id AND d = docs.id)"""


def _top(keep: str) -> str:
    return f"""{_TEXTS} SELECT query_id, rank, product_id, round(score, 6) AS score, brand, 'similarity' AS score_kind, true AS higher_is_better
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM scored WHERE {keep}) WHERE rank <= {K}"""


def _dense(name: str, source: str, dimension: int) -> str:
    return f"""{_hashed(name + '_w', source, dimension)},
    {name}_dots AS (SELECT q.id AS q, d.id AS d, sum(q.w * d.w) AS s FROM {name}_w q JOIN {name}_w d USING (bucket) WHERE q.id % 100 = 0 GROUP BY ALL),
    {name}_scored AS (SELECT query_id, product_id, round(coalesce(s, 0), 9) + 0.0 AS score FROM judgments LEFT JOIN {name}_dots ON q = query_id AND d = product_id),
    {ranking._ranked(name, name + '_scored').strip()}"""


_EXPERIMENTS = f"""{ranking._TFIDF.replace(' pairs AS', ' lexical AS')},
    judgments AS (
        SELECT q.p_partkey AS query_id, d.p_partkey AS product_id, CASE WHEN q.p_brand = d.p_brand THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN q.p_type = d.p_type THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS grade
        FROM part q JOIN part d ON d.p_partkey <> q.p_partkey WHERE q.p_partkey % 100 = 0),
    raw_text AS (SELECT p_partkey AS id, p_name AS text FROM part),
    full_text AS (SELECT p_partkey AS id, concat_ws('. ', p_name, 'Marca: ' || p_brand, 'Color: ' || p_type) AS text FROM part),
    {ranking._ranked('e0', '(SELECT * FROM lexical WHERE query_id <> product_id)').strip()},
    {_dense('e1', 'raw_text', 64)}, {_dense('e2', 'full_text', 64)}, {_dense('e3', 'full_text', 256)},
    {', '.join(ranking._metric_sql(f'm{n}', f'e{n}').strip() for n in range(4))},
    compared AS ({' UNION ALL '.join(f"SELECT 'E{n}' AS experiment, {ranking._MEANS}, count(*) FILTER (n_retrieved > 0) AS n_retrieved FROM m{n}" for n in range(4))})"""

SQL = {
    "text_search": _top("true"),
    "text_search_brand": _top("brand = asked"),
    "title_prefixes": "SELECT doc_id, substr(text, 1, 80) AS title, substr(text, 1, 22) AS short FROM documents",
    "experiment_comparison": f"{_EXPERIMENTS} SELECT * FROM compared",
    "experiment_winner": f"{_EXPERIMENTS} SELECT experiment, mean_ndcg FROM compared WHERE experiment IN ('E1', 'E2') ORDER BY mean_ndcg DESC, experiment LIMIT 1",
    "experiment_contract": f"""{_EXPERIMENTS}, rules AS (SELECT unnest(['name missing', 'configuration missing', 'mean outside 0 to 1', 'retrieved ids missing']) AS rule)
        SELECT rule, 'spoilt' AS rows, (SELECT count(*) FROM compared) AS n FROM rules UNION ALL
        SELECT rule, 'made', (SELECT count(*) FROM compared WHERE (rule LIKE 'mean%' AND NOT (mean_ndcg BETWEEN 0 AND 1 AND mean_recall BETWEEN 0 AND 1 AND mean_mrr BETWEEN 0 AND 1)) OR (rule LIKE 'retrieved%' AND n_retrieved = 0)) FROM rules""",
    "deliver_recheck": f"""{ranking._EXACT}, {ranking._CELLS}, {ranking._cell_sql('cells', ranking.PROBES)}, {catalog._EVIDENCE.removeprefix('WITH ')}, {catalog._CHOSEN}
        SELECT 'search' AS artifact, count(*) AS n_rows, count(DISTINCT query_id) AS n_groups, 0::BIGINT AS n_positive, count(*) FILTER (rank NOT BETWEEN 1 AND 10 OR score IS NULL) AS n_broken FROM cells UNION ALL
        SELECT 'duplicates', count(*), count(DISTINCT listing_id), count(*) FILTER (predicted), count(*) FILTER (score NOT BETWEEN -1 AND 1 OR (predicted AND best_id IS NULL)) FROM decided UNION ALL
        SELECT 'metrics', 1, 1, 0, CASE WHEN (SELECT count(DISTINCT query_id) FROM cells) < 1 THEN 1 ELSE 0 END""",
}
