"""Scalar functions over `part` and `supplier`; duplicate detection over `documents`.

Listings are the documents whose id is divisible by 100, held against all documents but themselves. A listing is a duplicate if another
document has the same text; the reference is the least id of those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.functions import scalars as S
from spindrel.operators import artifacts, duplicates, vector
from spindrel.operators.encoding import HashingEncoder
from spindrel.session import table
from spindrel.workspace import small_or_shuffled, staged


def _part(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part")


def clean_scalar(spark, sf):
    """Names with null tokens and blanks put in, by key."""
    key = F.pmod("p_partkey", F.lit(5))
    raw = F.when(key == 0, "  NaN ").when(key == 1, F.lit(None)).when(key == 2, F.concat(F.lit("\t "), F.col("p_name"), F.lit(" \n"))).when(key == 3, "<NA>").otherwise(F.col("p_name"))
    return _part(spark, sf).select("p_partkey", S.clean_scalar(raw).alias("cleaned"))


def clean_flag(spark, sf):
    words = F.array(*[F.lit(x) for x in ("true", "1", " YES ", "si", "Sí", "false", "0", "No", "")])
    return _part(spark, sf).select("p_partkey", S.clean_flag(F.element_at(words, (F.pmod("p_partkey", F.lit(9)) + 1).cast("int"))).alias("flag"))


def clean_version(spark, sf):
    return _part(spark, sf).select("p_partkey", S.clean_version(F.concat(F.col("p_size").cast("string"), F.when(F.pmod("p_partkey", F.lit(2)) == 0, ".0").otherwise(""))).cast("long").alias("version"))


def default_locale(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.default_locale(F.when(F.col("lang") != "en", F.col("lang"))).alias("locale"))


def uuid5_ids(spark, sf):
    return _part(spark, sf).select("p_partkey", S.uuid5(F.col("p_partkey").cast("string")).alias("record_id"))


def id_contract_violations(spark, sf):
    """Ids that were made from the name, for every seventh part, belong to another product."""
    key = F.col("p_partkey").cast("string")
    rows = _part(spark, sf).withColumn("record_id", S.uuid5(F.when(F.pmod("p_partkey", F.lit(7)) == 0, F.col("p_name")).otherwise(key)))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~S.is_uuid5(F.col("record_id"))).alias("n_malformed"), F.count_if(F.col("record_id") != S.uuid5(key)).alias("n_foreign"), (F.count(F.lit(1)) - F.count_distinct("record_id")).alias("n_repeated"))


def _composed(strategy):
    def query(spark, sf):
        rows = _part(spark, sf).withColumn("color", F.when(F.pmod("p_partkey", F.lit(3)) == 0, "").otherwise(F.col("p_type")))
        text = F.when(F.pmod("p_partkey", F.lit(2)) == 0, "").otherwise(F.col("p_type"))
        return rows.select("p_partkey", S.compose(strategy, F.col("p_name"), F.col("p_brand"), F.col("color"), text).alias("composed"))

    return query


def apply_prefix(spark, sf):
    model = F.when(F.pmod("p_partkey", F.lit(2)) == 0, "intfloat/multilingual-e5-base").otherwise("other/model-e50")
    text = F.when(F.pmod("p_partkey", F.lit(3)) == 0, F.concat(F.lit("Query: "), F.col("p_name"))).otherwise(F.concat(F.col("p_name"), F.lit("  ")))
    return _part(spark, sf).select("p_partkey", S.apply_prefix(text, "query", model).alias("prefixed"))


def texts_digest(spark, sf):
    return S.texts_digest(_part(spark, sf), "p_partkey", "p_name", ["p_brand"])


def split_list(spark, sf):
    return _part(spark, sf).select("p_partkey", F.array_join(S.split_list(F.concat_ws(",", F.lit(" "), F.col("p_name"), F.col("p_brand"), F.lit(""))), "|").alias("entries"))


def _vectors(spark, sf) -> DataFrame:
    return staged(HashingEncoder().encode(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text"), "document-vectors")


def hashing_encoder(spark, sf):
    """Vectors as a sum of their entries and of their squares."""
    v = F.col("vector")
    total = lambda f: F.aggregate(v, F.lit(0.0), lambda s, x: s + f(x))
    return _vectors(spark, sf).select("doc_id", F.round(total(lambda x: x), 6).alias("total"), F.round(total(lambda x: x * x), 6).alias("squares"))


def _evidence(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"))
    # The reference is the least other id with the same text: the least of all, or for that one the second.
    firsts = staged(docs.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first-texts")
    twins = small_or_shuffled(firsts)
    seconds = docs.join(twins, "digest").where("doc_id <> first").groupBy("digest").agg(F.min("first").alias("first"), F.min("doc_id").alias("second"))
    listings = docs.where("doc_id % 100 = 0").join(small_or_shuffled(staged(seconds, "second-texts")), "digest", "left")
    reference = F.when(F.col("doc_id") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    listings = listings.select(F.col("doc_id").alias("listing_id"), F.col("first").isNotNull().alias("is_duplicate"), reference.alias("reference_id"))
    vectors = _vectors(spark, sf)
    queries = vectors.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    ranked = vector.exact_topk(queries, vectors.withColumnRenamed("doc_id", "product_id"), 2, skip_self=True)
    return staged(duplicates.evidence(listings, ranked.withColumnRenamed("query_id", "listing_id")), "evidence")


def _decided(spark, sf) -> DataFrame:
    rows = _evidence(spark, sf)
    return duplicates.decide(rows.join(F.broadcast(duplicates.choose(rows, strict=False))), F.col("threshold"))


def _rounded(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.round(n, 6) for n in names})


def dup_evidence(spark, sf):
    return _rounded(_evidence(spark, sf), "score", "runner_up", "margin")


def dup_decisions(spark, sf):
    return _rounded(_decided(spark, sf).select("listing_id", "predicted", "matched_id", "score"), "score")


def dup_confusion(spark, sf):
    return _rounded(duplicates.confusion(_decided(spark, sf)), "precision", "recall", "f1")


def dup_class_stats(spark, sf):
    return _rounded(duplicates.class_stats(_evidence(spark, sf)), "dup_min", "dup_max", "dup_mean", "new_min", "new_max", "new_mean", "separation")


def dup_sweep(spark, sf):
    return _rounded(duplicates.sweep(_evidence(spark, sf)).withColumn("step", F.col("step").cast("long")), "threshold", "precision", "recall", "f1")


def dup_threshold(spark, sf):
    return _rounded(duplicates.choose(_evidence(spark, sf), strict=False), "threshold")


def dup_error_analysis(spark, sf):
    """With a threshold of 0.99, so that there are errors."""
    return duplicates.errors(duplicates.decide(_evidence(spark, sf), 0.99)).select("listing_id", "kind")


def duplicate_artifact_rows(spark, sf):
    return artifacts.duplicate_rows(_decided(spark, sf))


_NAMES = "clean_scalar clean_flag clean_version default_locale uuid5_ids id_contract_violations apply_prefix texts_digest split_list hashing_encoder dup_evidence dup_decisions dup_confusion dup_class_stats dup_sweep dup_threshold dup_error_analysis duplicate_artifact_rows".split()
QUERIES = {name: globals()[name] for name in _NAMES} | {f"compose_{s}": _composed(s) for s in S.STRATEGIES}

_UUID_OF = """
    SELECT p_partkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', ('0x' || h[17:17])::INT % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS record_id
    FROM (SELECT p_partkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({name}::VARCHAR)) AS h FROM part)"""
_UUID = f"ids AS ({_UUID_OF.format(name='p_partkey')})"
_ENCODED = r"""
    tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS token FROM documents),
    buckets AS (SELECT doc_id, ('0x' || substr(md5(token), 1, 8))::BIGINT % 64 AS bucket, count(*)::DOUBLE AS n FROM tokens GROUP BY ALL),
    weights AS (SELECT doc_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS w FROM buckets)"""
_EVIDENCE = f"""WITH {_ENCODED},
    texts AS (SELECT doc_id, md5(text) AS digest FROM documents),
    listings AS (
        SELECT l.doc_id AS listing_id, count(o.doc_id) > 0 AS is_duplicate, min(o.doc_id) AS reference_id
        FROM texts l LEFT JOIN texts o ON o.digest = l.digest AND o.doc_id <> l.doc_id WHERE l.doc_id % 100 = 0 GROUP BY l.doc_id),
    dots AS (SELECT q.doc_id AS listing_id, d.doc_id AS product_id, sum(q.w * d.w) AS s FROM weights q JOIN weights d USING (bucket) WHERE q.doc_id % 100 = 0 AND d.doc_id <> q.doc_id GROUP BY ALL),
    ranked AS (
        SELECT l.listing_id, t.doc_id AS product_id, round(coalesce(s, 0), 9) + 0.0 AS score, row_number() OVER (PARTITION BY l.listing_id ORDER BY round(coalesce(s, 0), 9) DESC, t.doc_id) AS rank
        FROM listings l JOIN texts t ON t.doc_id <> l.listing_id LEFT JOIN dots ON dots.listing_id = l.listing_id AND dots.product_id = t.doc_id),
    evidence AS (
        SELECT l.listing_id, l.is_duplicate, l.reference_id, max(product_id) FILTER (rank = 1) AS best_id, coalesce(max(score) FILTER (rank = 1), 0) AS score,
               max(score) FILTER (rank = 2) AS runner_up, max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2) AS margin
        FROM listings l LEFT JOIN ranked ON ranked.listing_id = l.listing_id AND rank <= 2 GROUP BY ALL)"""
_STATS = """
    stats AS (
        SELECT count(*) FILTER (is_duplicate) AS dup_n, min(score) FILTER (is_duplicate) AS dup_min, max(score) FILTER (is_duplicate) AS dup_max, avg(score) FILTER (is_duplicate) AS dup_mean,
               count(*) FILTER (NOT is_duplicate) AS new_n, min(score) FILTER (NOT is_duplicate) AS new_min, max(score) FILTER (NOT is_duplicate) AS new_max, avg(score) FILTER (NOT is_duplicate) AS new_mean FROM evidence)"""
_RATIOS = """CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END AS recall,
               CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END AS f1"""
_SWEEP = f"""
    ends AS (SELECT min(score) AS low, max(score) AS high FROM evidence),
    grid AS (SELECT step, round(low + (high - low) * step / 200.0::DOUBLE, 9) AS threshold FROM ends, range(0, 201) r(step)),
    counted AS (
        SELECT step, threshold, count(*) FILTER (is_duplicate AND hit) AS tp, count(*) FILTER (NOT is_duplicate AND hit) AS fp, count(*) FILTER (NOT is_duplicate AND NOT hit) AS tn,
               count(*) FILTER (is_duplicate AND NOT hit) AS fn, count(*) FILTER (is_duplicate AND hit AND reference_id IS NOT NULL AND best_id <> reference_id) AS wrong_candidate
        FROM (SELECT *, best_id IS NOT NULL AND round(score, 9) >= threshold AS hit FROM evidence, grid) GROUP BY ALL),
    swept AS (SELECT *, {_RATIOS} FROM counted)"""
_CHOSEN = f"""{_STATS}, {_SWEEP},
    chosen AS (
        SELECT CASE WHEN dup_min > new_max THEN (dup_min + new_max) / 2 ELSE (SELECT threshold FROM swept ORDER BY f1 DESC, fn, step LIMIT 1) END AS threshold,
               CASE WHEN dup_min > new_max THEN 'midpoint' ELSE 'max_f1' END AS method FROM stats),
    decided AS (SELECT evidence.*, best_id IS NOT NULL AND score >= threshold AS predicted FROM evidence, chosen)"""


def _case(parts: str) -> str:
    return f"SELECT p_partkey, {parts} FROM part"


_COLOR = "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'Color: ' || p_type END"
SQL = {
    "clean_scalar": _case("CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 3 THEN '' ELSE trim(p_name) END AS cleaned"),
    "clean_flag": _case("p_partkey % 9 < 5 AS flag"),
    "clean_version": _case("p_size::BIGINT AS version"),
    "default_locale": "SELECT doc_id, CASE lang WHEN 'en' THEN 'es' ELSE lang END AS locale FROM documents",
    "uuid5_ids": f"WITH {_UUID} SELECT p_partkey, record_id FROM ids",
    "id_contract_violations": f"""WITH {_UUID}, other AS ({_UUID_OF.format(name='p_name')}), found AS (SELECT p_partkey, ids.record_id AS own, CASE WHEN p_partkey % 7 = 0 THEN other.record_id ELSE ids.record_id END AS record_id FROM ids JOIN other USING (p_partkey))
        SELECT count(*) AS n_rows, count(*) FILTER (NOT regexp_full_match(record_id, '[0-9a-f]{{8}}-[0-9a-f]{{4}}-5[0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}')) AS n_malformed, count(*) FILTER (record_id <> own) AS n_foreign, count(*) - count(DISTINCT record_id) AS n_repeated FROM found""",
    "compose_raw_text": _case("CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END AS composed"),
    "compose_title_only": _case("trim(p_name) AS composed"),
    "compose_title_brand_color": _case(f"concat_ws('. ', p_name, 'Marca: ' || p_brand, {_COLOR}) AS composed"),
    "apply_prefix": _case("CASE WHEN p_partkey % 3 = 0 THEN 'Query: ' || p_name WHEN p_partkey % 2 = 0 THEN 'query: ' || p_name ELSE p_name END AS prefixed"),
    "texts_digest": "SELECT p_brand, sha256(string_agg(p_name || chr(0), '' ORDER BY p_partkey)) AS digest, count(*) AS n_texts FROM part GROUP BY p_brand",
    "split_list": _case("CASE WHEN upper(p_name) = upper(p_brand) THEN upper(p_name) ELSE upper(p_name) || '|' || upper(p_brand) END AS entries"),
    "hashing_encoder": f"WITH {_ENCODED} SELECT doc_id, round(coalesce(sum(w), 0), 6) AS total, round(coalesce(sum(w * w), 0), 6) AS squares FROM documents LEFT JOIN weights USING (doc_id) GROUP BY doc_id",
    "dup_evidence": f"{_EVIDENCE} SELECT listing_id, is_duplicate, reference_id, best_id, round(score, 6) AS score, round(runner_up, 6) AS runner_up, round(margin, 6) AS margin FROM evidence",
    "dup_decisions": f"{_EVIDENCE}, {_CHOSEN} SELECT listing_id, predicted, CASE WHEN predicted THEN best_id END AS matched_id, round(score, 6) AS score FROM decided",
    "dup_confusion": f"""{_EVIDENCE}, {_CHOSEN},
        c AS (SELECT count(*) FILTER (is_duplicate AND predicted) AS tp, count(*) FILTER (NOT is_duplicate AND predicted) AS fp, count(*) FILTER (NOT is_duplicate AND NOT predicted) AS tn,
                     count(*) FILTER (is_duplicate AND NOT predicted) AS fn, count(*) FILTER (is_duplicate AND predicted AND best_id <> reference_id) AS wrong_candidate FROM decided)
        SELECT tp, fp, tn, fn, wrong_candidate, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM (SELECT *, {_RATIOS} FROM c)""",
    "dup_class_stats": f"{_EVIDENCE}, {_STATS} SELECT dup_n, round(dup_min, 6) AS dup_min, round(dup_max, 6) AS dup_max, round(dup_mean, 6) AS dup_mean, new_n, round(new_min, 6) AS new_min, round(new_max, 6) AS new_max, round(new_mean, 6) AS new_mean, round(dup_min - new_max, 6) AS separation FROM stats",
    "dup_sweep": f"{_EVIDENCE}, {_SWEEP} SELECT step, round(threshold, 6) AS threshold, tp, fp, tn, fn, wrong_candidate, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM swept",
    "dup_threshold": f"{_EVIDENCE}, {_CHOSEN} SELECT round(threshold, 6) AS threshold, method FROM chosen",
    "dup_error_analysis": f"""{_EVIDENCE} SELECT listing_id, kind FROM (
        SELECT listing_id, CASE WHEN NOT is_duplicate AND score >= 0.99::DOUBLE THEN 'false_positive' WHEN is_duplicate AND score < 0.99::DOUBLE THEN 'false_negative'
                                WHEN is_duplicate AND best_id <> reference_id THEN 'wrong_candidate' END AS kind FROM evidence) WHERE kind IS NOT NULL""",
    "duplicate_artifact_rows": f"{_EVIDENCE}, {_CHOSEN} SELECT listing_id::VARCHAR AS incoming_id, predicted AS predicted_duplicate, CASE WHEN predicted THEN best_id::VARCHAR ELSE '' END AS matched_product_id, round(score, 6) AS score FROM decided",
}
