"""Catalog sources and sinks: CSV read as text and coerced by name, checked before use; artifacts validated before writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.errors import ArtifactError, ContractError, DataIntegrityError
from spindrel.functions import scalars as S
from spindrel.operators import artifacts

#: Columns of the sources.
CATALOG = ["record_id", "product_id", "title", "brand", "color", "locale", "text", "catalog_version", "active"]
DEVELOPMENT, BLIND = ["workload_id", "query_id", "query_text", "query_type"], ["evaluation_id", "query_text", "query_type"]
FILTERED = ["workload_id", "query_text", "filter_field", "filter_operator", "filter_value", "expected_property"]
JUDGMENTS, LISTINGS = ["query_id", "product_id", "esci_label", "relevance"], ["incoming_id", "title", "brand", "color", "text"]
GRADES = {"E": 3.0, "S": 2.0, "C": 1.0, "I": 0.0}


def exists(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def read_text_csv(spark: SparkSession, path: str, required: list[str], parts: int | None = None) -> DataFrame:
    """A CSV (or gzipped CSV) with every column as text. gzip can't be split: parts deals the rows out."""
    if not exists(spark, path):
        raise DataIntegrityError(f"{path} is missing")
    rows = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    lacking = [c for c in required if c not in rows.columns]
    if lacking:
        raise DataIntegrityError(f"{path} lacks the columns {', '.join(lacking)}")
    return rows.repartition(parts) if parts else rows


def coerce_catalog(rows: DataFrame) -> DataFrame:
    """Catalog columns with their types; missing values are empty texts."""
    text = [S.clean_scalar(F.col(c)).alias(c) for c in CATALOG[:5]]
    return rows.select(*text, S.default_locale(F.col("locale")).alias("locale"), S.clean_scalar(F.col("text")).alias("text"), S.clean_version(F.col("catalog_version")).alias("catalog_version"), S.clean_flag(F.col("active")).alias("active"))


def require_records(catalog: DataFrame) -> DataFrame:
    """catalog, if every row has what a record needs."""
    broken = catalog_violations(catalog, verify_ids=False).where("n > 0 and rule not like '%repeated'").collect()
    if broken:
        raise ContractError("; ".join(f"{r['rule']}: {r['n']}" for r in broken))
    return catalog


def catalog_violations(catalog: DataFrame, verify_ids: bool = True) -> DataFrame:
    """rule, n in one pass: repeated ids, missing values, ids that aren't the UUIDv5 of the product id."""
    rules = {
        "record_id repeated": F.count("record_id") - F.count_distinct("record_id"),
        "product_id repeated": F.count("product_id") - F.count_distinct("product_id"),
        "product_id missing": F.count_if(F.col("product_id") == ""),
        "title missing": F.count_if(F.col("title") == ""),
        "version missing": F.count_if(F.col("catalog_version").isNull() | (F.col("catalog_version") < 1)),
        "record_id no UUIDv5": F.count_if(~S.is_uuid5(F.col("record_id"))),
        "record_id of another product": F.count_if(F.col("record_id") != S.uuid5(F.col("product_id"))) if verify_ids else F.lit(0),
    }
    counted = catalog.agg(*[c.alias(f"r{i}") for i, c in enumerate(rules.values())])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").cast("long").alias("n")) for i, n in enumerate(rules)])))


def load_catalog(spark: SparkSession, path: str, expected: int | None = None, verify_ids: bool = True, parts: int | None = None) -> DataFrame:
    catalog = coerce_catalog(read_text_csv(spark, path, CATALOG, parts))
    if expected is not None and (n := catalog.count()) != expected:
        raise DataIntegrityError(f"{path} has {n} rows; the manifest says {expected}")
    broken = catalog_violations(catalog, verify_ids).where("n > 0").collect()
    if broken:
        raise DataIntegrityError("; ".join(f"{r['rule']}: {r['n']}" for r in broken))
    return catalog


def load_development_queries(spark: SparkSession, path: str) -> DataFrame:
    return read_text_csv(spark, path, DEVELOPMENT).select(*[S.clean_scalar(F.col(c)).alias(c) for c in DEVELOPMENT]).withColumn("query_id", F.col("query_id").cast("int"))


def load_blind_queries(spark: SparkSession, path: str) -> DataFrame:
    return read_text_csv(spark, path, BLIND).select(*[S.clean_scalar(F.col(c)).alias(c) for c in BLIND])


def load_filtered_queries(spark: SparkSession, path: str) -> DataFrame:
    """Queries with their brand; any other filter is an error."""
    rows = read_text_csv(spark, path, FILTERED).select(*[S.clean_scalar(F.col(c)).alias(c) for c in FILTERED])
    if not rows.where((F.col("filter_field") != "brand") | (F.col("filter_operator") != "equals")).isEmpty():
        raise DataIntegrityError("only filters of the form brand equals are supported")
    return rows.withColumn("brand", F.col("filter_value"))


def load_judgments(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """query_id (the workload's), product_id, grade; an unknown query, or a label that contradicts its grade, is an error."""
    rows = read_text_csv(spark, path, JUDGMENTS).select(S.clean_scalar(F.col("query_id")).cast("int").alias("number"), S.clean_scalar(F.col("product_id")).alias("product_id"), F.upper(S.clean_scalar(F.col("esci_label"))).alias("label"), F.col("relevance").cast("double").alias("grade"))
    grades = F.create_map(*[F.lit(x) for pair in GRADES.items() for x in pair])
    joined = rows.join(F.broadcast(queries.select(F.col("query_id").alias("number"), F.col("workload_id").alias("query_id"))), "number", "left")
    bad = joined.where(F.col("query_id").isNull() | F.col("grade").isNull() | ~F.coalesce(F.try_element_at(grades, F.col("label")) == F.col("grade"), F.lit(False)))
    if not bad.isEmpty():
        raise DataIntegrityError("a judgment has no query, or its label and grade differ")
    return joined.select("query_id", "product_id", "grade")


def load_listings(spark: SparkSession, path: str) -> DataFrame:
    """Incoming listings; is_duplicate and reference_product_id only if the file has them."""
    rows = read_text_csv(spark, path, LISTINGS)
    labels = [S.clean_flag(F.col("is_duplicate")).alias("is_duplicate"), S.clean_scalar(F.col("reference_product_id")).alias("reference_product_id")] if "is_duplicate" in rows.columns else []
    return rows.select(*[S.clean_scalar(F.col(c)).alias(c) for c in LISTINGS], *labels)


def load_events(spark: SparkSession, path: str) -> DataFrame:
    """Ordered changes: sequence, event_id, op, and a record for upserts only."""
    rows = read_text_csv(spark, path, ["sequence", "event_id", "operation", *CATALOG])
    op = F.upper(S.clean_scalar(F.col("operation")))
    catalog = F.struct(*[S.clean_scalar(F.col(c)).alias(c) for c in CATALOG])
    out = rows.select(F.col("sequence").cast("int").alias("sequence"), S.clean_scalar(F.col("event_id")).alias("event_id"), op.alias("op"), S.clean_scalar(F.col("record_id")).alias("key"), S.clean_scalar(F.col("title")).alias("title"), F.when(op == "UPSERT", catalog).alias("record"))
    if not out.where(~F.col("op").isin("UPSERT", "DELETE") | (F.col("key") == "")).isEmpty():
        raise DataIntegrityError("an event has no key or an unknown operation")
    from spindrel.operators.changes import require_sequence

    require_sequence(out)
    return out.orderBy("sequence")


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, sha256 of the manifest's files."""
    if not exists(spark, path):
        raise DataIntegrityError(f"{path} is missing")
    rows = spark.read.option("wholetext", True).text(path)
    return rows.select(F.explode(F.from_json(F.get_json_object("value", "$.files"), "map<string,string>")).alias("file", "sha256"))


def manifest_counts(spark: SparkSession, path: str) -> DataFrame:
    """snapshot_id, source (as JSON or text), name, n: the counts that the manifest gives, and where the data come from."""
    if not exists(spark, path):
        raise DataIntegrityError(f"{path} is missing")
    field = lambda name: F.get_json_object("value", f"$.{name}")
    rows = spark.read.option("wholetext", True).text(path)
    return rows.select(field("snapshot_id").alias("snapshot_id"), field("source").alias("source"), F.explode_outer(F.from_json(field("counts"), "map<string,string>")).alias("name", "n")).withColumn("n", F.col("n").try_cast("long"))


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """file, sha256 of each file of a folder."""
    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").load(folder).select(name.alias("file"), F.sha2("content", 256).alias("sha256"))


def integrity(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """file, present, matches (null if no checksum is expected), ok."""
    rows = expected.join(actual.withColumnRenamed("sha256", "found"), "file", "left")
    out = rows.select("file", F.col("found").isNotNull().alias("present"), (F.lower("sha256") == F.col("found")).alias("matches"))
    return out.withColumn("ok", F.col("present") & F.coalesce("matches", F.lit(True)))


def write_csv(rows: DataFrame, path: str, contract: dict[str, str]) -> None:
    """One CSV folder; nothing is written unless all rows keep the contract. Delivered artifacts are small."""
    artifacts.require(rows, contract)
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def read_search_results(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark, path, "evaluation_id string, rank int, product_id string, score double")


def read_duplicate_results(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark, path, "incoming_id string, predicted_duplicate boolean, matched_product_id string, score double").na.fill("", ["matched_product_id"])


def _typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not exists(spark, path):
        raise ArtifactError(f"{path} is missing")
    return spark.read.schema(schema).option("header", True).csv(path)


def write_metrics(rows: DataFrame, path: str, contract: dict[str, str] | None = None) -> None:
    """Rows as JSON objects, one a line, if all keep the contract."""
    artifacts.require(rows, contract or {})
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_experiments(rows: DataFrame, path: str) -> None:
    """Experiment rows as JSON objects, if all keep the contract: configuration, metrics and retrieved ids."""
    from spindrel.operators.attribution import EXPERIMENT_CONTRACT

    write_metrics(rows, path, EXPERIMENT_CONTRACT)


def write_all(outputs: list[tuple[DataFrame, str, dict[str, str]]]) -> None:
    """Checks all artifacts before it writes the first."""
    for rows, _, contract in outputs:
        artifacts.require(rows, contract)
    for rows, path, contract in outputs:
        write_csv(rows, path, contract)
