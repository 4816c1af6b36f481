"""Operators on small cases with results worked out by hand."""

import hashlib
import math
import os
import re
import tracemalloc
import uuid
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spindrel.__main__ import main as command_line
from spindrel.config import IndexSettings, Settings, check_name, frozen
from spindrel.errors import CompositionError, ConfigurationError, ContractError, DataIntegrityError, DuplicateError, EmptyCollectionError, EncodingError, EventError, MetricError, StoreError
from spindrel.functions import scalars as S
from spindrel.operators import artifacts, attribution, changes, collection, duplicates, encoding, evaluation, lexical, retrieval, vector
from spindrel.operators.encoding import HashingEncoder, ModelEncoder, cached_encode, encode_role, provenance
from spindrel.operators.lexical import TfidfIndex
from spindrel.plans import retrieval as plan
from spindrel.sources import catalog
from spindrel.streaming.changes import latest, merge_stream


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw", [None, "nan", "None", " null ", "<NA>", "\t"])
def test_missing_values_are_empty(spark, raw):
    assert one(spark, S.clean_scalar(F.col("a")), a=raw) == ""


def test_flags_and_versions(spark):
    assert one(spark, S.clean_flag(F.col("a")), a=" SÍ ") is True
    assert one(spark, S.clean_flag(F.col("a")), a=None) is False
    with pytest.raises(PySparkException):
        one(spark, S.clean_flag(F.col("a")), a="perhaps")
    assert one(spark, S.clean_version(F.col("a")), a="2.9") == 2
    assert one(spark, S.clean_version(F.col("a")), a="two") is None


@pytest.mark.parametrize("name", ["B000G3T55M", "ñandú €", ""])
def test_uuid5(spark, name):
    assert one(spark, S.uuid5(F.col("a")), a=name) == str(uuid.uuid5(uuid.UUID(S.NAMESPACE), name))


def test_compose_and_prefix(spark):
    full = dict(title="T", brand="B", color="", text="")
    cols = [F.col(c) for c in ("title", "brand", "color", "text")]
    assert one(spark, S.compose("title_brand_color", *cols), **full) == "T. Marca: B"
    assert one(spark, S.compose("raw_text", *cols), **full) == "T"
    e5, other = F.lit("intfloat/e5-base"), F.lit("some/e50")
    assert one(spark, S.apply_prefix(F.col("a"), "query", e5), a=" x ") == "query: x"
    assert one(spark, S.apply_prefix(F.col("a"), "query", e5), a="query: x") == "query: x"
    assert one(spark, S.apply_prefix(F.col("a"), "query", other), a="x") == "x"


def unit(spark, rows):
    return spark.createDataFrame(rows, "product_id long, brand string, vector array<double>")


def asked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, brand string, vector array<double>")


def test_topk_ties_filter_and_cap(spark):
    rows = unit(spark, [(i, "ab"[i % 2], [1.0, 0.0]) for i in (2, 0, 1)])
    q = asked(spark, [(9, "a", [1.0, 0.0])])
    assert [r["product_id"] for r in vector.exact_topk(q, rows, 2).orderBy("rank").collect()] == [0, 1]
    assert [r["product_id"] for r in vector.exact_topk(q, rows, 5, brand=True).orderBy("rank").collect()] == [0, 2]
    assert vector.exact_topk(q.withColumn("brand", F.lit("z")), rows, 5, brand=True).count() == 0
    with pytest.raises(EmptyCollectionError):
        vector.exact_topk(q, rows.limit(0), 1)
    with pytest.raises(StoreError):
        vector.exact_topk(q, rows, True)


def test_topk_in_blocks_and_cells_equal_brute_force(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    x = np.random.default_rng(0).normal(size=(60, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = unit(spark, [(i, "a", v.tolist()) for i, v in enumerate(x)])
    q = asked(spark, [(i, "a", x[i].tolist()) for i in range(7)])
    want = {(i, r + 1): int(p) for i in range(7) for r, p in enumerate(np.lexsort((np.arange(60), -np.round(x @ x[i], 9)))[:5])}
    assert {(r["query_id"], r["rank"]): r["product_id"] for r in vector.exact_topk(q, rows, 5).collect()} == want
    index = vector.CellIndex(rows, f"{tmp_path}/cells", IndexSettings(cells=4, probes=2))
    assert {(r["query_id"], r["rank"]): r["product_id"] for r in index.search(q.drop("brand"), 5, 4).collect()} == want
    both = index.search(q, 5, [1, 4])
    assert {(r["query_id"], r["rank"]): r["product_id"] for r in both.where("probes = 4").collect()} == want
    homes = {r["product_id"]: r["cell"] for r in index.rows.collect()}
    near = {i: int(np.argmax(np.round(index.pivots @ x[i], 9))) for i in range(60)}
    assert homes == near and all(homes[r["product_id"]] == near[r["query_id"]] for r in both.where("probes = 1").collect())
    assert vector.CellIndex(rows, f"{tmp_path}/more").cells == 8 and index.search(q, 5).first()["probes"] == 2
    with pytest.raises(StoreError):
        vector.exact_topk(q.withColumn("vector", F.array(F.lit(1.0))), rows, 5)


def test_running_best_keeps_the_best_of_all_batches():
    rng = np.random.default_rng(3)
    best, scores = vector._Best(4, 3), np.round(rng.random((4, 500)), 2)
    for at in range(0, 500, 7):
        best.add(scores[:, at : at + 7].copy(), np.arange(at, min(500, at + 7)))
    q, _, ids = best.shrink()
    for i in range(4):
        assert ids[q == i].tolist() == np.lexsort((np.arange(500), -scores[i]))[:3].tolist()


def test_vector_violations(spark):
    rows = unit(spark, [(0, "a", [1.0, 0.0]), (1, "a", [2.0, 0.0]), (2, "a", [float("nan"), 0.0]), (3, "a", [1.0]), (4, "a", None)])
    assert vector.violations(rows, 2).first().asDict() == {"n_rows": 5, "n_null": 1, "n_dimension": 1, "n_not_finite": 1, "n_norm": 2}


def test_ndcg_by_hand(spark):
    ranking = spark.createDataFrame([(1, r + 1, p) for r, p in enumerate("ADB")], "query_id int, rank int, product_id string")
    qrels = spark.createDataFrame([(1, "A", 3.0), (1, "B", 2.0), (1, "C", 1.0), (1, "D", 0.0), (2, "A", 2.0)], "query_id int, product_id string, grade double")
    rows = {r["query_id"]: r for r in evaluation.per_query(ranking, qrels, 3).collect()}
    assert rows[1]["ndcg"] == pytest.approx(0.904949, abs=1e-6)
    assert (rows[1]["recall"], rows[1]["mrr"]) == (1.0, 1.0)
    assert (rows[2]["ndcg"], rows[2]["recall"], rows[2]["mrr"]) == (0.0, 0.0, 0.0)
    assert evaluation.macro(ranking, qrels, 3).first()["mean_ndcg"] == pytest.approx(0.904949 / 2, abs=1e-6)
    with pytest.raises(MetricError):
        evaluation.macro(ranking.withColumn("query_id", F.lit(7)), qrels, 3)
    with pytest.raises(MetricError):
        evaluation.per_query(ranking, qrels, 0)


def test_ceiling(spark):
    qrels = spark.createDataFrame([(1, i, 2.0) for i in range(25)] + [(2, i, 1.0) for i in range(50)] + [(2, 99, 2.0)], "query_id int, product_id int, grade double")
    none = spark.createDataFrame([], "query_id int, rank int, product_id int")
    assert {r["query_id"]: r["ceiling"] for r in evaluation.per_query(none, qrels, 10).collect()} == {1: 0.4, 2: 1.0}


def test_fidelity(spark):
    rank = lambda ids: spark.createDataFrame([(1, i + 1, p) for i, p in enumerate(ids)], "query_id int, rank int, product_id string")
    row = evaluation.fidelity(rank("ABD"), rank("ABC")).first()
    assert row["fidelity"] == pytest.approx(2 / 3) and row["n_missed"] == 1
    row = evaluation.fidelity(rank("CBA"), rank("ABC")).first()
    assert row["fidelity"] == 1.0 and row["rank_agreement"] == pytest.approx(1 / 3)
    assert evaluation.fidelity(rank(""), rank("AB")).first()["rank_agreement"] == 0.0
    assert [r["product_id"] for r in evaluation.missed(rank("ABD"), rank("ABC")).collect()] == ["C"]


def test_compliance(spark):
    ranking = spark.createDataFrame([(1, 1, 5, "x"), (1, 2, 6, "y")], "query_id int, rank int, product_id int, brand string")
    queries = spark.createDataFrame([(1, "x"), (2, "x")], "query_id int, brand string")
    rows = {r["query_id"]: r for r in evaluation.compliance(ranking, queries).collect()}
    assert rows[1]["offending"] == ["y"] and not rows[1]["compliant"] and rows[2]["compliant"]
    with pytest.raises(MetricError):
        evaluation.compliance(ranking, queries.withColumn("brand", F.lit("")))


def scores(spark, dup, new):
    rows = [(i, True, i, i, s) for i, s in enumerate(dup)] + [(100 + i, False, None, i, s) for i, s in enumerate(new)]
    return spark.createDataFrame(rows, "listing_id int, is_duplicate boolean, reference_id int, best_id int, score double")


def test_calibration(spark):
    row = duplicates.choose(scores(spark, [0.9484, 0.9532, 0.9662], [0.8521, 0.8712, 0.8898])).first()
    assert row["threshold"] == pytest.approx(0.9191) and row["method"] == "midpoint"
    assert duplicates.choose(scores(spark, [0.95, 0.88], [0.90, 0.85])).first()["method"] == "max_f1"
    with pytest.raises(DuplicateError):
        duplicates.choose(scores(spark, [0.9], []))
    decided = duplicates.decide(scores(spark, [0.9], [0.9]), 0.9)
    assert duplicates.confusion(decided).first()["fp"] == 1
    assert [r["kind"] for r in duplicates.errors(decided).collect()] == ["false_positive"]


def log(spark, rows):
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "sequence long, key string, op string, title string")


def test_change_log(spark):
    base = spark.createDataFrame([("old1", "a"), ("old2", "b")], "key string, title string")
    events = log(spark, [("old1", "UPSERT", "A"), ("new", "UPSERT", "n"), ("old2", "DELETE", None), ("old2", "DELETE", None), ("old2", "UPSERT", "B")])
    kinds = [(r["kind"], r["effective"]) for r in changes.classify(events, base).orderBy("sequence").collect()]
    assert kinds == [("actualizacion", False), ("alta", False), ("baja", True), ("baja", False), ("alta", False)]
    assert {tuple(r) for r in changes.final_state(events, base).collect()} == {("old1", "A"), ("new", "n"), ("old2", "B")}
    assert changes.expected_count(events, base).first()["n_expected"] == 3
    assert tuple(changes.idempotence(events, base).first()) == (0, 0)
    with pytest.raises(EventError):
        changes.require_sequence(events.where("sequence <> 2"))


def test_change_stream(spark, tmp_path):
    base = spark.createDataFrame([("old", "a")], "key string, title string")
    log(spark, [("old", "DELETE", None), ("new", "UPSERT", "n")]).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("sequence long, key string, op string, title string").parquet(f"{tmp_path}/in")
    merge_stream(stream, base, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert [tuple(r) for r in latest(spark, f"{tmp_path}/out").collect()] == [("new", "n")]


def test_collections(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x", "red shoe"), (2, "y", "blue hat")], "product_id long, brand string, text string")
    store = collection.Collections(spark, str(tmp_path), Settings(allow_reset=True))
    report = store.ingest(rows, HashingEncoder()).first()
    assert (report["n_rows"], report["dim_min"], report["dim_max"]) == (2, 64, 64)
    with pytest.raises(StoreError):
        store.ingest(rows, HashingEncoder())
    with pytest.raises(StoreError):
        store.verify(3, 64)
    with pytest.raises(StoreError):
        store.reset()
    store.reset(confirmed=True)
    assert not store.exists()
    with pytest.raises(StoreError):
        store.ingest(rows, HashingEncoder(32))
    with pytest.raises(EncodingError):
        store.ingest(rows.withColumn("text", F.lit(" ")), HashingEncoder())


def test_search_by_text(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x", "red shoe"), (2, "y", "blue hat"), (3, "x", "blue shoe")], "product_id long, brand string, text string")
    store = collection.Collections(spark, str(tmp_path), Settings())
    report = store.ingest(rows, HashingEncoder()).first()
    assert (report["model"], report["batches"]) == ("hashing-64", 1)
    found = retrieval.live_retriever(store, HashingEncoder(), "hashing-64", 3)
    assert [r["product_id"] for r in found.search("blue hat").collect()][0] == 2
    assert [r["product_id"] for r in found.search("blue hat", brand="x").collect()] == [3, 1] and found.search("hat", brand="z").count() == 0
    assert found.search("red", 1).first().asDict().keys() >= {"rank", "product_id", "score", "brand", "score_kind", "higher_is_better"}
    for bad in (lambda: found.search("  "), lambda: found.search("x", 0)):
        with pytest.raises((EncodingError, StoreError)):
            bad()
    for encoder, model in ((HashingEncoder(32), "hashing-64"), (HashingEncoder(), "another")):
        with pytest.raises(StoreError):
            retrieval.Retriever(store.read(), encoder, model)
    with pytest.raises(StoreError):
        retrieval.live_retriever(store, HashingEncoder(), "hashing-64", 4)


def test_roles_and_provenance(spark):
    rows = spark.createDataFrame([(1, " red shoe ")], "id long, text string")
    plain, e5 = (encode_role(HashingEncoder(), rows, "id", "text", "query", m).first()["vector"] for m in ("other", "my/e5-small"))
    prefixed = HashingEncoder().encode(rows.withColumn("text", F.lit("query: red shoe")), "id", "text").first()["vector"]
    assert e5 == prefixed != plain
    row = provenance(rows, "my/e5-small", "passage", 64).first()
    assert (row["role"], row["prefix"], row["dimension"]) == ("passage", "passage: ", 64)


def test_event_report_and_search_probes(spark):
    base = spark.createDataFrame([(1, "old one"), (2, "old two")], "key long, title string")
    events = spark.createDataFrame([(1, 1, "UPSERT", "new one"), (2, 9, "UPSERT", "nine"), (3, 2, "DELETE", None), (4, 2, "DELETE", None)], "sequence long, key long, op string, title string")
    state, row = changes.apply_events(events, base, twice=True)
    assert state.count() == 2 and row.first().asDict()["n_visible"] == 3 and row.first()["idempotent"]
    seen = {r["kind"]: (r["sequence"], r["found"], r["visible"]) for r in changes.search_probes(events, base, HashingEncoder(), 1).collect()}
    assert seen == {"actualizacion": (1, True, True), "alta": (2, True, True), "baja": (3, False, True)}
    with pytest.raises(EventError):
        changes.apply_events(events.where("sequence > 1"), base)
    assert changes.search_probes(events.limit(0), base, HashingEncoder()).count() == 0


def test_sweep_equals_counting_at_every_threshold(spark):
    rng = np.random.default_rng(5)
    rows = [(i, bool(rng.integers(2)), int(rng.integers(3)), int(rng.integers(3)) if rng.random() < 0.9 else None, round(float(rng.random()), 2)) for i in range(80)]
    frame = spark.createDataFrame(rows, "listing_id long, is_duplicate boolean, reference_id long, best_id long, score double")
    low, high = min(r[4] for r in rows), max(r[4] for r in rows)
    for r in duplicates.sweep(frame).collect():
        t = round(low + (high - low) * r["step"] / 200, 9)
        said = [x[3] is not None and x[4] >= t for x in rows]
        assert (r["tp"], r["fp"]) == (sum(s and x[1] for s, x in zip(said, rows, strict=True)), sum(s and not x[1] for s, x in zip(said, rows, strict=True)))
        assert (r["fn"], r["wrong_candidate"]) == (sum(x[1] and not s for s, x in zip(said, rows, strict=True)), sum(x[1] and s and x[3] != x[2] for s, x in zip(said, rows, strict=True)))


def test_texts_digest(spark):
    rows = spark.createDataFrame([(2, "a", "y"), (1, "a", "x"), (1, "b", None), (3, "a", "é")], "pos int, g string, t string")
    one = lambda *texts: hashlib.sha256("".join(x + "\0" for x in texts).encode()).hexdigest()
    assert {tuple(r) for r in S.texts_digest(rows, "pos", "t", ["g"]).collect()} == {("a", one("x", "y", "é"), 3), ("b", one(""), 1)}
    assert S.texts_digest(rows.where("g = 'a'"), "pos", "t").first()["digest"] == one("x", "y", "é")


def test_encoders(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "")], "id long, text string")
    ones = ModelEncoder("ones", 3, lambda: lambda texts: np.ones((len(texts), 3)), 1)
    assert [sum(x * x for x in r["vector"]) for r in ones.encode(rows, "id", "text").collect()] == [pytest.approx(1.0)] * 2
    first, cache = cached_encode(ones, rows, "id", "text", None, "ones", "query")
    again, fresh = cached_encode(ones, rows, "id", "text", cache.cache(), "ones", "query")
    assert again.count() == 2 and fresh.count() == 0 and first.count() == 2
    assert HashingEncoder().encode(rows, "id", "text").where("id = 2").first()["vector"] == [0.0] * 64


def test_tfidf_fills_with_zero_scores(spark):
    rows = spark.createDataFrame([(1, "a", "red shoe"), (2, "a", "blue hat"), (3, "b", "green hat")], "product_id long, brand string, text string")
    q = spark.createDataFrame([(7, "a", "blue hat")], "query_id long, brand string, text string")
    found = TfidfIndex(rows).search(q, 5).orderBy("rank").collect()
    assert [r["product_id"] for r in found] == [2, 3, 1] and found[0]["score"] == pytest.approx(1.0) and found[2]["score"] == 0.0
    assert [r["product_id"] for r in TfidfIndex(rows).search(q, 5, brand=True).orderBy("rank").collect()] == [2, 1]


def test_attribution(spark):
    rank = lambda ids: spark.createDataFrame([(1, i + 1, p) for i, p in enumerate(ids)], "query_id int, rank int, product_id string")
    qrels = spark.createDataFrame([(1, "A", 3.0), (1, "Z", 0.0)], "query_id int, product_id string, grade double")
    layer = lambda e, x: attribution.attribute(rank(e), rank(x), qrels).first()["layer"]
    assert layer("Z", "A") == "indice"
    assert layer("Z", "Z") == "representacion"
    assert layer("A", "A") == "representacion"


def test_sources(spark, tmp_path):
    (tmp_path / "c.csv").write_text("record_id,product_id,title,brand,color,locale,text,catalog_version,active\n" + f"{uuid.uuid5(uuid.UUID(S.NAMESPACE), 'P1')},P1,Shoe,nan,,,text,2.0,true\n")
    row = catalog.load_catalog(spark, f"{tmp_path}/c.csv", 1).first()
    assert (row["brand"], row["locale"], row["catalog_version"], row["active"]) == ("", "es", 2, True)
    with pytest.raises(DataIntegrityError):
        catalog.load_catalog(spark, f"{tmp_path}/c.csv", 2)
    with pytest.raises(DataIntegrityError):
        catalog.read_text_csv(spark, f"{tmp_path}/none.csv", [])
    with pytest.raises(DataIntegrityError):
        catalog.read_text_csv(spark, f"{tmp_path}/c.csv", ["absent"])
    (tmp_path / "f.csv").write_text("workload_id,query_text,filter_field,filter_operator,filter_value,expected_property\nW,q,color,equals,red,x\n")
    with pytest.raises(DataIntegrityError):
        catalog.load_filtered_queries(spark, f"{tmp_path}/f.csv")
    sums = catalog.checksums(spark, str(tmp_path))
    expected = spark.createDataFrame([("c.csv", None), ("gone.csv", "0")], "file string, sha256 string")
    assert {r["file"]: r["ok"] for r in catalog.integrity(expected, sums).collect()} == {"c.csv": True, "gone.csv": False}


def test_query_judgment_listing_and_event_sources(spark, tmp_path):
    write = lambda name, *lines: (tmp_path / name).write_text("\n".join(lines) + "\n") and f"{tmp_path}/{name}"
    dev = catalog.load_development_queries(spark, write("d.csv", "workload_id,query_id,query_text,query_type", "W1,7, shoe ,direct"))
    assert tuple(dev.first()) == ("W1", 7, "shoe", "direct")
    assert tuple(catalog.load_blind_queries(spark, write("b.csv", "evaluation_id,query_text,query_type", "EVAL-1-direct,hat,direct")).first()) == ("EVAL-1-direct", "hat", "direct")
    filtered = catalog.load_filtered_queries(spark, write("f.csv", "workload_id,query_text,filter_field,filter_operator,filter_value,expected_property", "W,q,brand,equals,NIKE,x"))
    assert filtered.first()["brand"] == "NIKE"
    head = "query_id,product_id,esci_label,relevance"
    assert tuple(catalog.load_judgments(spark, write("j.csv", head, "7,P1,e,3.0"), dev).first()) == ("W1", "P1", 3.0)
    for line in ("8,P1,E,3.0", "7,P1,E,2.0", "7,P1,Q,3.0"):  # no such query, a wrong grade, no such label
        with pytest.raises(DataIntegrityError):
            catalog.load_judgments(spark, write("k.csv", head, line), dev)
    plain = catalog.load_listings(spark, write("l.csv", "incoming_id,title,brand,color,text", "I1,Shoe,nan,,"))
    assert plain.columns == ["incoming_id", "title", "brand", "color", "text"] and plain.first()["brand"] == ""
    labelled = catalog.load_listings(spark, write("m.csv", "incoming_id,title,brand,color,text,is_duplicate,reference_product_id", "I1,Shoe,,,,true,P1"))
    assert tuple(labelled.first()[-2:]) == (True, "P1")
    head = "sequence,event_id,operation," + ",".join(catalog.CATALOG)
    events = catalog.load_events(spark, write("e.csv", head, "2,E2,delete,K1,,,,,,,,", "1,E1,upsert,K1,P1,Shoe,,,es,text,1,true"))
    assert [(r["sequence"], r["op"], r["record"] is None) for r in events.collect()] == [(1, "UPSERT", False), (2, "DELETE", True)]
    with pytest.raises(EventError):
        catalog.load_events(spark, write("g.csv", head, "2,E2,delete,K1,,,,,,,,"))
    with pytest.raises(DataIntegrityError):
        catalog.load_events(spark, write("h.csv", head, "1,E2,move,K1,,,,,,,,"))
    manifest = write("manifest.json", '{"snapshot_id": "s1", "source": {"name": "x"}, "counts": {"rows": 5, "queries": 2}, "files": {"c.csv": "ab"}}')
    assert tuple(catalog.load_manifest(spark, manifest).first()) == ("c.csv", "ab")
    assert {(r["name"], r["n"]) for r in catalog.manifest_counts(spark, manifest).collect()} == {("rows", 5), ("queries", 2)} and catalog.manifest_counts(spark, manifest).first()["snapshot_id"] == "s1"
    with pytest.raises(ContractError):
        catalog.require_records(catalog.coerce_catalog(catalog.read_text_csv(spark, write("r.csv", ",".join(catalog.CATALOG), "x,,,,,,,1,true"), catalog.CATALOG)))


def test_missed_duplicates_and_frozen_settings(spark, tmp_path):
    rows = spark.createDataFrame([(1, True, False, 0.9), (2, True, False, 0.5), (3, True, True, 0.95), (4, False, False, 0.9)], "listing_id int, is_duplicate boolean, predicted boolean, score double")
    assert {(r["listing_id"], r["in_gap"]) for r in attribution.missed_duplicates(rows, 0.85, 0.94).collect()} == {(1, True), (2, False)}
    (tmp_path / "c.json").write_text('{"threshold": 0.9}')
    assert frozen(f"{tmp_path}/c.json") == {"threshold": 0.9}
    (tmp_path / "d.json").write_text("[1]")
    for bad in ("d.json", "none.json"):
        with pytest.raises(ConfigurationError):
            frozen(f"{tmp_path}/{bad}")
    with pytest.raises(CompositionError):
        S.require_composed(rows.withColumn("t", F.lit("")), "t")


def test_experiments_are_written_if_they_keep_the_contract(spark, tmp_path):
    ranked = spark.createDataFrame([(1, 1, 5), (1, 2, 6)], "query_id long, rank int, product_id long")
    counts = spark.createDataFrame([(1, 3.0, 1), (1, 0.0, 4)], "query_id long, grade double, n long")
    grade = lambda rows: rows.withColumn("grade", F.when(F.col("product_id") == 5, 3.0).otherwise(0.0))
    row = attribution.compare([attribution.Experiment("E1", {"retriever": "x"}, lambda: ranked)], grade, counts)
    assert row.first()["retrieved"] == {"1": ["5", "6"]} and row.first()["mean_ndcg"] == pytest.approx(1.0)
    catalog.write_experiments(row, f"{tmp_path}/e")
    assert spark.read.json(f"{tmp_path}/e").first()["experiment"] == "E1"
    with pytest.raises(artifacts.ArtifactError):
        catalog.write_experiments(row.withColumn("configuration", F.lit("{}")), f"{tmp_path}/f")
    with pytest.raises(ConfigurationError):
        attribution.Experiment("run", {}, lambda: ranked)


def test_delivery(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("needs the test data")
    report = {r["artifact"]: r for r in plan.deliver(spark, folder, str(tmp_path)).collect()}
    assert report["search"]["n_rows"] == 10 * report["search"]["n_groups"] and all(r["n_broken"] == 0 for r in report.values())
    metrics = spark.read.json(f"{tmp_path}/metrics").first()
    assert 0 < metrics["mean_ndcg"] <= 1 and metrics["p95"] >= metrics["p50"]


def test_artifacts(spark, tmp_path):
    ranked = spark.createDataFrame([(1, 3, 7, 0.5), (1, 9, 8, 0.25)], "query_id int, rank int, product_id int, score double")
    rows = artifacts.search_rows(ranked)
    catalog.write_csv(rows, f"{tmp_path}/s", artifacts.SEARCH_CONTRACT)
    assert [r["rank"] for r in catalog.read_search_results(spark, f"{tmp_path}/s").orderBy("rank").collect()] == [1, 2]
    with pytest.raises(artifacts.ArtifactError):
        catalog.write_csv(rows.withColumn("score", F.lit(None).cast("double")), f"{tmp_path}/t", artifacts.SEARCH_CONTRACT)
    assert not (tmp_path / "t").exists()
    with pytest.raises(artifacts.ArtifactError):
        artifacts.search_rows(ranked.union(ranked))
    bad = spark.createDataFrame([("1", False, "9", 0.1)], "incoming_id string, predicted_duplicate boolean, matched_product_id string, score double")
    assert artifacts.violations(bad, artifacts.DUPLICATE_CONTRACT).where("n > 0").first()["rule"] == "match without decision"


def test_settings(monkeypatch):
    with pytest.raises(ConfigurationError):
        IndexSettings(cells=16, probes=20)
    with pytest.raises(ConfigurationError):
        check_name("other", "spindrel")
    with pytest.raises(ConfigurationError):
        _ = Settings(model="unknown").dimension
    assert Settings().dimension == 64
    monkeypatch.setenv("SPINDREL_BATCH_SIZE", "many")
    from spindrel.config import from_environment

    with pytest.raises(ConfigurationError):
        from_environment()


def test_latency_interpolates(spark):
    row = evaluation.latency(spark.createDataFrame([(float(i),) for i in range(10)], "ms double"), "ms").first()
    assert math.isclose(row["p95"], np.percentile(range(10), 95))


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    folder, store = str(tmp_path / "tables"), str(tmp_path / "store")
    rows = spark.createDataFrame([(1, "red shoe", "en"), (2, "blue hat", "fr"), (3, "blue shoe", "en")], "doc_id long, text string, lang string")
    rows.write.parquet(f"{folder}/documents.parquet")
    for bad in (["verify"], ["predict", "--folder", folder], ["run", "no_such", "--folder", folder]):
        with pytest.raises(SystemExit):
            command_line(bad)
    assert command_line(["list"]) == 0 and "exact_topk" in capsys.readouterr().out
    assert command_line(["ingest", "--folder", folder, "--store", store]) == 0
    assert command_line(["verify", "--store", store, "--expected", "3"]) == 0
    with pytest.raises(StoreError):
        command_line(["verify", "--store", store, "--expected", "4"])
    capsys.readouterr()
    assert command_line(["search", "blue hat", "--store", store, "--top", "1"]) == 0
    assert re.search(r"\|\s*2\|\s*1\|", capsys.readouterr().out)
    with pytest.raises(StoreError):
        command_line(["reset", "--store", store, "--yes"])
    monkeypatch.setenv("SPINDREL_ALLOW_RESET", "true")
    with pytest.raises(StoreError):
        command_line(["reset", "--store", store])
    assert command_line(["reset", "--store", store, "--yes"]) == 0
    assert not collection.Collections(spark, store, Settings()).exists()
    assert command_line(["version"]) == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test data")
def test_command_line_on_the_test_data(spark, tmp_path, capsys):
    folder = ["--folder", "/root/testdata/sf0.001"]
    assert command_line(["evaluate", *folder]) == 0
    assert {"mean_ndcg", "fidelity", "n_compliant"} <= set(re.findall(r"\w+", capsys.readouterr().out))
    assert command_line(["calibrate", *folder]) == 0
    assert "threshold" in capsys.readouterr().out
    assert command_line(["predict", *folder, "--out", str(tmp_path / "found")]) == 0
    found = catalog.read_duplicate_results(spark, str(tmp_path / "found"))
    assert found.count() == spark.read.parquet(f"{folder[1]}/documents.parquet").where("doc_id % 100 = 0").count()


def peak_mb(run):
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("kind", ["all", "ties", "brand", "cells"])
def test_a_task_holds_tiles_of_scores_only(kind):
    rng, n = np.random.default_rng(1), 10_000
    ids, matrix = np.arange(4096), rng.normal(size=(4096, 8)) * (kind != "ties")
    vectors, groups = rng.normal(size=(n, 8)), rng.integers(0, 4, n)
    brands = [int(i % 4) for i in ids] if kind == "brand" else None
    cells = np.repeat(np.array([[True, False, False, True], [True, True, True, True]]), 4096, axis=0) if kind == "cells" else None
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(groups), pa.array(list(vectors))], names=["product_id", "group", "vector"])
    shared = SimpleNamespace(value=(np.tile(ids, 2) if kind == "cells" else ids, brands, matrix, cells))
    out, peak = peak_mb(lambda: list(vector._local_top(shared, 3, True)(iter([batch]))))
    assert peak < 150
    found = pa.Table.from_batches(out).to_pandas().sort_values(["place", "score", "product_id"], ascending=[True, False, True])
    for place in (0, 5, 4095, 4096, 8191)[: 5 if kind == "cells" else 3]:
        scores = np.round(vectors @ matrix[place % 4096], 9) + 0.0
        counts = (np.arange(n) != place % 4096) & (groups == place % 4 if kind == "brand" else cells[place][groups] if kind == "cells" else True)
        want = [i for i in np.lexsort((np.arange(n), -scores)) if counts[i]][:3]
        assert found[found["place"] == place]["product_id"].tolist()[:3] == want


def test_more_hits_than_a_task_holds_go_on(monkeypatch):
    monkeypatch.setattr(vector, "HELD", 50)
    monkeypatch.setattr(vector, "TILE", 20)
    x = np.arange(300.0)[:, None]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(300)), pa.nulls(300, pa.string()), pa.array(list(x))], names=["product_id", "brand", "vector"])
    out = list(vector._local_top(SimpleNamespace(value=(np.arange(2), None, np.ones((2, 1)), None)), 1000, True)(iter([batch])))
    assert len(out) > 5 and sorted(zip(*[pa.Table.from_batches(out)[c].to_pylist() for c in ("query_id", "product_id")], strict=True)) == [(q, p) for q in range(2) for p in range(300) if p != q]


def test_cells_are_found_by_slices(monkeypatch):
    pivots, vectors = np.random.default_rng(2).normal(size=(2, 400, 3))
    want = np.argsort(-np.round(vectors @ pivots.T, 9), axis=1, kind="stable")[:, :5]
    found, peak = peak_mb(lambda: vector._nearest(np.tile(pivots, (10, 1)), np.tile(vectors, (25, 1)), 1))
    assert peak < 50 and (found[:400, 0] == want[:, 0]).all()
    monkeypatch.setattr(vector, "TILE", 1000)
    assert (vector._nearest(pivots, vectors, 5) == want).all()


def test_texts_are_encoded_by_spans_of_tokens(monkeypatch):
    monkeypatch.setattr(encoding, "TOKENS", 3)
    lists = [["a"], [], ["b", "b"], ["c"] * 7, [], ["d", "e"], ["f"], ["g"]]
    parts = list(encoding.in_spans(pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(lists)], names=["k", "t"]), 1))
    assert [p.column(1).to_pylist() for p in parts] == [lists[:3], lists[3:4], lists[4:7], lists[7:]]


def test_summaries_have_plain_decimals(spark):
    rows = spark.createDataFrame([(1, 0.071, 0.0003, 1.0, 0.00015, 3082), (2, 0.0, 0.0009, 0.3333, 0.0012, 9)], "query_id long, ndcg double, recall double, mrr double, ceiling double, n_relevant long")
    want = duckdb.connect().execute("""select '{"ndcg":' || round(0.071::double, 4) || ',"recall":' || round(0.0003::double, 4) || ',"mrr":1.0,"ceiling":' || round(0.00015::double, 4) || ',"n_relevant":3082}'""").fetchone()[0]
    assert {r["query_id"]: r["summary"] for r in evaluation.summary(rows).collect()} == {1: want, 2: '{"ndcg":0.0,"recall":0.0009,"mrr":0.3333,"ceiling":0.0012,"n_relevant":9}'}


def by_hand(rows, asked, k, brand):
    """TF-IDF rankings of (query, brand, text) among rows (product, brand, text)."""
    terms = lambda text: Counter((w := re.findall(r"\w{2,}", text.lower())) + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])

    def weights(text):
        x = {t: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, n in terms(text).items() if t in df}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {t: v / norm for t, v in x.items()}

    df = Counter(t for _, _, text in rows for t in set(terms(text)))
    known, out = [(p, b, weights(text)) for p, b, text in rows], set()
    for q, b, text in asked:
        w = weights(text)
        scored = sorted((-round(sum(v * x.get(t, 0) for t, v in w.items()), 9), p) for p, c, x in known if not brand or c == b)[:k]
        out |= {(q, n + 1, p, round(-s, 6)) for n, (s, p) in enumerate(scored)}
    return out


def few_texts(n):
    words = ["red shoe", "blue hat", "green hat red hat", "", "one"]
    return [(i, "ab"[i % 3 == 0], words[i * 7 % 5]) for i in range(n)]


@pytest.mark.parametrize("brand", [False, True])
def test_tfidf_in_blocks_and_tiles_equals_brute_force(spark, monkeypatch, brand):
    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    rows = few_texts(60)
    asked = [(i, "abz"[i % 3], text) for i, text in enumerate(["red hat", "shoe", "unknown words", "", "blue hat one", "red red shoe", "hat"])]
    frame = spark.createDataFrame(rows, "product_id long, brand string, text string")
    q = spark.createDataFrame(asked, "query_id long, brand string, text string")
    found = TfidfIndex(frame).search(q, 4, brand)
    assert {(r["query_id"], r["rank"], r["product_id"], round(r["score"], 6)) for r in found.collect()} == by_hand(rows, asked, 4, brand)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()  # pairs of rows and queries are never shuffled


def test_tfidf_weighs_no_more_of_equal_texts_than_a_ranking_has(spark, monkeypatch):
    kept, real = [], lexical.staged
    monkeypatch.setattr(lexical, "staged", lambda df, name, *a: kept.append((name, out := real(df, name, *a))) or out)
    frame = spark.createDataFrame(few_texts(1000), "product_id long, brand string, text string")
    TfidfIndex(frame).search(frame.where("product_id < 5").withColumnRenamed("product_id", "query_id"), 4).collect()
    assert dict(kept)["weighed-texts"].count() == 5 * 4


def test_common_terms_are_counted_in_tiles():
    n, rows = 4096, 256
    keys, weights = np.arange(3 * n), np.arange(3.0 * n)
    terms = pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * rows + 1, 3, dtype=np.int32)), pa.array(np.tile([0, 1, 2], rows).astype(np.int32)))
    w = pa.ListArray.from_arrays(terms.offsets, pa.array(np.tile([1.0, 2.0, 4.0], rows)))
    scores, peak = peak_mb(lambda: lexical._scores(keys, weights, n, np.arange(n), terms, w))
    places = np.arange(n)
    assert peak < 150 and (scores == (places + 2 * (n + places) + 4 * (2 * n + places))[:, None]).all()


def test_experiments_hold_queries_against_the_least_ids_of_equal_texts(spark, monkeypatch, tmp_path):
    parts = [(i, f"name {'xyz'[i % 3]}", f"B{i % 2}", "T") for i in range(600)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    sizes, real = [], vector.exact_topk
    monkeypatch.setattr(vector, "exact_topk", lambda q, rows, *a, **b: sizes.append(rows.count()) or real(q, rows, *a, **b))
    every = spark.read.parquet(f"{tmp_path}/part.parquet").selectExpr("p_partkey AS product_id", "p_name AS text")
    vectors = HashingEncoder(64).encode(every, "product_id", "text")
    want = real(vectors.where("product_id % 100 = 0").withColumnRenamed("product_id", "query_id"), vectors, 10, skip_self=True)
    found = plan._experiments(spark, str(tmp_path))[1].search()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and sizes == [3 * 11]
