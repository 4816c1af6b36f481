"""The stages, each against brute force on what its predecessor kept, and the queries with SQL."""

import os

import duckdb
import pytest

import corpus_pipeline
from spindrel.llm import queries, quality

from .test_llm import longest_match, near_groups, rows_of

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test data")


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    columns = docs.columns
    good = stages[0](spark, docs, FOLDER).cache()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    kept = {r["doc_id"] for r in quality.scored(docs, quality.train(docs, labels)).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in good.collect()} == kept and good.columns == columns
    unique = stages[1](spark, good, FOLDER).cache()
    best = {}
    for r in good.collect():
        key = "".join(r["text"].split(" ")).translate({c: None for c in range(9, 14)})
        best[key] = max(best.get(key, (-1, 0)), (len(r["text"]), -r["doc_id"]))
    assert {r["doc_id"] for r in unique.collect()} == {-d for _, d in best.values()} and unique.columns == columns
    rows = sorted((r["doc_id"], r["text"]) for r in unique.collect())
    apart = stages[2](spark, unique, FOLDER).cache()
    assert {r["doc_id"] for r in apart.collect()} == {rows[i][0] for i, _, root in near_groups([t for _, t in rows]) if i == root} and apart.columns == columns
    rows = sorted((r["doc_id"], r["text"]) for r in apart.collect())
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = stages[3](spark, apart, FOLDER).cache()
    assert {r["doc_id"] for r in clean.collect()} == {d for d, t in rows if longest_match(t, [x for _, x in items])[0] < 4} and clean.columns == columns
    assert rows_of(corpus_pipeline.run(spark, FOLDER), "doc_id") == rows_of(clean, "doc_id")
    assert corpus_pipeline.run(spark, FOLDER).where("not round_trip").isEmpty()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {table} as from '{FOLDER}/{table}.parquet'")
    frame = queries.QUERIES[name](spark, FOLDER)
    want = con.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(frame.columns)
    assert rows_of(frame, *names) == sorted(want.fetchall(), key=repr)


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty texts, repeated rows and ids, and columns whose names the operators use."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, set_key string, _sha string, hash int, score string, row int"
    words = " ".join(f"word{i}" for i in range(300))
    rows = [(None, None, None, None, None), (1, None, None, "s", 0), (1, "", "en", None, None), (2, words, "en", "s", 9), (2, words, "en", "s", 9), (3, words + " more", "en", "s", 9), (3, "other text", None, "s", 9), (None, words, "en", "s", 9), (4, "x " * 200_000, "en", "s", 9)]
    frame = spark.createDataFrame([(*r, "a", "b", 1, "c", 2) for r in rows], schema)
    for docs in (frame, frame.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, FOLDER)
            n = out.count()
            assert n <= docs.count(), name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
    ids = lambda stage: sorted((r["doc_id"] or 0) for r in corpus_pipeline.STAGES[stage][1](spark, frame, FOLDER).collect())
    # exact: one row of each text, and rows without an id; near copies: rows without an id stay, the later ids go
    assert ids(1) == [0, 0, 1, 2, 3, 3, 4]
    assert ids(2) == [0, 0, 1, 1, 2, 2, 4]
    assert ids(3) == sorted((r[0] or 0) for r in rows)
