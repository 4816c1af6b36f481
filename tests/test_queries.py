"""Every registered query of the library against its SQL in DuckDB, on the smallest data set."""

import math
import os

import duckdb
import pytest

from spindrel.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as from '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


def test_same_keys():
    assert set(registry.QUERIES) == set(registry.SQL)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test data")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    frame = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(v) for v in row) for row in frame.select(columns).collect()), key=repr)
    want = duck.execute(registry.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in want.fetchall()), key=repr)
