"""Registered queries against the SQL that says the same, and the ones without SQL for shape and order."""

import duckdb
import pytest

import __spark_entry__ as entry
from demosift.plans import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for t in TABLES:
        found.sql(f"create view {t} as from '{DATA}/{t}.parquet'")
    return found


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_says_what_its_sql_says(spark, con, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    rel = con.sql(queries.ORACLES[name])
    at = [rel.columns.index(c) for c in columns]
    assert sorted(rel.columns) == columns
    assert got == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["dense_kmeans_diversity"])
def test_rankings_are_complete(spark, name):
    rows = queries.QUERIES[name](spark, DATA).collect()
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append(r)
    for found in by.values():
        assert sorted(r["rank"] for r in found) == list(range(1, 9))
        assert len({r.row_id for r in found}) == 8


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "row_id", "rank", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
