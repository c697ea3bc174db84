"""The corpus queries that SQL can express, against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from verity.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    got = sorted(tuple(r[c] for c in columns) for r in ours.collect())
    assert got == sorted(tuple(r[theirs.columns.index(c)] for c in columns) for r in theirs.fetchall())


def test_names():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)
