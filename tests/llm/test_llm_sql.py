"""Queries that SQL can express equal their DuckDB SQL on the smallest tables."""

import os

import pytest

from cases import SF
from compare import digest
from tarmac.llm.queries import oracle_sql, queries

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = queries()[name](spark, SF)
    rel = con.sql(oracle_sql()[name])
    assert df.columns == rel.columns
    assert digest(df.columns, [tuple(r) for r in df.collect()]) == digest(rel.columns, rel.fetchall())


def test_registered_names():
    assert [n.split("_")[0] for n in queries()] == [*(f"op{i}" for i in range(1, 14)), "pipeline"]
