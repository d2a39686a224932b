"""The queries that SQL can express, against it, over the smallest tables."""

import os

import duckdb
import pytest

from gleanspark.llm.queries import queries
from gleanspark.llm.sql import oracle_sql

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    told = con.execute(oracle_sql()[name])
    names = [c[0] for c in told.description]
    found = queries()[name](spark, SF_DIR)
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(told.fetchall())
