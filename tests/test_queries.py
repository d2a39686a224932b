"""The engine's own queries over the smallest tables: each against its SQL, the others for stable rows and columns."""

import os

import duckdb
import pytest

from gleanspark.plans import oracles, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = oracles.oracle_sql()
QUERIES = queries.queries()


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF_DIR}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    found = QUERIES[name](spark, SF_DIR)
    told = duck.execute(SQL[name])
    names = [c[0] for c in told.description]
    assert sorted(names) == sorted(found.columns)
    order = sorted(names)
    at = [names.index(c) for c in order]
    ours = sorted(repr([_plain(r[c]) for c in order]) for r in found.collect())
    theirs = sorted(repr([_plain(r[i]) for i in at]) for r in told.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    found = QUERIES[name](spark, SF_DIR)
    assert len(set(found.columns)) == len(found.columns)
    found.collect()


def test_database_sets_by_hand(spark):
    """A host, a user and a password on three lines; a second password stands too far away."""
    rows = QUERIES["database_sets"](spark, SF_DIR).where("page_id >= 1000000000").collect()
    assert [tuple(r) for r in rows] == [(1000000004, "h.js", "database_credentials", 24, 47, True)]


def test_steps_up_are_resolved_however_many(spark):
    from gleanspark.operators.pages import resolved

    rows = [("https://a.example/b/c/d.html", "../" * 12 + "e.js?x=/../y"), ("https://a.example/" + "p/" * 20 + "q", "../" * 15 + "r.js"), ("https://a.example/b/", "./c/./d/.."), ("https://a.example/b/c", "//h.example/../z"), ("https://a.example/b/c", "mailto:x")]
    got = [r["url"] for r in resolved(spark.createDataFrame(rows, "base string, href string").coalesce(1)).collect()]
    assert got == ["https://a.example/e.js?x=/../y", "https://a.example/" + "p/" * 5 + "r.js", "https://a.example/b/c", "https://h.example/z", None]
