"""Spaces of any width fall at the ends of titles, comments, languages and addresses, as the SQL's trim has it; no other white space does."""

import duckdb
import pytest

from gleanspark.functions.columns import SPACES
from gleanspark.plans import oracles, queries

WIDE = [" ", "\u00a0", "\u3000", "\u2003 \u202f", "\t", "\n", "\u200b", "\u2028"]
PAGES = [
    (i, f"https://c.example/{i}{w}", f'<!DOCTYPE html><html lang="{w}"><head><meta charset="utf-8"><title>{w} Title {i} {w}</title></head><body><!--{w}x{w} --><!-- {w} --></body></html>')
    for i, w in enumerate(WIDE)
]
NAMES = ["html_title_lang", "html_comments", "page_findings", "sarif_rows", "finding_statistics", "url_normalize"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("wide"))
    spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    return path


@pytest.mark.parametrize("name", NAMES)
def test_wide_spaces_equal_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    told = con.execute(oracles.oracle_sql()[name])
    names = [c[0] for c in told.description]
    found = queries.QUERIES[name](spark, folder).select(*names)
    assert sorted(repr(tuple(r)) for r in found.collect()) == sorted(repr(r) for r in told.fetchall())


def test_what_the_sql_trims():
    con = duckdb.connect()
    told = con.execute("SELECT string_agg(chr(c::INT), '' ORDER BY c) FROM range(1, 1114112) AS r(c) WHERE (c < 55296 OR c > 57343) AND trim('x' || chr(c::INT)) = 'x'").fetchone()[0]
    assert told == SPACES
