"""Names of characters without their semicolon: titles that are cut within one stay as they are, as the SQL says."""

import duckdb
import pytest

from gleanspark.plans import oracles, queries
from gleanspark.sources.html import parse_page

PAGES = [
    (1, "https://a.example/", '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Cut &amp;&amp</title></head><body><!-- a&amp --></body></html>'),
    (2, "https://a.example/2", '<!DOCTYPE html><html lang="de"><head><meta charset="utf-8"><title>x &lt;b&gt &ampx; &amp;lt;</title></head></html>'),
    (3, "https://a.example/3", '<!DOCTYPE html><html lang="de"><head><meta charset="utf-8"><title>plain & simple &</title></head></html>'),
]


def _rows(spark, folder, name, pages=PAGES):
    path = str(folder)
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{path}/pages.parquet/*.parquet')")
    told = con.execute(oracles.oracle_sql()[name])
    names = [c[0] for c in told.description]
    found = queries.QUERIES[name](spark, path).select(*names)
    return sorted(repr(tuple(r)) for r in found.collect()), sorted(repr(r) for r in told.fetchall())


@pytest.mark.parametrize("name", ["html_title_lang", "page_findings", "sarif_rows"])
def test_cut_titles_equal_sql(spark, tmp_path, name):
    ours, theirs = _rows(spark, tmp_path, name)
    assert ours == theirs


def test_scripts_addresses_and_numbers():
    page = parse_page('<script>a&&b&lt</script><a href="/x?a=1&copy=2&amp;b=&#51;">y</a><img src="&amp"><title>&#65&eacute;&eacute</title>')
    assert page["scripts"][0]["content"] == "a&&b&lt"
    assert page["anchors"] == ["/x?a=1&copy=2&b=3"] and page["media"] == ["&amp"]
    assert page["title"] == "Aé&eacute"


WHITE = [
    (1, "https://b.example/", '<!DOCTYPE html><html lang=" fr "><head><meta charset=" utf-8"><title> Cut at a line.\n</title></head><body><!-- x --></body></html>'),
    (2, "https://b.example/2", '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>\ttab\u00a0\u2003</title></head><body><!--\tx\n--></body></html>'),
    (3, "https://b.example/3", '<!DOCTYPE html><html lang="  "><head><title>\n</title></head></html>'),
]


@pytest.mark.parametrize("name", ["html_title_lang", "page_findings", "sarif_rows"])
def test_white_ends_equal_sql(spark, tmp_path, name):
    ours, theirs = _rows(spark, tmp_path, name, WHITE)
    assert ours == theirs
