"""References of Link headers, by hand."""

from gleanspark.operators.pages import link_header_references


def test_references_by_hand(spark):
    rows = [
        (1, "https://a.example/b/c", '</app.js>; rel=preload; as=script, <style.css>; rel="stylesheet",<//cdn.example/f.woff2>; crossorigin'),
        (2, "https://a.example/", "no brackets, <>; rel=x, <unclosed; rel=y"),
        (3, "https://a.example/", None),
        (4, "https://a.example/x?q=1", "<mailto:a@b.example>; rel=author, <https://c.example/api>; rel=\"describedby\""),
    ]
    got = sorted((r["page_id"], r["href"], r["url"]) for r in link_header_references(spark.createDataFrame(rows, "page_id long, base string, header string")).collect())
    assert got == [
        (1, "//cdn.example/f.woff2", "https://cdn.example/f.woff2"),
        (1, "/app.js", "https://a.example/app.js"),
        (1, "style.css", "https://a.example/b/style.css"),
        (4, "https://c.example/api", "https://c.example/api"),
        (4, "mailto:a@b.example", None),
    ]
