"""Technology intelligence by hand: attribution, records, merging and confidence."""

from gleanspark.operators.intelligence import attributed, evidence_records, stripped, technology_entries, tracked

ASSETS = "page_id long, asset_id string, url string, original_url string, filename string, source string"
MATCHES = "page_id long, position int, technology string, name string, version string, confidence double, url string, filename string, reason string, resources array<string>, patterns array<struct<matcher: string, pattern: string, weight: double, detail: string>>, methods array<string>"
FRAMEWORK, VENDOR = "https://example.com/_next/static/chunks/framework.js", "https://example.com/_next/static/chunks/vendor.js"
REACT = (1, 0, "react", "React", "19.3.0", 85.0, FRAMEWORK, "framework.js", "", [FRAMEWORK, VENDOR], [("global", "React.version", 90.0, "19.3.0")], ["global"])


def _assets(spark):
    rows = [(1, "asset-framework", FRAMEWORK, None, "framework.js", "html"), (1, "asset-vendor", VENDOR, "https://Example.com/v.js#old", "vendor.js", "http_header"), (1, "asset-zwei", VENDOR, None, "later.js", "css"), (2, "other-page", FRAMEWORK, None, "f.js", "html"), (1, "nothing", None, None, None, None)]
    return spark.createDataFrame(rows, ASSETS)


def test_attribution(spark):
    rows = [(1, FRAMEWORK + "#frag", None), (1, "https://example.com/v.js", None), (1, "https://example.com/x/y.css?z", None), (1, "https://example.com/x/y", "own.js"), (1, "inline://script/3", None), (1, "https://example.com/dir", None), (1, None, None), (3, FRAMEWORK, "")]
    got = [tuple(r) for r in attributed(spark.createDataFrame(rows, "page_id long, url string, filename string"), _assets(spark)).select("url", "source_file", "asset_id", "discovery").collect()]
    assert sorted(got, key=str) == sorted(
        [
            (FRAMEWORK + "#frag", "framework.js", "asset-framework", "html"),
            ("https://example.com/v.js", "vendor.js", "asset-vendor", "network"),
            ("https://example.com/x/y.css?z", "y.css?z", None, "unknown"),
            ("https://example.com/x/y", "own.js", None, "unknown"),
            ("inline://script/3", "3.js", None, "unknown"),
            ("https://example.com/dir", None, None, "unknown"),
            (None, None, None, "unknown"),
            (FRAMEWORK, "framework.js", None, "unknown"),
        ],
        key=str,
    )


def test_records_of_a_match(spark):
    other = (1, 1, "vue", "Vue", "Unknown", 60.0, None, "vue.js", "by name", None, None, None)
    nowhere = (1, 2, "d3", "D3", None, 60.0, None, None, "", [VENDOR], [], None)
    labels = (2, 0, "a", "A", None, 50.0, None, None, "", None, [("string", "p", 70.0, "resource:x"), ("filename", "q.js", 20.0, "d"), ("header", "headers: Server", 30.0, "")], None)
    got = sorted((tuple(r) for r in evidence_records(spark.createDataFrame([REACT, other, nowhere, labels], MATCHES), _assets(spark)).drop("discovery", "position").collect()), key=str)
    assert got == sorted(
        [
            (1, "react", "React", "runtime_constant", "React.version", "19.3.0", 85.0, FRAMEWORK, "framework.js", "asset-framework"),
            (1, "react", "React", "runtime_constant", "React.version", "19.3.0", 85.0, VENDOR, "vendor.js", "asset-vendor"),
            (1, "vue", "Vue", "pattern_match", None, "by name", 60.0, None, "vue.js", None),
            (2, "a", "A", "pattern_match", "p", "p", 50.0, None, None, None),
            (2, "a", "A", "filename", "q.js", "q.js", 20.0, None, None, None),
            (2, "a", "A", "pattern_match", "headers: Server", "Server", 30.0, None, None, None),
        ],
        key=str,
    )


def test_entries_grow_and_merge(spark):
    again = (1, 5, "React", "React", "Unknown", 40.0, "https://example.com/z.js", None, "", [VENDOR], [("global", "React.version", 90.0, "19.3.0"), ("string", "React.createElement", 50.0, "")], ["string"])
    first = (1, 3, "nextjs", "Next.js", "Unknown", 80.0, None, "build-manifest.js", "", None, None, None)
    wide = (2, 0, "react", "React", None, 99.5, FRAMEWORK, None, "", [f"https://example.com/{k}.js" for k in range(30)], [("string", "x", 10.0, "")], None)
    matches = spark.createDataFrame([REACT, again, first, wide], MATCHES)
    got = {(r["page_id"], r["technology"]): tuple(r)[2:8] + (r["n_relationships"],) for r in technology_entries(matches, evidence_records(matches, _assets(spark))).collect()}
    # React alone: 85 + 3 (two files) + 1 (two records) = 89; the second match adds z.js and three records, as vendor.js's version came before
    assert got[1, "react"] == ("React", "19.3.0", min(100.0, 89.0 + 6 + 4), 3, 5, 2, 0)
    assert got[1, "nextjs"] == ("Next.js", "Unknown", 80.0, 1, 1, 0, 1)
    assert got[2, "react"][2] == 100.0 and len(got) == 3


def test_the_surest_of_equal_records_is_kept(spark):
    schema = "page_id long, technology string, name string, position int, evidence_type string, pattern string, text string, confidence double, url string, source_file string, asset_id string, discovery string"
    rows = [(1, "react", "React", 0, "pattern_match", "React.version", None, 90.0, None, "framework.js", None, "html"), (1, "React", "REACT", 1, "pattern_match", "React.version", "", 95.0, "", "framework.js", "a", "html"), (1, "react", "React", 2, "pattern_match", "React.version", None, 95.0, "u", "framework.js", None, "html")]
    got = sorted((r["confidence"], r["url"], r["first_position"]) for r in tracked(spark.createDataFrame(rows, schema)).collect())
    assert got == [(95.0, "", 0), (95.0, "u", 2)]


def test_prefixes_and_empty_tables(spark):
    row = spark.createDataFrame([(" JavaScript: runtime:x:y",)], "t string")
    assert row.select(stripped(row["t"])).first()[0] == "x:y"
    none = spark.createDataFrame([], MATCHES)
    assert technology_entries(none, evidence_records(none, _assets(spark))).count() == 0
