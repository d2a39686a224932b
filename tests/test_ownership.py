"""Ownership, affinity, scope and the versions they lead to, by hand."""

import pytest
from pyspark.sql import functions as F

from gleanspark.operators.ownership import asset_affinity, asset_owners, evidence_ownership, extracted_candidates, extraction_ownership, scoped_resources
from gleanspark.operators.providers import resolved_versions

RESOURCES = "page_id long, asset_id long, url string, filename string"
MATCHES = "page_id long, technology string, url string, filename string, resources array<string>, evidence_files array<string>"
HITS = "asset_id long, technology string, method string, version string, weight double"


@pytest.mark.parametrize(
    "technology, filename, url, affinity",
    [
        ("generic-library", "generic-library-3.6.0.min.js", None, 95.0),
        ("generic-library", "app.js", "https://cdn.example.com/generic.library@3/x.js", 90.0),
        ("generic_library", None, "https://cdn.example.com/genericlibrary-3.js", 90.0),
        ("jquery", None, "https://a.example/myjquery.js", 75.0),
        ("nextjs", None, "https://a.example/_next/x.js", 75.0),
        ("nextjs", None, "https://a.example/next/x.js", 90.0),
        ("package:Lodash", "LODASH.min.js", None, 95.0),
        ("material-ui", "mui.js", "", 95.0),
        ("q", "q.js", "https://a.example/q/q.js", 0.0),
        ("react", None, None, 0.0),
        (None, "react.js", None, 0.0),
    ],
)
def test_affinity(spark, technology, filename, url, affinity):
    rows = spark.createDataFrame([(technology, filename, url)], "t string, f string, u string")
    assert rows.select(asset_affinity(F.col("t"), F.col("f"), F.col("u"))).first()[0] == affinity


def test_owners_are_one_by_asset_key(spark):
    rows = [("https://A.example/react.js#x", "r.js"), ("https://a.example/react.js", "react.js"), ("https://a.example/other.js", "other.js"), (None, "react.js"), ("nope", "react.js")]
    got = asset_owners(spark.createDataFrame(rows, "url string, filename string"), ["react", "vue"]).where("asset_key is not null").collect()
    assert [tuple(r) for r in got] == [("https://a.example/react.js", "react", 95.0)]


def test_each_basis_of_ownership(spark):
    rows = [
        (1, "a", "banner", "x", {}, "React"),
        (1, "b", "banner", "react", {"technology": " React "}, None),
        (1, "c", "banner", "react", {"technology": "vue"}, "jquery"),
        (1, "d", "banner", "react", {"runtime_family": "vue"}, None),
        (1, "e", "banner", "", {"package": "React-DOM/server"}, None),
        (1, "f", "runtime_pattern", "react", {}, None),
        (1, "g", "version_candidate", "v18", {}, None),
        (1, "h", "version_candidate", "react 18", {}, None),
        (1, "i", None, None, None, None),
        (2, "j", "banner", "react", {}, None),
        (None, "k", "banner", "react", {}, "react"),
    ]
    evidence = spark.createDataFrame(rows, "page_id long, evidence_id string, evidence_type string, value string, metadata map<string,string>, technology string")
    detections = spark.createDataFrame([(1, "react"), (1, "react"), (1, "vue"), (1, None), (1, ""), (3, "react"), (None, "react")], "page_id long, technology string")
    matched = spark.createDataFrame([(1, "f", "REACT"), (1, "g", "react"), (1, "a", "react"), (1, "f", None)], "page_id long, evidence_id string, technology string")
    got = {(r["evidence_id"], r["technology"]): tuple(r)[3:] for r in evidence_ownership(evidence, detections, matched).collect()}
    assert got == {
        ("a", "react"): ("OWNED", 98.0, "technology_field", True, True),
        ("b", "react"): ("OWNED", 95.0, "metadata_technology", True, True),
        ("c", "vue"): ("OWNED", 95.0, "metadata_technology", True, True),
        ("d", "vue"): ("OWNED", 90.0, "runtime_family", True, True),
        ("e", "react"): ("OWNED", 82.0, "package_hint", True, True),
        ("f", "react"): ("ASSOCIATED", 72.0, "matched_detection_evidence", True, True),
        ("g", "react"): ("INCIDENTAL", 20.0, "matched_evidence_version_candidate", False, False),
        ("h", "react"): ("OWNED", 55.0, "value_hint", True, False),
    }
    assert evidence_ownership(evidence, detections).where("evidence_id in ('f', 'g')").select("evidence_id", "basis").collect() == [("f", "value_hint")]
    assert evidence_ownership(evidence.limit(0), detections).count() == 0 and evidence_ownership(evidence, detections.limit(0)).count() == 0


def test_extraction_ownership(spark):
    rows = [("banner", "lib-a-1.js"), ("banner", "app.js"), ("RUNTIME_CONSTANT", "app.js"), ("generic_literal", "lib-a.js"), (None, None)]
    got = spark.createDataFrame(rows, "m string, f string").select(extraction_ownership(F.lit("lib-a"), F.col("m"), F.col("f"), F.lit(None).cast("string")).alias("o")).select("o.*").collect()
    assert [tuple(r) for r in got] == [
        ("OWNED", 95.0, "js_asset_affinity"),
        ("OWNED", 70.0, "js_extractor_low_affinity"),
        ("OWNED", 95.0, "js_self_proving_method"),
        ("ASSOCIATED", 60.0, "js_weak_method"),
        ("OWNED", 95.0, "js_self_proving_method"),
    ]


def test_scope_falls_back_only_where_nothing_is_named(spark):
    resources = spark.createDataFrame([(1, 1, "https://a.example/x.js", "x.js"), (1, 2, "https://a.example/y.js", "y.js"), (1, 3, None, "z.js"), (1, 4, None, "z.js"), (2, 5, "https://a.example/x.js", "x.js")], RESOURCES)
    rows = [
        (1, "url", " https://a.example/x.js ", None, None, None),
        (1, "file", None, None, ["static/y.js", ""], ["z.js"]),
        (1, "gone", None, "gone.js", None, None),
        (1, "all", "", " ", [None], []),
        (2, "all", None, None, None, None),
        (3, "all", None, None, None, None),
    ]
    got = sorted(tuple(r) for r in scoped_resources(spark.createDataFrame(rows, MATCHES), resources).collect())
    assert got == [(1, "all", 1), (1, "all", 2), (1, "all", 3), (1, "file", 2), (1, "file", 3), (1, "url", 1), (2, "all", 5)]


def _resolved(spark, resources, hits, matches=None):
    resources, hits = spark.createDataFrame(resources, RESOURCES), spark.createDataFrame(hits, HITS)
    matches = matches and spark.createDataFrame(matches, MATCHES)
    return sorted(tuple(r) for r in resolved_versions(extracted_candidates(hits, resources, matches)).collect())


def test_a_mention_elsewhere_cannot_outweigh_the_library(spark):
    resources = [(1, 1, "https://cdn.example.com/generic-library-3.6.0.min.js", "generic-library-3.6.0.min.js"), (1, 2, "https://cdn.example.com/app.bundle.js", "app.bundle.js")]
    hits = [(1, "generic-library", "BANNER", "3.6.0", 80.0), (2, "generic-library", "BANNER", "1.2.3", 80.0), (2, "generic-library", "GENERIC_LITERAL", "9.9.9", 55.0)]
    assert _resolved(spark, resources, hits) == [(1, "generic-library", "3.6.0", "WEAK_ALTERNATE", "1.2.3,9.9.9")]


def test_equal_owners_without_provenance_stay_open(spark):
    resources = [(1, k, f"https://cdn.example.com/lib-y-{k}.0.0.min.js?x", f"lib-y-{k}.0.0.min.js") for k in (1, 2)]
    got = _resolved(spark, resources, [(k, "lib-y", "BANNER", f"{k}.0.0", 80.0) for k in (1, 2)])
    assert got == [(1, "lib-y", "Unknown", "AMBIGUOUS", "1.0.0,2.0.0")]
    # the detection names the file by the end of its path
    match = (1, "lib-y", None, "js/lib-y-2.0.0.min.js", [None, "a/lib-y-1.0.0.min.js", "b/lib-y-2.0.0.min.js"], None)
    assert _resolved(spark, resources, [(k, "lib-y", "BANNER", f"{k}.0.0", 80.0) for k in (1, 2)], [match])[0][2] == "2.0.0"


def test_provenance_decides_between_equal_owners(spark):
    resources = [(1, 1, "https://cdn.example.com/examplelib-3.6.0.min.js", "examplelib-3.6.0.min.js"), (1, 2, "https://cdn.example.com/examplelib-3.5.1.min.js", "examplelib-3.5.1.min.js")]
    hits = [(1, "examplelib", "BANNER", "3.6.0", 80.0), (2, "examplelib", "BANNER", "3.5.1", 80.0)]
    assert _resolved(spark, resources, hits) == [(1, "examplelib", "Unknown", "AMBIGUOUS", "3.5.1,3.6.0")]
    match = (1, "examplelib", "https://cdn.example.com/examplelib-3.6.0.min.js", "examplelib-3.6.0.min.js", ["https://cdn.example.com/examplelib-3.5.1.min.js"], None)
    assert _resolved(spark, resources, hits, [match]) == [(1, "examplelib", "3.6.0", "WEAK_ALTERNATE", "3.5.1")]
    # only what the detection came from is looked at
    assert _resolved(spark, resources, hits, [match[:4] + (None, None)]) == [(1, "examplelib", "3.6.0", "NO_CONFLICT", "")]
    assert _resolved(spark, resources, hits, [(1, "other", None, None, None, None)]) == []
