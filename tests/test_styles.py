"""Markers of style sheets, by hand."""

from pyspark.sql import functions as F

from gleanspark.operators.evidence import candidates
from gleanspark.operators.styles import as_evidence, style_evidence

SCHEMA = "style_id long, url string, filename string, content string"


def _found(spark, *rows):
    return sorted(tuple(r)[1:5] for r in style_evidence(spark.createDataFrame(list(rows), SCHEMA)).collect())


def test_three_variables_tell_and_two_do_not(spark):
    assert _found(spark, (1, None, None, "a{--tw-x:1;--tw-y:2}")) == []
    assert _found(spark, (1, None, None, "a{--tw-x:1;--tw-y:2;--tw-x :3}")) == [("tailwindcss", "css_variables", "--tw-*", None)]
    assert _found(spark, (1, None, None, "--TW-X:1;--TW-Y:2;--TW-Z:3")) == []


def test_first_kind_of_a_value_counts(spark):
    got = _found(spark, (1, None, "bootstrap.css", "@import 'bootstrap.css'; @import 'bootstrap'; @import 'bootstrap'; x{}/*Bootstrap 5*/"))
    assert got == [("bootstrap", "asset", "bootstrap.css", None), ("bootstrap", "banner", "/*Bootstrap 5", "5"), ("bootstrap", "package_path", "bootstrap", None)]


def test_long_banner_is_cut_and_names_in_words_are_none(spark):
    assert _found(spark, (1, None, None, "/* bootstrap " + "1" * 200)) == [("bootstrap", "banner", "/* bootstrap " + "1" * 67, "1" * 200)]
    assert _found(spark, (1, None, None, "@import 'bootstrap\u00e9'; .bootstrap{} node_modules/other")) == []


def test_nulls_repeated_ids_long_sheets_and_empty_tables(spark):
    assert _found(spark, (1, None, None, None), (1, "https://a/cdn-cgi/x", None, None), (1, "https://a\\cdn-cgi\\x", None, ""), (None, None, None, "p{}")) == [("cloudflare", "cdn_path", "/cdn-cgi/", None)] * 2
    assert _found(spark, (1, None, None, "p { margin: 0 } " * 100_000 + "@tailwind base;")) == [("tailwindcss", "directive", "@tailwind base", None)]
    assert style_evidence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_markers_become_candidates(spark):
    found = style_evidence(spark.createDataFrame([(7, None, "bootstrap.min.css", "@tailwind base;")], SCHEMA))
    got = candidates(as_evidence(found, F.lit(1).cast("long"))).collect()
    assert sorted(r["identity"] if "identity" in r else r["technology"] for r in got) == ["bootstrap", "tailwindcss"]
