"""What scripts' sources show, by hand."""

from gleanspark.operators.script_findings import script_findings, script_packages
from gleanspark.plans.fixtures import FIXTURES


def _of(spark, function):
    schema, rows = FIXTURES["script_sources"]
    out = {}
    for r in function(spark.createDataFrame(rows, schema)).collect():
        out.setdefault(r["script_id"], []).append(tuple(r)[1:])
    return out


def test_findings_by_hand(spark):
    got = _of(spark, script_findings)
    assert set(got) == {1, 2, 3, 6}
    one = [(k, v) for _, e, k, v in got[1] if e == "banner"]
    assert one == [("license", "MIT License"), ("copyright", "Copyright (c) 2013-2024 Example Authors and others"), ("generated_by", "@generated by some-tool 1.4"), ("github_url", "https://github.com/example/react"), ("framework", "React")]
    assert [v for _, e, _, v in got[1] if e == "version_candidate"] == ["18.2.0", "1.4"]
    assert [(k, v) for _, e, k, v in got[1] if e == "import_export"] == [("import", "react"), ("import", "./style.css"), ("import", "react"), ("export", "./lib"), ("export", "App")]
    strings = [v for _, e, _, v in got[2] if e == "string_literal"]
    assert strings == ['it\'s \\"quoted\\" v1.2', "https://github.com/example/repo", "MIT License", "node_modules/@scope/pkg/index.js"]
    assert ("metadata", "metadata", "commit_hash", "0123456789abcdef0") in got[2] and ("metadata", "metadata", "build_hash", "deadbeef01") in got[2]
    assert ("package", "banner", "license", "MIT License") in got[2] and ("package", "package_reference", "literal", "node_modules/@scope/pkg/index.js") in got[2]
    # the word stands 17 characters before the second one too
    assert sorted(v for _, _, k, v in got[3] if k == "commit_hash") == ["abcdef0123456789", "abcdef01234567aa"]


def test_packages_by_hand(spark):
    assert {k: sorted(v, key=str) for k, v in _of(spark, script_packages).items()} == {1: [("react", None)], 2: [("@scope/pkg", None), ("lodash-es", None)], 3: [("@scope/tool", "3.4.5")]}


def test_long_literals_and_empty_tables(spark):
    text = "x = '" + "a\\'" * 3000 + "node_modules/y'; " + "'b.c'," * 2000
    rows = script_findings(spark.createDataFrame([(1, text)], "script_id long, content string")).where("evidence_type = 'string_literal'").collect()
    assert [r["value"] for r in rows] == ["b.c"]  # the first one's 512 characters say nothing
    empty = spark.createDataFrame([], "script_id long, content string")
    assert script_findings(empty).count() == 0 and script_packages(empty).count() == 0
