"""Source maps, by hand."""

import base64

from gleanspark.plans.fixtures import FIXTURES
from gleanspark.sources.source_maps import inline_maps, map_sources, parsed_maps


def test_files_and_packages(spark):
    schema, rows = FIXTURES["source_maps"]
    parsed = parsed_maps(spark.createDataFrame(rows, schema))
    got = sorted((r["map_id"], r["position"], r["source"], r["package"]) for r in map_sources(parsed).collect())
    assert got == [
        (1, 0, "webpack:///./src/a.ts", None),
        (1, 1, "webpack:///./node_modules/react/index.js", "react"),
        (1, 2, "../node_modules/@scope/pkg/lib/x.js", "@scope/pkg"),
        (6, 0, "node_modules/x/node_modules/lodash/get.js", "lodash"),
        (6, 1, "node_modules/", None),
    ]
    assert {r["map_id"]: r["status"] for r in parsed.collect()} == {1: "ok", 2: "ok", 3: "not_object", 4: "broken", 5: "broken", 6: "ok"}


def test_inline_maps(spark):
    code = base64.b64encode(b'{"version":3,"sources":["a.js"]}').decode()
    scripts = [(1, f"let a;\n//# sourceMappingURL=data:application/json;charset=utf-8;base64,{code}"), (2, "//# sourceMappingURL=data:application/json;base64,A"), (3, None), (4, "//# sourceMappingURL=a.js.map")]
    maps = inline_maps(spark.createDataFrame(scripts, "script_id long, content string")).withColumnRenamed("script_id", "map_id")
    assert {r["map_id"]: (r["status"], r["version"], r["sources"]) for r in parsed_maps(maps).collect()} == {1: ("ok", 3, ["a.js"]), 2: ("broken", None, None)}
