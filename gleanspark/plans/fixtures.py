"""Small literal tables for the queries whose patterns the synthetic tables don't hold, for Spark and for SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanspark.session import literal

Rows = tuple[str, list[tuple]]

FIXTURES: dict[str, Rows] = {
    "contexts": (
        "page_id long, ctx_id long, url string, filename string, content string, source_map_url string",
        [
            (1, 1, "https://a.example/static/main.js", "main.js", 'React.createElement("div"); ReactDOM.createRoot(x); React.version = "18.2.0";', None),
            (1, 2, "https://a.example/static/vendor.bundle.js", "vendor.bundle.js", "__webpack_require__(1); axios.create({}); window.axios = 1;", None),
            (2, 3, "https://b.example/jquery.min.js", "jquery.min.js", 'jQuery.fn.jquery = "3.7.1"; var jQuery = 1;', None),
            (2, 4, "https://b.example/app.js", "app.js", "Vue.createApp(App); __VUE__ = true; import.meta.hot", None),
            (3, 5, "https://c.example/chart.js", "chart.js", "var x = 1;", None),
            (3, 6, "https://c.example/x.js", "x.js", "wp-content/themes/a wp-includes/js/b", None),
            (4, 7, "https://d.example/plain.js", "plain.js", "nothing here", None),
            (4, 8, None, None, None, None),
        ],
    ),
    "evidence": (
        "page_id long, evidence_id string, source string, url string, file string, evidence_type string, value string, metadata map<string,string>",
        [
            (1, "e1", "javascript", "https://a.example/main.js", "main.js", "runtime_pattern", "ReactDOM.createRoot", {"runtime_family": "react"}),
            (1, "e2", "package", "https://a.example/vendor.js", "vendor.js", "package_reference", "node_modules/react-dom/index.js", {}),
            (1, "e3", "network", "https://a.example/", None, "http_header", "nginx/1.25", {"header": "server"}),
            (2, "e4", "html", "https://b.example/", None, "html_element", "WordPress 6.4", {}),
            (2, "e5", "bundle", "https://b.example/app.js", "app.js", "bundle_runtime", "__webpack_require__", {"bundler": "webpack"}),
            (2, "e6", "package", "https://b.example/app.js", "app.js", "package_reference", "@scope/widget-kit", {}),
            (3, "e7", "package", "https://c.example/x.js", "x.js", "package_reference", "./local/file.js", {}),
            (3, "e8", "javascript", "https://c.example/x.js", "x.js", "runtime_pattern", "zone.js", {}),
        ],
    ),
    "responses": (
        "page_id long, url string, final_url string, status_code int, headers map<string,string>, set_cookies array<string>, redirects array<struct<url:string,status_code:int,location:string>>",
        [
            (1, "http://a.example", "https://a.example/", 200, {"Server": "nginx", "Content-Type": "text/html", "Content-Security-Policy": "default-src 'self'; img-src *", "Strict-Transport-Security": "max-age=63072000"}, ["session=abc; Path=/; Secure; HttpOnly", "__Host-id=7; Path=/; Secure; SameSite=Lax; Max-Age=60"], [("http://a.example", 301, "https://a.example/")]),
            (2, "https://b.example", "https://b.example/", 404, {"x-powered-by": "Express", "Cache-Control": "no-store"}, [], []),
            (3, "https://c.example", "https://c.example/", 200, {}, ["flag"], []),
        ],
    ),
    "scripts": (
        "script_id long, url string, content string",
        [
            (1, "https://a.example/main.js", 'import x from "./lib/a.js"; import("./lazy.js"); export function start() {} const t = "abc"; /* React v18.2.0 */ useState()'),
            (2, "https://a.example/lib/a.js", 'export const a = 1; new Worker("/work.js"); jquery@3.7.1'),
            (3, "https://a.example/lazy.js", 'webpackJsonp.push(1); Bootstrap v5.3.2 fetch("data.json")'),
            (4, "https://a.example/copy.js", 'export const a = 1; new Worker("/work.js"); jquery@3.7.1'),
            (5, "https://a.example/work.js", None),
            (6, "https://a.example/app.chunk.js", "//# sourceMappingURL=old.map\nlet q = 1;\n/*# sourceMappingURL=app.chunk.js.map*/"),
        ],
    ),
    "script_sources": (
        "script_id long, content string",
        [
            (1, "/*!\n * React v18.2.0\n * MIT License\n * Copyright (c) 2013-2024 Example Authors and others\n * @generated by some-tool 1.4\n * https://github.com/example/react\n */\nimport React, { useState } from 'react';\n  import './style.css'\nimport React from 'react';\nexport default function App() {}\nexport * from './lib';\n"),
            (2, "const a = \"it's \\\"quoted\\\" v1.2\", b = 'say \"hi\"', c = `x ${a}`, d = 'ab', e = 'https://github.com/example/repo', f = \"MIT License\", g = 'node_modules/@scope/pkg/index.js';\nimport('lodash-es'); require( 'left-pad' )\n// commit 0123456789abcdef0\nvar buildId = \"deadbeef01\"; hash: 'DEADBEEF02'"),
            (3, "x={\"name\":\"@scope/tool\",\n \"version\":\"3.4.5\"};y={'name':'./odd','version':'1'};abcdef0123456789 is the revision; abcdef01234567aa nothing near"),
            (4, None),
            (5, ""),
            (6, "'unclosed\nlet q = \"closed.one\"; // Built with Example Tool; rest"),
        ],
    ),
    "source_maps": (
        "map_id long, text string",
        [
            (1, '{"version":3,"file":"app.js","sources":["webpack:///./src/a.ts","webpack:///./node_modules/react/index.js","../node_modules/@scope/pkg/lib/x.js",7,null],"names":["a","useState"],"sourcesContent":["let a",null],"mappings":"AAAA"}'),
            (2, '{"version":"3","file":null,"sources":"one.js"}'),
            (3, "[1, 2]"),
            (4, ")]}'{broken"),
            (5, None),
            (6, '{"sources":["node_modules/x/node_modules/lodash/get.js","node_modules/"],"names":[]}'),
        ],
    ),
    "secret_texts": (
        "page_id long, source string, text string",
        [
            (1, "a.js", 'const cfg = {\n  username: "deploy-bot",\n  password: "Tr0ub4dor&3xyz",\n};'),
            (1, "b.js", 'password = process.env.PASSWORD;\npassword: "changeme"\npassword = ""'),
            (1, "c.js", "aws = 'AKIA" + "Q7R2T9W4X6Z8B3D5'\n" + "secret_access_key = 'wJalrXUtnFEMI" + "K7MDENGbPxRfiCYq8Zk2Lm4Np'"),
            (2, "d.js", 'api_key = "a8Kd93kdLs02Pq7ZxW"\n// TODO remove\nhost = "10.0.0.7"'),
            (2, "e.js", '<input type="password" name="password">\ntoken = "${TOKEN}"'),
            (2, "f.js", 'api_key = "a8Kd93kdLs02Pq7ZxW"\napi_key = "a8Kd93kdLs02Pq7ZxW"'),
            (3, "g.js", None),
            (4, "h.js", 'db_host = "db.internal"\ndb_user: "svc-reports"\npassword: "Tr0ub4dor&3xyz"\n' + "\n" * 12 + 'password: "0therV4lue!zz"'),
        ],
    ),
    "artifact_texts": (
        "page_id long, source string, text string",
        [
            (1, "a.html", "see /graphql and swagger-ui at amazonaws.com; <!-- DEBUG --> config.json"),
            (1, "b.js", "process.env.API_URL; __webpack_require__; backup.zip?x; sentry.io/1"),
            (2, "c.js", 'key = "Zx81kdP0qLm3Rt7Vn2Bc5Ws9"; localhost:3000'),
        ],
    ),
    "provider_rows": (
        "page_id long, provider string, name string, version string, confidence double, n_evidence int",
        [
            (1, "internal", "React", "18.2.0", 88.0, 3),
            (1, "wappalyzer", "React", "18.2.0", None, 1),
            (1, "retirejs", "react", "17.0.2", 80.0, 0),
            (1, "wappalyzer", "Next.js", "", None, 2),
            (2, "internal", "jQuery", "Unknown", 75.5, 1),
            (2, "retirejs", "jQuery", "3.4.0", 90.0, 1),
        ],
    ),
    "provider_json": (
        "page_id long, json string",
        [
            (1, '[{"name": "React", "version": "18.2.0", "confidence": 100}, {"name": "Webpack"}]'),
            (2, '{"technologies": [{"name": "Vue.js", "version": "3.4"}]}'),
            (3, '{"https://c.example": {"technologies": [{"name": "jQuery", "confidence": 50}]}}'),
            (4, "not json"),
        ],
    ),
    "ours": ("page_id long, technology_id string, version string", [(1, "react", "18.2.0"), (1, "webpack", "Unknown"), (2, "vue", "3.4.0"), (3, "jquery", "3.7.1")]),
    "theirs": ("page_id long, technology_id string, version string", [(1, "react", "18.2.0"), (2, "vue", "3.3.0"), (2, "nginx", "1.25"), (3, "jquery", "3.7.1"), (3, "php", "Unknown")]),
    "detections": (
        "page_id long, technology string, category string, version string, confidence double, filename string, evidence array<string>",
        [
            (1, "nextjs", "meta-framework", "14.1.0", 96.5, "main.js", ["string:__NEXT_DATA__", "regex:/_next/static/"]),
            (1, "react", "framework", "18.2.0", 91.25, "main.js", ["string:React.createElement"]),
            (1, "webpack", "build-tool", "Unknown", 80.0, None, []),
            (2, "nuxt", "meta-framework", "Unknown", 88.0, "a.js", ["global:__NUXT__"]),
            (2, "vue", "framework", "3.4.0", 88.0, "a.js", ["string:Vue.createApp"]),
            (2, "angularjs", "framework", "Unknown", 60.0, "b.js", []),
            (3, "nextjs", "meta-framework", "Unknown", 90.0, "n.js", []),
            (3, "react", "framework", "Unknown", 50.0, "n.js", []),
            (3, "vue", "framework", "Unknown", 55.0, "n.js", []),
        ],
    ),
    "conflicts": (
        "technology string, other string, minimum_score double",
        [("react", "preact", 45.0), ("angular", "angularjs", 45.0), ("angularjs", "vue", 45.0), ("vue", "nuxt", 45.0), ("nextjs", "vue", 40.0), ("react", "vue", 60.0), ("webpack", "react", 50.0)],
    ),
    "needs": ("technology string, needs string", [("nextjs", "react"), ("nuxt", "vue"), ("nuxt", "nitro")]),
    "assignments": (
        "page_id long, text string",
        [
            (1, 'username: "deploy-bot",\n\n\npassword: "Tr0ub4dor&3xyz"\npassword = "second-one"'),
            (2, 'pwd = "above-it"\r\nx\r\nlogin = "ada"\r\nDB_USER: \'root\' password: "same line"'),
            (3, 'login = "far"' + "\n" * 9 + 'password = "too-far"' + "\n" * 8 + "user_name='near'"),
            (4, "password = 'abc'\nusername = 'x'"),
            (5, None),
            (6, ""),
        ],
    ),
    "samples": ("sample_id string, expected array<string>, found array<string>", [("react-spa", ["react", "webpack"], ["react"]), ("vue-nuxt", ["vue", "nuxt"], ["nuxt", "vue", "vite"]), ("plain", ["nginx"], [])]),
    "version_candidates": (
        "page_id long, technology string, version string, source string, priority double, ownership_confidence double, preferred boolean, confirmable boolean, origin string",
        [
            (1, "react", "18.2.0", "runtime", 95.0, 90.0, True, True, None),
            (1, "react", "18.2.0", "package", 100.0, 90.0, False, True, None),
            (1, "react", "17.0.2", "banner", 75.0, 40.0, False, True, None),
            (2, "vue", "3.4.0", "runtime", 95.0, 70.0, False, True, None),
            (2, "vue", "3.3.1", "package", 100.0, 65.0, False, True, None),
            (3, "jquery", "3.7.1", "regex", 20.0, 30.0, False, False, None),
            (3, "d3", "0.0.0", "runtime", 95.0, 90.0, True, True, None),
            (4, "axios", "1.6.0", "banner", 80.0, 80.0, False, True, "https://a.example/app.js"),
            (4, "axios", "1.6.0", "regex", 60.0, 80.0, False, True, "https://a.example/app.js"),
            (4, "axios", "1.6.0", "string", 50.0, 80.0, False, True, "https://a.example/app.js"),
            (4, "axios", "1.4.0", "package", 90.0, 80.0, False, True, "https://a.example/v.js"),
            (4, "axios", "1.4.0", "runtime", 80.0, 80.0, False, True, "https://a.example/w.js"),
            (5, "lodash", "4.17.21", "package", 100.0, 95.0, True, False, "x.js"),
            (5, "lodash", "4.17.21", "banner", 60.0, 50.0, False, True, "y.js"),
            (5, "lodash", "4.0.0", "runtime", 70.0, 60.0, False, True, "z.js"),
        ],
    ),
    "owned_evidence": (
        "page_id long, evidence_id string, evidence_type string, value string, metadata map<string,string>, technology string",
        [
            (1, "a", "banner", "x", {}, "React"),
            (1, "b", "banner", "react", {"technology": " React "}, None),
            (1, "c", "banner", "react", {"technology": "vue"}, "jquery"),
            (1, "d", "banner", "react", {"runtime_family": "vue"}, None),
            (1, "e", "banner", "", {"package": "React-DOM/server"}, None),
            (1, "f", "runtime_pattern", "react", {}, None),
            (1, "g", "version_candidate", "v18", {}, None),
            (1, "h", "version_candidate", "react 18", {}, None),
            (2, "i", "banner", "react", {}, None),
            (3, "j", "package_reference", "node_modules/@mui/system", {}, None),
            (3, "k", "package_reference", "nextauth", {"package": "next"}, None),
        ],
    ),
    "owned_detections": ("page_id long, technology string", [(1, "react"), (1, "vue"), (2, "vue"), (3, "material-ui"), (3, "nextjs")]),
    "owned_matches": ("page_id long, evidence_id string, technology string", [(1, "f", "REACT"), (1, "g", "react"), (1, "a", "react")]),
    "resources": (
        "page_id long, asset_id long, url string, filename string, content string",
        [
            (1, 1, "https://cdn.example.com/jquery-3.6.0.min.js", "jquery-3.6.0.min.js", "/*! jQuery v3.6.0 | (c) Example Foundation */"),
            (1, 2, "https://cdn.example.com/app.js", "app.js", "/* jQuery v1.4.0 once */"),
            (1, 3, "https://cdn.example.com/app.js", "app.js", "jQuery v9.9.9"),
            (2, 4, "https://b.example/react.js", "react.js", 'React.version = "18.2.0";'),
            (2, 5, "https://b.example/other/react.js", "react.js", 'React.version = "17.0.2";'),
            (3, 6, None, "inline-1.js", "lodash 4.17.21"),
        ],
    ),
    "owner_assets": (
        "url string, filename string",
        [
            ("https://CDN.example.com/jquery@3.7.1/dist/x.js", "x.js"),
            ("https://cdn.example.com/libs/myjquery/y.js", "y.js"),
            ("https://cdn.example.com/a/react-dom.production.min.js?v=1#top", "react-dom.production.min.js"),
            ("https://cdn.example.com/a/react-dom.production.min.js?v=1", "other.js"),
            ("https://cdn.example.com/plain.js", "plain.js"),
            ("https://cdn.example.com/MUI/index.js", None),
            (None, "vue.js"),
        ],
    ),
    "sheets": (
        "style_id long, url string, filename string, content string",
        [
            (1, "https://a.example/x.css", "x.css", "/*!\n  Bootstrap v5.3.2 (https://example.com)\n */ /* * Bootstrap v4.0 */ @import 'bootstrap'; @import \"~bootstrap/dist/css\"; @import 'Bootstrap';"),
            (2, "https://a.example/CDN-CGI/y.css", "Bootstrap.Bundle.min.css", "p { margin: 0 }"),
            (3, None, None, "@tailwind base; @tailwind  base;@TAILWIND utilities; @tailwind based; p { --tw-a: 1; --tw-b : 2; --tw-c:3 } /* tailwindcss v3.4.1 */"),
            (4, None, None, "p { --tw-a: 1; --tw-b: 2 } @import 'bootstrap-icons'; url(node_modules\\tailwindcss/base.css)"),
            (5, None, "bootstrap.css", None),
            (6, None, None, ""),
        ],
    ),
    "scopes": (
        "page_id long, technology string, url string, filename string, resources array<string>, evidence_files array<string>",
        [
            (1, "jquery", None, None, None, None),
            (2, "react", "https://b.example/react.js", None, [], []),
            (2, "vue", None, None, ["/static/react.js", "x/react.js"], None),
            (3, "lodash", None, None, [" "], ["inline-1.js"]),
            (3, "axios", None, "gone.js", None, None),
        ],
    ),
    "intelligence_assets": (
        "page_id long, asset_id string, url string, original_url string, filename string, source string",
        [(1, "asset-framework", "https://example.com/static/framework.js", None, "framework.js", "html"), (1, "asset-vendor", "https://example.com/static/vendor.js", "https://Example.com/v.js#old", "vendor.js", "http_header"), (2, "other-page", "https://example.com/static/framework.js", None, "f.js", "html")],
    ),
    "intelligence_matches": (
        "page_id long, position int, technology string, name string, version string, confidence double, url string, filename string, reason string, resources array<string>, patterns array<struct<matcher: string, pattern: string, weight: double, detail: string>>, methods array<string>",
        [
            (1, 0, "react", "React", "19.3.0", 85.0, "https://example.com/static/framework.js", "framework.js", "", ["https://example.com/static/framework.js", "https://example.com/static/vendor.js"], [("global", "React.version", 90.0, "19.3.0")], ["global"]),
            (1, 5, "React", "React", "Unknown", 40.0, "https://example.com/z.js", None, "", ["https://example.com/v.js"], [("string", "React.createElement", 50.0, "")], ["string"]),
            (1, 3, "nextjs", "Next.js", "Unknown", 80.0, None, "build-manifest.js", "", None, None, None),
            (3, 0, "vue", "Vue", "3.4.0", 99.5, "https://c.example/a.js", None, "", ["https://c.example/b.js", "https://c.example/c.js"], [("string", "Vue.createApp", 30.0, "")], ["string"]),
        ],
    ),
    "robots": ("id long, text string", [(1, "User-agent: *\nSitemap: https://a.example/sitemap.xml\nsitemap:/b.xml  \nDisallow: /x"), (2, "# Sitemap: no"), (3, ""), (4, None), (5, "Sitemap:\thttps://c.example/s.xml.gz\r\nSitemap: https://c.example/t.xml")]),
    "manifests": (
        "id long, text string",
        [(1, '{"name": "A", "icons": [{"src": "/i.png", "sizes": "48x48"}, {"sizes": "1x1"}], "screenshots": [{"src": "s.webp"}], "shortcuts": [{"name": "x", "icons": [{"src": "c.svg"}]}]}'), (2, "not json"), (3, '{"icons": []}'), (4, None), (5, '{"shortcuts": [{"icons": [{"src": "d.png"}]}, {"name": "none"}]}')],
    ),
    "observed": (
        "page_id long, resource_type string, url string, available boolean",
        [(1, "robots", "https://a.example/robots.txt", True), (1, "robots", "https://www.a.example/robots.txt", True), (1, "sitemap", "https://a.example/sitemap.xml", False), (2, "humans", "https://b.example/humans.txt", None), (2, "ads", "https://b.example/ads.txt", True), (2, "favicon", "https://b.example/favicon.ico", True)],
    ),
    "styles": (
        "id long, css string",
        [(1, "@import 'base.css'; body { background: url( \"a b.png\" ) } p { src: URL(f.woff2) }"), (2, "@IMPORT \"x.css\"; @import url(y.css);"), (3, "p { margin: 0 }"), (4, ""), (5, None)],
    ),
    "ranked": (
        "page_id long, technology string, version string, confidence double, weight double",
        [(1, "react", "18.2.0", 90.0, 25.0), (1, "react", "18.1.0", 90.0, 30.0), (1, "react", "17.0.2", 95.0, 10.0), (1, "vue", "3.4.1", 80.0, 25.0), (1, "vue", "3.4.0", 80.0, 25.0), (2, "react", "16.0.0", 10.0, 1.0), (2, None, "1.0", 5.0, 1.0)],
    ),
    "versions": ("id long, raw string", [(1, "v1.2.3"), (2, '"2.0"'), (3, "0.0.0"), (4, "7"), (5, "1.2.3-beta.1+b5"), (6, "0.1"), (7, "abc"), (8, ""), (9, None), (10, "V10.20"), (11, "12345.1"), (12, "0.0")]),
    "urls": ("id long, url string", [(1, "HTTPS://Example.COM/a/b/?q=1#x"), (2, "http://example.com"), (3, " http://A.b/c// "), (4, "https://h.example:8080/p/file.min.js"), (5, "nope"), (6, None), (7, "ftp://x.example/y/"), (8, "https://u.example/manifest.json?v=2")]),
    "assets": (
        "id long, url string, filename string, mime string, hint string",
        [(1, "https://a/x.js", "x.js", None, None), (2, "https://a/x", "x", "text/css; charset=utf-8", None), (3, "https://a/app.worker.js", "app.worker.js", None, None), (4, "https://a/Site.WebManifest", "Site.WebManifest", None, None), (5, "https://a/robots.txt", "robots.txt", None, None), (6, "https://a/f.woff2", "f.woff2", None, None), (7, "https://a/service-worker", "service-worker", None, None), (8, "https://a/b", "b", "image/png", None), (9, "https://a/c", "c", None, "json"), (10, "https://a/d", "d", None, "unknown")],
    ),
    "downloads": ("id long, ok boolean, status int, error string", [(1, True, 200, None), (2, False, 403, "denied"), (3, False, 429, ""), (4, False, None, "read timeout"), (5, False, None, "HTTP 403 for url"), (6, False, None, "exceeds limit"), (7, False, 500, "server error"), (8, None, None, None)]),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = FIXTURES[name]
    return literal(spark, rows, schema)


_KINDS = {"long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "map<string,string>": "MAP(VARCHAR, VARCHAR)", "array<string>": "VARCHAR[]"}


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, int | float):
        return repr(v)
    if isinstance(v, dict):
        return "MAP {" + ", ".join(f"{_literal(k)}: {_literal(x)}" for k, x in v.items()) + "}"
    if isinstance(v, list):
        return "[" + ", ".join(map(_literal, v)) + "]"
    return "'" + str(v).replace("'", "''") + "'"


def sql(name: str) -> str:
    """The fixture as a subquery with the same columns."""
    schema, rows = FIXTURES[name]
    cols = [c.rsplit(" ", 1) for c in schema.split(", ")]
    usable = [(k, n, t) for k, (n, t) in enumerate(cols) if t in _KINDS]
    body = ", ".join("(" + ", ".join(_literal(r[k]) for k, _, _ in usable) + ")" for r in rows)
    casts = ", ".join(f"CAST({n} AS {_KINDS[t]}) AS {n}" for _, n, t in usable)
    return f"(SELECT {casts} FROM (VALUES {body}) AS v({', '.join(n for _, n, _ in usable)}))"
