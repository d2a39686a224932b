"""DuckDB SQL with the same results as the named queries, where SQL can express them."""

from __future__ import annotations

import re

from gleanspark.functions import fixed_values as V
from gleanspark.functions.identities import RELATIONSHIPS
from gleanspark.functions.js_patterns import JS_BUNDLE_PATTERNS, JS_RUNTIME_PATTERNS, JS_VERSION_PATTERNS
from gleanspark.functions.version_patterns import METHOD_WEIGHTS, VERSION_PATTERNS
from gleanspark.operators import javascript as J
from gleanspark.operators import script_findings as SF
from gleanspark.operators import sensitive as S
from gleanspark.functions.fingerprints import FINGERPRINTS
from gleanspark.operators.fingerprint import BOOTSTRAP_MARKERS, BUNDLE_HINTS, VERSION_MULTIPLIERS, Pattern, evidence_tier, fingerprint_patterns, strong_pattern, version_patterns, weak_pattern
from gleanspark.operators.pages import WELL_KNOWN, WELL_KNOWN_ANALYZERS
from gleanspark.operators.scan import CONTACT_BY_NAME, ENTROPY_ASSIGNMENT
from gleanspark.plans.fixtures import sql as table
from gleanspark.sources import source_maps as SM

#: As in queries.
CASES, SCRIPTS = 1_000_000_000, 1000


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(kind: str, source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    _, _, _, flags, group, pattern = CONTACT_BY_NAME[kind]
    return f"""SELECT value, count(*) AS n, count(DISTINCT id) AS n_docs
FROM (SELECT {key} AS id, unnest(regexp_extract_all({text}, {_q(pattern)}, {group}, '{flags or "c"}')) AS value FROM {source}) GROUP BY value"""


def _normalized(url: str) -> str:
    """The URL of a trimmed expression in its normal form."""
    p = r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
    part = lambda k: f"regexp_extract({url}, {_q(p)}, {k})"
    path = f"CASE WHEN {part(3)} IN ('', '/') THEN '/' ELSE regexp_replace({part(3)}, '/+$', '') END"
    return f"CASE WHEN regexp_matches({url}, {_q(p)}) THEN lower({part(1)}) || '://' || lower({part(2)}) || {path} || {part(4)} || {part(5)} END"


def _filename(url: str) -> str:
    path = f"regexp_replace(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.\\-]*:(?://[^/?#]*)?([^?#]*)', 1), '/+$', '')"
    return f"CASE WHEN {url} IS NULL OR coalesce(list_last(string_split({path}, '/')), '') = '' THEN 'script.js' ELSE list_last(string_split({path}, '/')) END"


_HTML = "(SELECT page_id, url, html FROM pages)"
_ENTITIES = "replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


def _listed(pattern: str, flags: str = "s") -> str:
    return f"""SELECT page_id, CAST(i - 1 AS INTEGER) AS "index", found[i] AS content
FROM (SELECT page_id, found, unnest(range(1, len(found) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, {_q(pattern)}, 1, '{flags}') AS found FROM pages))"""


_ANCHORS = f"""SELECT page_id, CAST(i - 1 AS INTEGER) AS "index", {_ENTITIES.format("found[i]")} AS href
FROM (SELECT page_id, found, unnest(range(1, len(found) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]+)"', 1) AS found FROM pages))"""

_SCRIPTS = f"""(SELECT script_id + {CASES} AS script_id, content, regexp_replace(url, '^.*/', '') AS name FROM {table("scripts")}
  UNION ALL SELECT page_id * {SCRIPTS} + "index", content, name FROM ({_listed('<script>(.*?)</script>')}) JOIN (SELECT page_id, {_filename("trim(url)")} AS name FROM pages) USING (page_id))"""

_SECURITY = ", ".join(f"({_q(h)})" for h in V.SECURITY_HEADERS)

ORACLES: dict[str, str] = {
    "html_title_lang": f"""SELECT page_id, trim({_ENTITIES.format("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")}) AS title,
  nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS language, nullif(regexp_extract(html, '<meta charset="([^"]*)"', 1), '') AS charset FROM {_HTML}""",
    "html_comments": f"SELECT page_id, \"index\", trim(content) AS content FROM ({_listed('<!--(.*?)-->')})",
    "inline_scripts": _listed("<script>(.*?)</script>"),
    "page_styles": _listed("<style>(.*?)</style>"),
    "html_anchors": _ANCHORS,
    "url_normalize": f"""SELECT page_id, {_normalized("trim(url)")} AS normalized, regexp_replace({_normalized("trim(url)")}, '#.*$', '') AS asset_key, {_filename("trim(url)")} AS filename FROM pages""",
    "url_host_counts": f"""SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, count(*) AS n_pages, count(DISTINCT {_normalized("trim(url)")}) AS n_urls FROM pages GROUP BY 1""",
    "well_known_targets": f"""SELECT page_id, t AS resource_type, lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)) || p AS url FROM pages, (VALUES {", ".join(f"({_q(n)}, {_q(p)})" for n, p in WELL_KNOWN)}) AS w(t, p)""",
    "duplicate_of": """SELECT doc_id, content_hash, CASE WHEN doc_id <> f THEN f END AS duplicate_of
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS f FROM documents)""",
    "content_hash_dedupe": "SELECT sha256(coalesce(text, '')) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1",
    "sens_email": _values("email"),
    "sens_ip_documents": _values("ipv4"),
    "sens_domain": _values("domain"),
    "sens_domain_pages": _values("domain", "pages", "page_id", "html"),
    "sens_url_pages": _values("external-url", "pages", "page_id", "html"),
    "sens_uuid_conversations": _values("uuid", "conversations", "conv_id", "text"),
    "entropy_tokens": f"""WITH v AS (SELECT doc_id, unnest(regexp_extract_all(text, {_q(ENTROPY_ASSIGNMENT)}, 1, 'i')) AS value FROM documents),
n AS (SELECT row_number() OVER () AS r, doc_id, value FROM v),
c AS (SELECT r, ch, count(*) AS k FROM (SELECT r, unnest(string_split(value, '')) AS ch FROM n) GROUP BY r, ch),
e AS (SELECT c.r, -sum(k / length(value) * log2(k / length(value))) AS entropy FROM c JOIN n USING (r) GROUP BY c.r)
SELECT doc_id, value, round(entropy, 4) AS entropy, CASE WHEN length(value) <= 8 THEN '****' ELSE left(value, 4) || '...' || right(value, 4) END AS shown FROM n JOIN e USING (r) WHERE entropy >= 3.5""",
    "header_presence_matrix": f"""SELECT page_id, h AS header, len(list_filter(map_keys(headers), lambda k: lower(k) = h)) > 0 AS present,
  headers[list_filter(map_keys(headers), lambda k: lower(k) = h)[1]] AS value FROM {table("responses")}, (VALUES {_SECURITY}) AS t(h)""",
    "csp_directives": f"""SELECT page_id, lower(regexp_extract(d, '^(\\S+)', 1)) AS directive, trim(regexp_replace(d, '^\\S+', '')) AS sources
FROM (SELECT page_id, trim(unnest(string_split(headers['Content-Security-Policy'], ';'))) AS d FROM {table("responses")}) WHERE d <> ''""",
    "asset_categories": f"""SELECT id, CASE WHEN hint IS NOT NULL AND hint <> 'unknown' THEN hint
  WHEN lower(filename) IN ({", ".join(map(_q, V.MANIFEST_FILES))}) OR contains(lower(filename), 'manifest') THEN 'manifest'
  WHEN lower(filename) = 'robots.txt' THEN 'text' WHEN lower(filename) = 'sitemap.xml' THEN 'xml'
  WHEN {" OR ".join(f"ends_with(lower(filename), {_q(s)})" for s in V.WORKER_SUFFIXES)} THEN 'worker'
  ELSE coalesce(CASE regexp_extract(lower(filename), '[^./]+(\\.[^./]+)$', 1) {" ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in V.EXTENSION_CATEGORIES.items())} END,
  CASE WHEN mime LIKE 'text/css%' THEN 'css' WHEN mime LIKE 'image/%' THEN 'image' END, CASE WHEN contains(lower(url), 'service-worker') THEN 'service_worker' END, 'unknown') END AS category FROM {table("assets")}""",
    "download_outcomes": f"""SELECT id, CASE WHEN coalesce(ok, false) THEN 'downloaded' WHEN contains(m, 'size limit') OR contains(m, 'exceeds limit') THEN 'skipped' WHEN contains(m, 'timeout') THEN 'timeout'
  WHEN k = 403 THEN 'forbidden' WHEN k = 429 THEN 'rate_limited' ELSE 'failed' END AS outcome
FROM (SELECT id, ok, lower(coalesce(error, '')) AS m, coalesce(status, TRY_CAST(regexp_extract(lower(coalesce(error, '')), '\\b([1-5]\\d\\d)\\b', 1) AS INTEGER)) AS k FROM {table("downloads")})""",
    "evidence_summary": f"SELECT source, evidence_type, count(*) AS n FROM {table('evidence')} GROUP BY 1, 2",
    "version_validate": rf"""SELECT id, v AS normalized, coalesce(regexp_matches(v, '^\d{{1,4}}\.\d{{1,4}}(\.\d{{1,4}})?(-[\w.-]+)?(\+[\w.-]+)?$') AND NOT regexp_matches(v, '^0+\.0+(\.0+)?([-+].*)?$'), false) AS valid
FROM (SELECT id, trim(regexp_replace(regexp_replace(trim(raw), '^["'']+|["'']+$', '', 'g'), '^[vV]', '')) AS v FROM {table("versions")})""",
    "provider_merge": f"""WITH c AS (SELECT page_id, provider, name, trim(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '-', 'g'), '-') AS technology_id, nullif(nullif(version, ''), 'Unknown') AS v, n_evidence,
  CASE provider WHEN 'internal' THEN 0 WHEN 'wappalyzer' THEN 1 WHEN 'retirejs' THEN 2 ELSE 3 END AS r FROM {table("provider_rows")}),
g AS (SELECT page_id, technology_id, arg_min(name, (r, name)) AS name, count(DISTINCT provider) AS n_providers, string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers, CAST(sum(n_evidence) AS BIGINT) AS n_evidence,
  coalesce(arg_min(v, (r, v)) FILTER (WHERE v IS NOT NULL), 'Unknown') AS version, count(DISTINCT v) AS n_versions FROM c GROUP BY 1, 2)
SELECT *, round(least(100.0, CASE WHEN n_providers >= 3 THEN 99.0 WHEN n_providers = 2 THEN 97.0 ELSE 90.0 END + least(5.0, 0.5 * n_evidence) + CASE WHEN version <> 'Unknown' AND n_versions = 1 THEN 5.0 ELSE 0.0 END)::DOUBLE, 2) AS confidence, n_versions > 1 AS version_conflict FROM g""",
    "benchmark_full_outer": f"""SELECT page_id, technology_id, CASE WHEN a.technology_id IS NOT NULL AND b.technology_id IS NOT NULL THEN 'both' WHEN a.technology_id IS NOT NULL THEN 'ours' ELSE 'theirs' END AS detected_by,
  a.version AS left_version, b.version AS right_version, CASE WHEN a.version <> 'Unknown' AND b.version <> 'Unknown' THEN a.version = b.version END AS version_match
FROM {table("ours")} AS a FULL OUTER JOIN {table("theirs")} AS b USING (page_id, technology_id)""",
    "benchmark_pr": f"""WITH m AS (SELECT a.technology_id AS l, b.technology_id AS r, CASE WHEN a.version <> 'Unknown' AND b.version <> 'Unknown' THEN a.version = b.version END AS e FROM {table("ours")} AS a FULL OUTER JOIN {table("theirs")} AS b USING (page_id, technology_id)),
c AS (SELECT count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL) AS "both", count(*) FILTER (WHERE r IS NULL) AS left_only, count(*) FILTER (WHERE l IS NULL) AS right_only, count(*) FILTER (WHERE e) AS ve, count(e) AS vk FROM m)
SELECT "both", left_only, right_only, round("both" / ("both" + left_only), 4) AS precision, round("both" / ("both" + right_only), 4) AS recall, round(("both" + left_only) / ("both" + left_only + right_only), 4) AS coverage, round(100 * ve / vk, 2) AS version_match_rate FROM c""",
    "regression_metrics": f"""WITH s AS (SELECT CAST(sum(len(list_intersect(expected, found))) AS BIGINT) AS tp, CAST(sum(len(list_filter(found, lambda x: NOT list_contains(expected, x)))) AS BIGINT) AS fp, CAST(sum(len(list_filter(expected, lambda x: NOT list_contains(found, x)))) AS BIGINT) AS fn FROM {table("samples")})
SELECT tp, fp, fn, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 4) AS f1 FROM s""",
    "relationships": f"""SELECT a.page_id, k.t AS technology, k.o AS stands_on, k.k AS kind FROM {table("detections")} AS a JOIN (VALUES {", ".join(f"({_q(a)}, {_q(b)}, {_q(c)})" for a, b, c in RELATIONSHIPS)}) AS k(t, o, k) ON a.technology = k.t
JOIN {table("detections")} AS b ON b.page_id = a.page_id AND b.technology = k.o""",
    "report_groups": f"""SELECT category, count(*) AS n, count(*) FILTER (WHERE version <> 'Unknown') AS known_versions, count(*) FILTER (WHERE version = 'Unknown') AS unknown_versions, string_agg(DISTINCT technology, ', ' ORDER BY technology) AS technologies FROM {table("detections")} GROUP BY 1""",
    "report_csv": f"""SELECT technology, category, version, printf('%.2f', confidence) AS confidence, coalesce(filename, '') AS filename, array_to_string(evidence, '; ') AS evidence FROM {table("detections")}""",
    "provider_import": f"""SELECT page_id, t->>'$.name' AS name, t->>'$.version' AS version, CAST(t->>'$.confidence' AS DOUBLE) AS confidence FROM (
  SELECT page_id, unnest(CASE WHEN json[1] = '[' THEN json_extract(json, '$[*]') WHEN json_exists(json, '$.technologies') THEN json_extract(json, '$.technologies[*]') ELSE json_extract(json, '$.*.technologies[*]') END) AS t FROM {table("provider_json")} WHERE json_valid(json)) WHERE t->>'$.name' IS NOT NULL""",
    "js_duplicates": f"""SELECT script_id, h AS content_hash, CASE WHEN script_id <> f THEN f END AS duplicate_of FROM (SELECT script_id, sha256(coalesce(content, '')) AS h, min(script_id) OVER (PARTITION BY sha256(coalesce(content, ''))) AS f FROM {_SCRIPTS})""",
}
# Every anchor of the synthetic pages is a path from the root.
_ASSETS = f"""SELECT regexp_replace({_normalized("u")}, '#.*$', '') AS asset_key, page_id FROM (SELECT a.page_id, regexp_extract(trim(p.url), '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1) || a.href AS u FROM ({_ANCHORS}) AS a JOIN pages AS p USING (page_id))"""
_CATEGORY = f"""CASE WHEN contains(lower(filename), 'manifest') THEN 'manifest' ELSE coalesce(CASE regexp_extract(lower(filename), '[^./]+(\\.[^./]+)$', 1) {" ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in V.EXTENSION_CATEGORIES.items())} END, 'unknown') END"""
ORACLES["anchor_inventory"] = f"""SELECT *, {_CATEGORY} AS category FROM (SELECT asset_key, count(*) AS n_references, count(DISTINCT page_id) AS n_pages, 'anchor' AS sources, {_filename("asset_key")} AS filename FROM ({_ASSETS}) GROUP BY asset_key)"""
ORACLES["asset_category_summary"] = f"SELECT category, count(*) AS n_assets, CAST(sum(n_references) AS BIGINT) AS n_references FROM ({ORACLES['anchor_inventory']}) GROUP BY 1"

# Names of technologies in addresses of pages, of what they link to, and of cases.
_OWNER_ASSETS = f"""(SELECT url, {_filename("trim(url)")} AS filename FROM pages UNION ALL SELECT asset_key, {_filename("trim(asset_key)")} FROM (SELECT DISTINCT asset_key FROM ({_ASSETS})) UNION ALL SELECT url, filename FROM {table("owner_assets")})"""
_OWNER_NAMES = f"""(SELECT technology, unnest([technology, replace(technology, '-', ''), replace(technology, '-', '.')] || CASE technology WHEN 'nextjs' THEN ['next'] WHEN 'react' THEN ['react-dom', 'reactdom'] WHEN 'material-ui' THEN ['mui', '@mui'] ELSE [] END) AS name
  FROM (VALUES {", ".join(f"({_q(t)})" for t in sorted({f[0] for f in FINGERPRINTS}))}) AS t(technology))"""
ORACLES["asset_owners"] = f"""SELECT asset_key, technology, max(affinity) AS affinity FROM (
  SELECT regexp_replace({_normalized("trim(url)")}, '#.*$', '') AS asset_key, technology,
    CAST(CASE WHEN length(name) < 2 THEN 0 WHEN contains(lower(coalesce(filename, '')), name) THEN 95
      WHEN contains(lower(url), '/' || name) OR contains(lower(url), name || '@') OR contains(lower(url), name || '-') THEN 90
      WHEN contains(lower(url), name) THEN 75 ELSE 0 END AS DOUBLE) AS affinity
  FROM {_OWNER_ASSETS} AS a, {_OWNER_NAMES} AS n WHERE url IS NOT NULL) WHERE affinity > 0 GROUP BY 1, 2"""
# Scripts of the synthetic pages show no technology: rows of the cases only, by hand.
ORACLES["evidence_owners"] = f"""SELECT CAST(p + {CASES} AS BIGINT) AS page_id, evidence_id, technology, ownership, CAST(confidence AS DOUBLE) AS confidence, basis, relevant, confirms FROM (VALUES
  (1, 'a', 'react', 'OWNED', 98, 'technology_field', TRUE, TRUE), (1, 'b', 'react', 'OWNED', 95, 'metadata_technology', TRUE, TRUE), (1, 'c', 'vue', 'OWNED', 95, 'metadata_technology', TRUE, TRUE),
  (1, 'd', 'vue', 'OWNED', 90, 'runtime_family', TRUE, TRUE), (1, 'e', 'react', 'OWNED', 82, 'package_hint', TRUE, TRUE), (1, 'f', 'react', 'ASSOCIATED', 72, 'matched_detection_evidence', TRUE, TRUE),
  (1, 'g', 'react', 'INCIDENTAL', 20, 'matched_evidence_version_candidate', FALSE, FALSE), (1, 'h', 'react', 'OWNED', 55, 'value_hint', TRUE, FALSE),
  (3, 'j', 'material-ui', 'OWNED', 55, 'value_hint', TRUE, FALSE), (3, 'k', 'nextjs', 'OWNED', 82, 'package_hint', TRUE, TRUE)) AS v(p, evidence_id, technology, ownership, confidence, basis, relevant, confirms)"""
ORACLES["version_scopes"] = f"SELECT CAST(p + {CASES} AS BIGINT) AS page_id, technology, CAST(a + {CASES} AS BIGINT) AS asset_id FROM (VALUES (1, 'jquery', 1), (1, 'jquery', 2), (2, 'react', 4), (2, 'vue', 4), (2, 'vue', 5), (3, 'lodash', 6)) AS v(p, technology, a)"
ORACLES["version_extracted"] = f"""SELECT CAST(p + {CASES} AS BIGINT) AS page_id, technology, version, source, CAST(priority AS DOUBLE) AS priority, CAST(ownership_confidence AS DOUBLE) AS ownership_confidence, basis, CAST(bonus AS DOUBLE) AS bonus, preferred, confirmable FROM (VALUES
  (1, 'jquery', '3.6.0', 'banner', 80, 95, 'js_asset_affinity', 20, FALSE, TRUE), (1, 'jquery', '1.4.0', 'banner', 80, 70, 'js_extractor_low_affinity', -2, FALSE, TRUE),
  (2, 'react', '18.2.0', 'runtime', 95, 95, 'js_self_proving_method', 6, TRUE, TRUE)) AS v(p, technology, version, source, priority, ownership_confidence, basis, bonus, preferred, confirmable)"""
ORACLES["version_resolved"] = f"SELECT CAST(p + {CASES} AS BIGINT) AS page_id, technology, version, conflict, alternates FROM (VALUES (1, 'jquery', '3.6.0', 'WEAK_ALTERNATE', '1.4.0'), (2, 'react', '18.2.0', 'NO_CONFLICT', '')) AS v(p, technology, version, conflict, alternates)"
ORACLES["technology_records"] = """SELECT CAST(page_id AS BIGINT) AS page_id, CAST(confidence AS DOUBLE) AS confidence, technology, name, evidence_type, pattern, text, url, source_file, asset_id, discovery, first_position FROM (VALUES
  (1, 85, 'react', 'React', 'runtime_constant', 'React.version', '19.3.0', 'https://example.com/static/framework.js', 'framework.js', 'asset-framework', 'html', 0),
  (1, 85, 'react', 'React', 'runtime_constant', 'React.version', '19.3.0', 'https://example.com/static/vendor.js', 'vendor.js', 'asset-vendor', 'network', 0),
  (1, 40, 'React', 'React', 'pattern_match', 'React.createElement', 'React.createElement', 'https://example.com/z.js', 'z.js', NULL, 'unknown', 5),
  (1, 40, 'React', 'React', 'pattern_match', 'React.createElement', 'React.createElement', 'https://example.com/v.js', 'vendor.js', 'asset-vendor', 'network', 5),
  (1, 80, 'nextjs', 'Next.js', 'pattern_match', NULL, '', NULL, 'build-manifest.js', NULL, 'unknown', 3),
  (3, 30, 'vue', 'Vue', 'pattern_match', 'Vue.createApp', 'Vue.createApp', 'https://c.example/a.js', 'a.js', NULL, 'unknown', 0),
  (3, 30, 'vue', 'Vue', 'pattern_match', 'Vue.createApp', 'Vue.createApp', 'https://c.example/b.js', 'b.js', NULL, 'unknown', 0),
  (3, 30, 'vue', 'Vue', 'pattern_match', 'Vue.createApp', 'Vue.createApp', 'https://c.example/c.js', 'c.js', NULL, 'unknown', 0)) AS v(page_id, confidence, technology, name, evidence_type, pattern, text, url, source_file, asset_id, discovery, first_position)"""
# React: 85 and 3 for a second file, 1 for a second record; merged: 9 for four files, 3 for four records, beyond 100.
ORACLES["technology_entries"] = """SELECT CAST(page_id AS BIGINT) AS page_id, technology, name, version, CAST(confidence AS DOUBLE) AS confidence, CAST(n_files AS BIGINT) AS n_files, CAST(n_records AS BIGINT) AS n_records, CAST(n_assets AS BIGINT) AS n_assets, files, methods, CAST(n_relationships AS BIGINT) AS n_relationships FROM (VALUES
  (1, 'react', 'React', '19.3.0', 100, 4, 4, 2, 'framework.js,v.js,vendor.js,z.js', 'global,string', 0), (1, 'nextjs', 'Next.js', 'Unknown', 80, 1, 1, 0, 'build-manifest.js', '', 1),
  (3, 'vue', 'Vue', '3.4.0', 100, 3, 3, 0, 'a.js,b.js,c.js', 'string', 0)) AS v(page_id, technology, name, version, confidence, n_files, n_records, n_assets, files, methods, n_relationships)"""


# The synthetic sheets show none: rows of the cases only, by hand.
_STYLES = f"""SELECT CAST(s + {CASES} AS BIGINT) AS style_id, family, kind, value, version, CAST(n AS BIGINT) AS n, CAST(confidence AS DOUBLE) AS confidence FROM (VALUES
  (1, 'bootstrap', 'banner', '/*!' || chr(10) || '  Bootstrap v5.3.2', '5.3.2', NULL, 90), (1, 'bootstrap', 'package_path', 'bootstrap', NULL, NULL, 75), (1, 'bootstrap', 'package_path', 'Bootstrap', NULL, NULL, 75),
  (2, 'bootstrap', 'asset', 'Bootstrap.Bundle.min.css', NULL, NULL, 85), (2, 'cloudflare', 'cdn_path', '/cdn-cgi/', NULL, NULL, 85),
  (3, 'tailwindcss', 'directive', '@tailwind base', NULL, NULL, 90), (3, 'tailwindcss', 'directive', '@tailwind  base', NULL, NULL, 90), (3, 'tailwindcss', 'directive', '@TAILWIND utilities', NULL, NULL, 90),
  (3, 'tailwindcss', 'css_variables', '--tw-*', NULL, 3, 80), (3, 'tailwindcss', 'banner', '/* tailwindcss v3.4.1', '3.4.1', NULL, 90), (4, 'tailwindcss', 'package_path', 'tailwindcss', NULL, NULL, 75),
  (5, 'bootstrap', 'asset', 'bootstrap.css', NULL, NULL, 85)) AS v(s, family, kind, value, version, n, confidence)"""
ORACLES["style_evidence"] = _STYLES
ORACLES["style_identities"] = f"SELECT style_id AS page_id, 'css:' || style_id || ':' || family || ':' || value AS evidence_id, family AS identity FROM ({_STYLES})"

# Scripts of pages as contexts, and cases.
_CONTEXTS = f"""(SELECT page_id + {CASES} AS page_id, ctx_id, url, filename, content, source_map_url FROM {table("contexts")}
  UNION ALL SELECT page_id, page_id * {SCRIPTS} + "index", url, NULL, content, NULL FROM ({_listed('<script>(.*?)</script>')}) JOIN (SELECT page_id, url FROM pages) USING (page_id))"""


def _pattern(p: Pattern) -> str:
    """The condition of a fingerprint's pattern on a context."""
    text, name, url, low = "coalesce(content, '')", "lower(coalesce(filename, ''))", "lower(coalesce(url, ''))", p.pattern.lower()
    has = lambda x, y: f"contains({x}, {_q(y)})"
    matches = lambda x, y, flags="c": f"regexp_matches({x}, {_q(y)}, '{flags}')"
    if p.matcher == "string":
        return has(text, p.pattern)
    if p.matcher == "regex":
        return matches(text, p.pattern, "i" if "i" in p.flags else "c")
    if p.matcher == "filename":
        if low.startswith("re:"):
            return f"({matches(name, low[3:], 'i')} OR {matches(url, low[3:], 'i')})"
        more = {"chunk": ["webpack"], "vendor": list(BUNDLE_HINTS), "bundle": list(BUNDLE_HINTS)}.get(low, [])
        return "(" + " OR ".join(has(x, y) for x in (name, url) for y in [low, *more]) + ")"
    if p.matcher == "sourcemap":
        both = f"concat_ws(chr(10), source_map_url, {text})"
        found = matches(both, p.pattern[3:], "i") if p.pattern.startswith("re:") else has(f"lower({both})", low)
        return f"((source_map_url IS NOT NULL OR {has(text, 'sourceMappingURL=')}) AND {found})"
    if len(p.pattern.strip()) <= 2:
        return "false"
    n = re.escape(p.pattern)
    found = [matches(text, rf"\b(?:var|let|const)\s+{n}\b|\b(?:window|self|globalThis)\.{n}\b|\b{n}\s*[.=]")]
    found += [has(text, p.pattern)] if p.pattern in BOOTSTRAP_MARKERS else []
    found += [has(text, m) for m in {"webpackBootstrap": ("__webpack_require__", "webpackJsonp"), "viteBootstrap": ("__vite__", "import.meta.hot")}.get(p.pattern, ())]
    return "(" + " OR ".join(found) + ")"


def _struct(**values: str) -> str:
    return "{" + ", ".join(f"'{k}': {v}" for k, v in values.items()) + "}"


def _each_of(source: str, key: str, items: list[tuple[str, str]]) -> str:
    """The structs (as lists) whose conditions hold, one row each."""
    return f"SELECT {key}, unnest(list_filter([" + ", ".join(f"CASE WHEN {c} THEN {v} END" for c, v in items) + f"], lambda x: x IS NOT NULL)) AS m FROM {source}"


_FP = [(_pattern(p), _struct(technology=_q(p.technology), matcher=_q(p.matcher), pattern=_q(p.pattern), weight=f"{p.weight}::DOUBLE", tier=_q(evidence_tier(p.matcher, p.pattern, p.weight)), strong=str(strong_pattern(p.matcher, p.pattern)), weak=str(weak_pattern(p.matcher, p.pattern)))) for p in fingerprint_patterns()]
ORACLES["fp_matches"] = f"SELECT page_id, ctx_id, m.technology, m.matcher, m.pattern, m.weight, m.tier FROM ({_each_of(_CONTEXTS, 'page_id, ctx_id', _FP)})"

_VERSION = r"^\d{1,4}\.\d{1,4}(\.\d{1,4})?(-[\w.-]+)?(\+[\w.-]+)?$"
_plain = lambda raw: f"trim(regexp_replace(regexp_replace(trim({raw}), '^[\"'']+|[\"'']+$', '', 'g'), '^[vV]', ''))"
_is_version = lambda v: f"(regexp_matches({v}, {_q(_VERSION)}) AND NOT regexp_matches({v}, '^0+\\.0+(\\.0+)?([-+].*)?$'))"
_TEXT = "coalesce(content, '')"
_JS = [(f"regexp_matches({_TEXT}, {_q(p)})", _struct(t=_q(kind), k=_q(k), l=_q(n), v=f"regexp_extract({_TEXT}, {_q(p)}, 0)")) for kind, patterns in (("runtime_pattern", JS_RUNTIME_PATTERNS), ("bundle_runtime", JS_BUNDLE_PATTERNS)) for k, n, p in patterns]
_JS += [(_is_version(_plain(f"regexp_extract({_TEXT}, {_q(p)}, 1)")), _struct(t="'version_candidate'", k=_q(k), l=_q(n), v=_plain(f"regexp_extract({_TEXT}, {_q(p)}, 1)"))) for k, n, p in JS_VERSION_PATTERNS]
ORACLES["js_evidence"] = f"SELECT script_id, m.t AS evidence_type, m.k AS key, m.l AS label, m.v AS value FROM ({_each_of(_SCRIPTS, 'script_id', _JS)})"

_HITS = " UNION ALL ".join(f"SELECT script_id, {_q(t)} AS technology, {_q(m)} AS method, {METHOD_WEIGHTS.get(m, 60.0)}::DOUBLE AS weight, unnest(regexp_extract_all({_TEXT}, {_q(p)}, 1)) AS raw FROM {_SCRIPTS}" for t, m, p in VERSION_PATTERNS)
ORACLES["js_versions"] = f"SELECT DISTINCT script_id, technology, method, {_plain('raw')} AS version, weight FROM ({_HITS}) WHERE {_is_version(_plain('raw'))}"

_HEAD = "concat_ws(chr(10), name, substr(content, 1, 8192))"
_LINES = f"len(string_split({_TEXT}, chr(10)))"
_named = lambda p: f"regexp_matches(lower(name), {_q(p)})"
_CHUNK = r"(?i)chunk[-.]?([\w-]+)|([\w-]+)\.chunk"
ORACLES["js_kinds"] = f"""SELECT script_id, CASE {" ".join(f"WHEN regexp_matches({_HEAD}, {_q(p)}) THEN {_q(n)}" for n, p in J.BUNDLER_MARKS)} ELSE 'unknown' END AS bundler,
  CASE WHEN {_named(J.WORKER_NAME)} THEN 'worker' WHEN {_named(J.ENTRY_NAME)} THEN 'entry_bundle' WHEN {_named(J.RUNTIME_NAME)} THEN 'runtime_bundle' WHEN {_named(J.VENDOR_NAME)} THEN 'vendor_bundle'
  WHEN {_named(J.FRAMEWORK_NAME)} THEN 'framework_bundle' WHEN {_named(J.CHUNK_NAME)} THEN CASE WHEN contains(lower(name), 'lazy') THEN 'lazy_chunk' ELSE 'dynamic_chunk' END ELSE 'application_bundle' END AS kind,
  coalesce(nullif(regexp_extract(name, {_q(_CHUNK)}, 1), ''), nullif(regexp_extract(name, {_q(_CHUNK)}, 2), '')) AS chunk,
  CASE WHEN CASE WHEN {_LINES} <= 1 THEN length({_TEXT}) > 500 ELSE {_LINES} <= 50 AND (length({_TEXT}) - ({_LINES} - 1)) / {_LINES} >= 180 END THEN 'minified' ELSE 'readable' END AS shape FROM {_SCRIPTS}"""

ORACLES["rule_findings"] = f"""SELECT page_id, analyzer, category, title, severity, confidence, evidence, url AS location FROM (
  SELECT page_id, url, 'rule:has-react' AS analyzer, 'TECHNOLOGY' AS category, 'React used' AS title, 'LOW' AS severity, 80.0::DOUBLE AS confidence, 'React.createElement' AS evidence FROM {_CONTEXTS} WHERE contains(content, 'React.createElement')
  UNION ALL SELECT page_id, url, 'rule:version-set', 'INFORMATION', 'Version set', 'INFO', 100.0, regexp_extract(content, '(\\w+)\\.version\\s*=\\s*"[\\d.]+"', 0) FROM {_CONTEXTS} WHERE regexp_matches(content, '(\\w+)\\.version\\s*=\\s*"[\\d.]+"')
  UNION ALL SELECT page_id, url, 'rule:bundle-name', 'INFORMATION', 'Bundle', 'INFO', 100.0, regexp_extract(filename, '(?i)bundle', 0) FROM {_CONTEXTS} WHERE regexp_matches(filename, '(?i)bundle'))"""

# The synthetic pages have a title, a language and comments, but no other metadata: SQL says so for those kinds.
_ABSENT = (("opengraph-analyzer", "No OpenGraph property"), ("twitter-card-analyzer", "No Twitter card property"), ("canonical-link-analyzer", "No Canonical link"), ("alternate-link-analyzer", "No Alternate link"), ("favicon-analyzer", "No Icon"), ("web-app-manifest-analyzer", "No Web app manifest"), ("framework-metadata-analyzer", "No Framework hint"), ("service-worker-analyzer", "No Service worker"), ("sourcemap-analyzer", "No Source map"), ("application-metadata-analyzer", "Application name missing"), ("generator-meta-analyzer", "Generator missing"), ("theme-color-analyzer", "Theme color missing"))
_told = lambda analyzer, what, value: f"SELECT page_id, {_q(analyzer)} AS analyzer, CASE WHEN coalesce(trim({value}), '') <> '' THEN '{what}: ' || trim({value}) ELSE '{what} missing' END AS title, {value} AS evidence FROM ({ORACLES['html_title_lang']})"
ORACLES["page_findings"] = f"""SELECT page_id, analyzer, 'METADATA' AS category, title, 'INFO' AS severity, 100.0::DOUBLE AS confidence, evidence, url AS location FROM (
  {_told("html-metadata-analyzer", "Title", "title")} UNION ALL {_told("language-analyzer", "Language", "language")}
  UNION ALL SELECT page_id, 'html-comment-analyzer', 'HTML comment: ' || content, content FROM ({ORACLES["html_comments"]})
  UNION ALL SELECT page_id, 'html-comment-analyzer', 'No HTML comment', NULL FROM pages WHERE NOT contains(html, '<!--')
  UNION ALL SELECT page_id, a, t, NULL FROM pages, (VALUES {", ".join(f"({_q(a)}, {_q(t)})" for a, t in _ABSENT)}) AS v(a, t)) JOIN (SELECT page_id, url FROM pages) USING (page_id)"""
_FINDINGS = f"({ORACLES['page_findings']})"
for _by in ("category", "analyzer", "severity"):
    ORACLES[f"finding_stats_by_{_by}"] = f"SELECT {_by}, count(*) AS n, round(avg(confidence), 2) AS avg_confidence, max(confidence) AS max_confidence FROM {_FINDINGS} GROUP BY 1"
ORACLES["finding_statistics"] = " UNION ALL ".join(f"SELECT '{d}' AS dimension, {c} AS value, count(*) AS n FROM {_FINDINGS} GROUP BY 2" for d, c in (("category", "category"), ("severity", "severity"), ("analyzer", "analyzer"), ("all", "'all'")))
ORACLES["sarif_rows"] = f"""SELECT analyzer AS rule_id, CAST(to_json({{'ruleId': analyzer, 'level': 'note', 'message': {{'text': title}}, 'locations': [{{'physicalLocation': {{'artifactLocation': {{'uri': coalesce(location, '')}}}}}}]}}) AS VARCHAR) AS result FROM {_FINDINGS}"""

_URL = r"^[A-Za-z][A-Za-z0-9+.\-]*://"
_FULL = _normalized(f"CASE WHEN regexp_matches(trim(url), {_q(_URL)}) THEN trim(url) ELSE 'https://' || trim(url) END")
ORACLES["url_cases"] = f"""SELECT id, {_normalized("trim(url)")} AS normalized, CASE WHEN regexp_matches({_FULL}, '^https?://[^/?#]+') THEN {_FULL} END AS valid, {_filename("trim(url)")} AS filename FROM {table("urls")}"""
ORACLES["http_evidence"] = f"""SELECT page_id, 'http_header' AS evidence_type, h.value AS value, lower(trim(h.key)) AS header FROM (SELECT page_id, unnest(map_entries(headers)) AS h FROM {table("responses")})
UNION ALL SELECT page_id, 'http_metadata', CAST(status_code AS VARCHAR), 'status' FROM {table("responses")}"""
_VERSIONS = _each_of(_CONTEXTS, "page_id, ctx_id", [(_is_version(_plain(f"regexp_extract({_TEXT}, {_q(p.pattern)}, 1)")), _struct(t=_q(p.technology), c=f"{p.weight * VERSION_MULTIPLIERS.get(p.matcher, 1.0)}::DOUBLE", w=f"{p.weight}::DOUBLE", v=_plain(f"regexp_extract({_TEXT}, {_q(p.pattern)}, 1)"))) for p in version_patterns()])
ORACLES["fp_versions"] = f"SELECT page_id, ctx_id, m.t AS technology, arg_max(m.v, {{'c': m.c, 'w': m.w, 'v': m.v}}) AS version, arg_max(m.w, {{'c': m.c, 'w': m.w, 'v': m.v}}) AS version_weight FROM ({_VERSIONS}) GROUP BY 1, 2, 3"
_SHARE = "CASE m.matcher " + " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in V.MATCHER_MULTIPLIERS.items()) + " ELSE 1.0 END"
_PRIOR = "CASE technology " + " ".join(f"WHEN {_q(t)} THEN {c}" for t, _, _, c, _, _ in FINGERPRINTS) + " ELSE 0 END"
_SCORES = f"""WITH f AS (SELECT page_id, ctx_id, m.technology AS technology, sum(m.weight * {_SHARE}) AS raw, count(*) AS n, count(*) FILTER (WHERE m.strong) AS n_strong, count(*) FILTER (WHERE m.weak) AS n_weak,
    count(*) FILTER (WHERE m.tier = 'high') AS n_high, count(*) FILTER (WHERE m.tier <> 'low') AS n_medium_high, count(*) FILTER (WHERE m.matcher = 'filename') AS n_filename
  FROM ({_each_of(_CONTEXTS, 'page_id, ctx_id', _FP)}) GROUP BY 1, 2, 3),
v AS ({ORACLES["fp_versions"]}),
b AS (SELECT f.*, version, least(100.0, least(100.0, raw * 1.15) + CASE WHEN version IS NULL THEN 0 ELSE least(20.0, version_weight * 0.6) END)::DOUBLE AS base FROM f LEFT JOIN v USING (page_id, ctx_id, technology)),
d AS (SELECT *, CASE WHEN n >= 2 THEN least(100.0, base * 1.08) ELSE base END::DOUBLE AS several FROM b),
j AS (SELECT *, CASE WHEN n_strong >= 2 THEN least(100.0, several * 1.12) WHEN n_strong = 1 THEN least(100.0, several * 1.08) WHEN n = 1 AND n_filename = 1 THEN several * 0.65 WHEN n = 1 AND n_weak = 1 THEN several * 0.4 ELSE several END::DOUBLE AS judged FROM d)
SELECT page_id, ctx_id, technology, coalesce(version, 'Unknown') AS version, n, n_weak, n_high, n_medium_high, round(greatest(0.0, least(100.0, judged * 0.82::DOUBLE + ({_PRIOR})::DOUBLE * 0.18::DOUBLE)), 2)::DOUBLE AS confidence FROM j"""
ORACLES["fp_score"] = f"SELECT page_id, ctx_id, technology, version, n, confidence FROM ({_SCORES})"
ORACLES["fp_detect"] = f"""SELECT page_id, technology, version, confidence, contexts, confidence >= 50 AND (version <> 'Unknown' OR high > 0 OR (not_weak > 0 AND (medium_high >= 2 OR (medium_high = 1 AND confidence >= 70)))) AS confirmed
FROM (SELECT page_id, technology, coalesce(arg_max(version, {{'c': confidence, 'x': ctx_id}}) FILTER (WHERE version <> 'Unknown'), 'Unknown') AS version, round(least(100.0, max(confidence) + least(10.0, 2.0 * (count(*) - 1))), 1)::DOUBLE AS confidence, count(*) AS contexts,
    max(n_high) AS high, max(n_medium_high) AS medium_high, max(n - n_weak) AS not_weak FROM ({_SCORES}) WHERE confidence >= 45 GROUP BY 1, 2)"""
ORACLES["sitemap_lines"] = f"SELECT id, unnest(regexp_extract_all(text, '(?im)^Sitemap:\\s*(\\S+)', 1)) AS url FROM {table('robots')}"
_bare = lambda found: f"list_transform({found}, lambda x: regexp_replace(trim(x), '^[''\"]|[''\"]$', '', 'g'))"
_URLS, _IMPORTS = _q(r"(?i)url\(\s*([^)]+?)\s*\)"), _q(r"(?i)@import\s+(['\"][^'\"]+['\"])")
_CSS = f"list_concat({_bare(f'regexp_extract_all(css, {_URLS}, 1)')}, {_bare(f'regexp_extract_all(css, {_IMPORTS}, 1)')})"
ORACLES["css_references"] = f"""SELECT id, CAST(i - 1 AS INTEGER) AS "index", found[i] AS url FROM (SELECT id, found, unnest(range(1, len(found) + 1)) AS i FROM (SELECT id, {_CSS} AS found FROM {table("styles")}))"""
_MAPS = _q(r"sourceMappingURL=([^\s\"']+)")
ORACLES["source_map_references"] = f"SELECT script_id, regexp_replace(list_last(m), '[*/;,]+$', '') AS url FROM (SELECT script_id, regexp_extract_all(content, {_MAPS}, 1) AS m FROM {_SCRIPTS}) WHERE len(m) > 0"
ORACLES["manifest_references"] = f"""SELECT id, url FROM (SELECT id, unnest(list_concat(json_extract_string(text, '$.icons[*].src'), json_extract_string(text, '$.screenshots[*].src'), json_extract_string(text, '$.shortcuts[*].icons[*].src'))) AS url
FROM {table("manifests")} WHERE json_valid(text)) WHERE url IS NOT NULL"""
ORACLES["confidence_levels"] = f"SELECT page_id, technology, CASE WHEN confidence >= 95 THEN 'very_high' WHEN confidence >= 80 THEN 'high' WHEN confidence >= 60 THEN 'medium' ELSE 'low' END AS level FROM {table('detections')}"
ORACLES["version_priorities"] = f"SELECT page_id, technology, version, source, CASE source {' '.join(f'WHEN {_q(k)} THEN {v}' for k, v in V.VERSION_SOURCE_PRIORITIES.items())} ELSE 30 END::DOUBLE AS source_priority FROM {table('version_candidates')}"
ORACLES["best_versions"] = f"SELECT page_id, technology, version, confidence, weight FROM (SELECT *, row_number() OVER (PARTITION BY page_id, technology ORDER BY confidence DESC, weight DESC, version) AS p FROM {table('ranked')}) WHERE p = 1"
_KINDS = ", ".join(f"({_q(t)}, {_q(a)})" for a, t in WELL_KNOWN_ANALYZERS.items())
ORACLES["well_known_findings"] = f"""SELECT page_id, a AS analyzer, 'METADATA' AS category, t || CASE WHEN there THEN ' present' ELSE ' missing' END AS title, 'INFO' AS severity, 100.0::DOUBLE AS confidence, CAST(NULL AS VARCHAR) AS evidence, u AS location
FROM (SELECT p.page_id, t, a, coalesce(bool_or(o.available), false) AS there, min(o.url) FILTER (WHERE o.available) AS u FROM (SELECT DISTINCT page_id FROM {table("observed")}) AS p CROSS JOIN (VALUES {_KINDS}) AS k(t, a) LEFT JOIN {table("observed")} AS o ON o.page_id = p.page_id AND o.resource_type = t GROUP BY 1, 2, 3)"""
# Worked out by hand: of what falls below 85, page 3's react comes back, as its nextjs stands on it; page 1's has it.
ORACLES["dependency_addback"] = "SELECT page_id::BIGINT AS page_id, technology, confidence::DOUBLE AS confidence FROM (VALUES (1, 'nextjs', 96.5), (1, 'react', 91.25), (2, 'nuxt', 88.0), (2, 'vue', 88.0), (3, 'nextjs', 90.0), (3, 'react', 50.0)) AS v(page_id, technology, confidence)"
# Worked out by hand: vue falls to nuxt, and so displaces angularjs no more.
ORACLES["conflict_removal"] = "SELECT page_id::BIGINT AS page_id, technology, confidence::DOUBLE AS confidence FROM (VALUES (1, 'nextjs', 96.5), (1, 'react', 91.25), (2, 'nuxt', 88.0), (2, 'vue', 88.0), (3, 'nextjs', 90.0), (3, 'vue', 55.0), (3, 'react', 50.0)) AS v(page_id, technology, confidence)"
ORACLES["cookie_attributes"] = """SELECT page_id::BIGINT AS page_id, CAST(i AS INTEGER) AS "index", name, value, CAST(NULL AS VARCHAR) AS domain, path, CAST(NULL AS VARCHAR) AS expires, samesite, CAST(NULL AS VARCHAR) AS priority, max_age, secure, httponly, false AS partitioned, host_prefix, CAST(NULL AS VARCHAR) AS secure_prefix, raw
FROM (VALUES (1, 0, 'session', 'abc', '/', NULL, NULL, true, true, NULL, 'session=abc; Path=/; Secure; HttpOnly'), (1, 1, '__Host-id', '7', '/', 'Lax', 60, true, false, '__Host-', '__Host-id=7; Path=/; Secure; SameSite=Lax; Max-Age=60'),
  (3, 0, 'flag', '', NULL, NULL, NULL, false, false, NULL, 'flag')) AS v(page_id, i, name, value, path, samesite, max_age, secure, httponly, host_prefix, raw)"""
# Worked out by hand from the rules: scores of page 2 are 72 and 72.75, of different sources; page 3 can't confirm, and 0.0.0 is no version.
ORACLES["version_primary"] = "SELECT page_id::BIGINT AS page_id, technology, version, conflict, alternates FROM (VALUES (1, 'react', '18.2.0', 'WEAK_ALTERNATE', '17.0.2'), (2, 'vue', 'Unknown', 'AMBIGUOUS', '3.3.1,3.4.0'), (3, 'jquery', 'Unknown', 'WEAK_ONLY', '3.7.1'), (4, 'axios', '1.4.0', 'WEAK_ALTERNATE', '1.6.0'), (5, 'lodash', 'Unknown', 'STRONG_CONFLICT', '4.0.0,4.17.21')) AS v(page_id, technology, version, conflict, alternates)"

_LINES = _q(r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]")
_USER, _PASSWORD = _q(S.USER_ASSIGNMENT), _q(S.PASSWORD_ASSIGNMENT)
ORACLES["assigned_pairs"] = f"""WITH texts AS (SELECT doc_id AS page_id, text FROM documents UNION ALL SELECT page_id + {CASES}, text FROM {table('assignments')}),
whole AS (SELECT page_id, regexp_split_to_array(text, {_LINES}) AS lines FROM texts),
seen AS (SELECT page_id, line, nullif(regexp_extract(one, {_USER}, 1), '') AS u, nullif(regexp_extract(one, {_PASSWORD}, 1), '') AS p FROM (SELECT page_id, unnest(lines) AS one, generate_subscripts(lines, 1) AS line FROM whole)),
met AS (SELECT a.page_id, a.u, a.line AS user_line, min(b.line) AS password_line, arg_min(b.p, b.line) AS p FROM seen a JOIN seen b ON a.page_id = b.page_id AND abs(a.line - b.line) <= {S.NEAR_LINES} WHERE a.u IS NOT NULL AND b.p IS NOT NULL GROUP BY ALL)
SELECT page_id, u AS user, p AS password, user_line::INTEGER AS user_line, password_line::INTEGER AS password_line, least(user_line, password_line)::INTEGER AS line,
    array_to_string(lines[least(user_line, password_line) : greatest(user_line, password_line)], chr(10))[1:200] AS evidence FROM met JOIN whole USING (page_id)"""


_SOURCES = f"""(SELECT script_id + {CASES} AS script_id, coalesce(content, '') AS c FROM {table("script_sources")}
  UNION ALL SELECT page_id * {SCRIPTS} + "index", content FROM ({_listed('<script>(.*?)</script>')}))"""
_EDGES = "'^\\s+|\\s+$', '', 'g'"


def _extracted(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {_q(pattern)}, {group})"


def _found(category: str, kind: str, label: str, values: str) -> str:
    return f"SELECT script_id, {_q(category)} AS category, {_q(kind)} AS evidence_type, {_q(label)} AS kind, unnest({values}) AS value FROM read"


def _leading(category: str, kind: str, kinds: tuple, text: str) -> list[str]:
    return [_found(category, kind, k, f"{_extracted(text, p)}[:1]") for k, p in kinds]


_STATEMENTS = [(SF.IMPORT, "import"), (SF.DYNAMIC_IMPORT, "import"), (SF.EXPORT_FROM, "export"), (SF.EXPORT, "export")]
_FINDINGS = [
    *_leading("banner", "banner", SF.BANNER_KINDS, "b"),
    _found("banner", "version_candidate", "banner", _extracted("b", SF.VERSION, 1)),
    *[_found("ast", "import_export", k, _extracted("c", p, 1)) for p, k in _STATEMENTS],
    *[_found("ast", "ast_extraction", k, f"list_transform({_extracted('c', p)}, lambda x: regexp_replace(x, {_EDGES}))") for p, k in _STATEMENTS[:2]],
    _found("string", "string_literal", "literal", "said"),
    *[_found(c, e, k, f"list_filter(said, lambda x: regexp_matches(x, {_q(p)}))") for c, e, k, p in SF.LITERAL_KINDS],
    *[_found("metadata", "metadata", k, f"list_distinct({_extracted('c', p, g)})") for k, p, g in SF.METADATA_KINDS],
    *_leading("package", "metadata", SF.HEAD_KINDS, f"c[1:{SF.HEAD_CHARS}]"),
    *[f"SELECT DISTINCT * FROM ({' UNION ALL '.join(_leading('package', 'package_marker', tuple(('module', p) for p in SF.MODULE_MARKERS), 'c'))})"],
]
_WORDS_OF_COMMITS = (("commit", 14), ("revision", 12), ("sha", 17), ("git", 17))
ORACLES["script_findings"] = f"""WITH raw AS (SELECT script_id, c, array_to_string(list_transform({_extracted(f"c[1:{SF.BANNER_CHARS}]", SF.BANNER_COMMENT)}, lambda x: regexp_replace(x, {_EDGES})), chr(10)) AS comments,
    list_transform(list_filter(list_transform({_extracted("c", SF.LITERAL.replace("*+", "*"))}, lambda x: x[2:-2]), lambda x: length(x) >= 2)[:{SF.MAX_LITERALS}], lambda x: regexp_replace(x[1:{SF.LITERAL_CHARS}], {_EDGES})) AS literals FROM {_SOURCES}),
read AS (SELECT script_id, c, CASE WHEN comments <> '' THEN comments ELSE c[1:{SF.BANNER_CHARS}] END AS b, list_filter(list_distinct(literals), lambda x: length(x) >= 3 AND regexp_matches(x, {_q(SF.MEANINGFUL)})) AS said FROM raw),
hexes AS (SELECT DISTINCT script_id, c[1:{SF.COMMIT_CHARS}] AS front, unnest({_extracted(f"c[1:{SF.COMMIT_CHARS}]", chr(92) + "b[a-f0-9]{12,40}" + chr(92) + "b")}) AS value FROM read)
{" UNION ALL ".join(_FINDINGS)}
UNION ALL SELECT script_id, 'metadata', 'metadata', 'commit_hash', value FROM hexes WHERE {" OR ".join(f"regexp_matches(front, '(?s)(?i:{w}).{{0,{n}}}\\b' || value || '\\b|\\b' || value || '\\b.{{0,{n}}}(?i:{w})')" for w, n in _WORDS_OF_COMMITS)}"""

_MAPS = f"""(SELECT map_id + {CASES} AS map_id, text FROM {table("source_maps")}
  UNION ALL SELECT script_id * {SCRIPTS} + generate_subscripts(codes, 1) - 1, decode(from_base64(unnest(codes))) FROM (SELECT script_id, regexp_extract_all(c, {_q(SM.INLINE_MAP)}, 1) AS codes FROM {_SOURCES}) WHERE script_id < {CASES})"""
_strings = lambda name: f"coalesce(list_transform(list_filter(CASE WHEN json_type(m, '$.{name}') = 'ARRAY' THEN CAST(json_extract(m, '$.{name}') AS JSON[]) ELSE [] END, lambda x: json_type(x) = 'VARCHAR'), lambda x: json_extract_string(x, '$')), [])"
_PARSED = f"""SELECT map_id, status, CASE WHEN json_type(m, '$.version') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract(m, '$.version') AS BIGINT) END AS version, CASE WHEN json_type(m, '$.file') = 'VARCHAR' THEN json_extract_string(m, '$.file') END AS file,
    CASE WHEN status = 'ok' THEN {_strings("sources")} END AS sources, CASE WHEN status = 'ok' THEN {_strings("names")} END AS names, CASE WHEN status = 'ok' THEN len({_strings("sourcesContent")})::INTEGER END AS n_contents
FROM (SELECT map_id, status, CASE WHEN status = 'ok' THEN CAST(text AS JSON) END AS m FROM (SELECT map_id, text, CASE WHEN NOT coalesce(json_valid(text), FALSE) THEN 'broken' WHEN json_type(CASE WHEN json_valid(text) THEN text END) = 'OBJECT' THEN 'ok' ELSE 'not_object' END AS status FROM {_MAPS}))"""
ORACLES["source_map_parse"] = f"SELECT * REPLACE (array_to_string(sources, '|') AS sources, array_to_string(names, '|') AS names) FROM ({_PARSED})"


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
