"""Analyzers of pages' metadata and references; each gives findings or rows from parsed pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.functions.columns import any_of, asset_category, filename, host, normalize_url, trimmed
from gleanspark.operators.findings import exploded, finding, item

# Well-known resources and their paths; marks of frameworks in a page.
WELL_KNOWN = (
    ("robots", "/robots.txt"),
    ("sitemap", "/sitemap.xml"),
    ("security", "/.well-known/security.txt"),
    ("humans", "/humans.txt"),
    ("ads", "/ads.txt"),
    ("assetlinks", "/.well-known/assetlinks.json"),
    ("apple-app-site-association", "/.well-known/apple-app-site-association"),
    ("favicon", "/favicon.ico"),
    ("webmanifest", "/site.webmanifest"),
    ("browserconfig", "/browserconfig.xml"),
    ("manifest", "/manifest.json"),
)
FRAMEWORK_MARKS = {
    "nextjs": ("__NEXT_DATA__", "_next/static", "next/dist"),
    "nuxt": ("__NUXT__", "nuxt", "_nuxt/"),
    "react": ("data-reactroot", "react-root", "__REACT_DEVTOOLS"),
    "vue": ("data-v-", "vue-app", "__VUE__"),
    "angular": ("ng-version", "ng-app", "angular"),
    "wordpress": ("wp-content", "wp-includes", "WordPress"),
    "drupal": ("Drupal", "drupal-settings"),
}


def meta(key: str) -> Column:
    """The first meta element's content with this name (or property)."""
    hit = F.filter("page.metas", lambda m: (F.lower(F.coalesce(m["name"], m["property"])) == key) & m["content"].isNotNull())
    return F.try_element_at(hit, F.lit(1))["content"]


def links_of(rel: str) -> Column:
    return F.filter("page.links", lambda x: F.array_contains(F.split(F.lower(F.coalesce(x["rel"], F.lit(""))), r"\s+"), rel))


def inline_script_texts(parsed: DataFrame) -> DataFrame:
    """page_id, url, index (among scripts with text and no src), content."""
    own = F.filter("page.scripts", lambda s: s["src"].isNull() & (F.trim(s["content"]) != ""))
    return parsed.select("page_id", "url", F.posexplode(own).alias("index", "s")).select("page_id", "url", "index", F.col("s.content").alias("content"))


def inline_scripts(parsed: DataFrame) -> DataFrame:
    return inline_script_texts(parsed).drop("url")


def comments(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", F.posexplode("page.comments").alias("index", "content")).withColumn("content", trimmed(F.col("content")))


def anchors(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", F.posexplode("page.anchors").alias("index", "href"))


def references(parsed: DataFrame) -> DataFrame:
    """page_id, source, href: scripts, links, media and URLs in styles; no data:, blob:, javascript: or fragments."""
    rows = F.flatten(
        F.array(
            F.transform(F.filter("page.scripts", lambda s: s["src"].isNotNull()), lambda s: F.struct(F.lit("script").alias("source"), s["src"].alias("href"))),
            F.transform(F.filter("page.links", lambda x: x["href"].isNotNull()), lambda x: F.struct(F.lit("link").alias("source"), x["href"].alias("href"))),
            F.transform("page.media", lambda m: F.struct(F.lit("media").alias("source"), m.alias("href"))),
            F.transform(F.flatten(F.transform("page.styles", css_urls)), lambda u: F.struct(F.lit("style").alias("source"), u.alias("href"))),
        )
    )
    out = parsed.select("page_id", "url", F.explode(rows).alias("r")).select("page_id", F.col("url").alias("base"), "r.source", F.trim("r.href").alias("href"))
    return out.where((F.col("href") != "") & ~F.lower("href").rlike("^(data:|blob:|javascript:|#)"))


def css_urls(css: Column) -> Column:
    """url(...) and then @import targets of a style sheet."""
    bare = lambda x: F.regexp_replace(trimmed(x), "^['\"]|['\"]$", "")
    return F.concat(F.transform(F.regexp_extract_all(css, F.lit(r"(?i)url\(\s*([^)]+?)\s*\)"), F.lit(1)), bare), F.transform(F.regexp_extract_all(css, F.lit(r"(?i)@import\s+(['\"][^'\"]+['\"])"), F.lit(1)), bare))


def script_references(script: Column) -> Column:
    """Modules and assets that a script names: imports, exports, workers, and literals with an asset's extension."""
    found = (
        (r"import\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", 1),
        (r"(?m)^\s*import\s+(?:[^'\"]*?\sfrom\s+)?['\"]([^'\"]+)['\"]", 1),
        (r"export\s+[^'\"]*?\sfrom\s+['\"]([^'\"]+)['\"]", 1),
        (r"new\s+(?:Shared)?Worker\(\s*['\"]([^'\"]+)['\"]", 1),
        (r"serviceWorker\.register\(\s*['\"]([^'\"]+)['\"]", 1),
        (r"['\"]([^'\"\s]+\.(?:js|mjs|cjs|css|json|map|wasm|woff2?|ttf|otf|eot|png|jpe?g|gif|webp|svg|ico|avif))['\"]", 1),
    )
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(script, F.lit(p), F.lit(g)) for p, g in found])))


def resolved(references_: DataFrame) -> DataFrame:
    """Adds url: the reference against its base, normalized; null if it isn't http or https."""
    base, ref = F.col("base"), F.col("href")
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), r"[^/]*$", "")
    joined = (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(root, ref))
        .when(ref.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), ref))
        .otherwise(F.concat(root, F.when(path == "", "/").otherwise(path), ref))
    )
    # each step is a column of its own, so that no expression is repeated inside another
    out = references_.withColumn("_joined", joined)
    at = F.col("_joined")
    head, tail = F.regexp_extract(at, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1), F.regexp_extract(at, r"([?#].*)$", 1)
    steps = F.split(F.regexp_extract(at, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), "/")
    # a step up takes away the one before it, never the root; "." says nothing
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.lit(1), F.size(acc) - 1))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    last = F.element_at(steps, -1)
    plain = F.concat(head, F.array_join(walked, "/"), F.when(last.isin(".", ".."), "/").otherwise(""), tail)
    out = out.withColumn("_joined", F.when(at.contains("/.") & (head != ""), plain).otherwise(at))
    out = out.withColumn("_url", normalize_url(F.col("_joined")))
    return out.withColumn("url", F.when(F.col("_url").rlike("^https?://[^/?#]+"), F.col("_url"))).drop("_joined", "_url")


def inventory(references_: DataFrame) -> DataFrame:
    """One row by asset key: name, category, how often and by how many pages and sources it is named."""
    rows = references_.where("url is not null").withColumn("asset_key", F.regexp_replace("url", "#.*$", ""))
    per = rows.groupBy("asset_key", "page_id", "source").agg(F.count(F.lit(1)).alias("k"))
    out = per.groupBy("asset_key").agg(F.sum("k").alias("n_references"), F.count_distinct("page_id").alias("n_pages"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    nothing = F.lit(None).cast("string")
    return out.withColumn("filename", filename(F.col("asset_key"))).withColumn("category", asset_category(F.col("asset_key"), F.col("filename"), nothing, nothing))


def well_known(pages: DataFrame) -> DataFrame:
    """page_id, resource_type, url: where a page's host may have its well-known resources."""
    root = F.concat(F.lower(F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]*)", 1)))
    rows = F.array(*[F.struct(F.lit(n).alias("resource_type"), F.lit(p).alias("path")) for n, p in WELL_KNOWN])
    return pages.select("page_id", root.alias("root"), F.explode(rows).alias("w")).select("page_id", "w.resource_type", F.concat("root", "w.path").alias("url"))


def sitemap_lines(robots: Column) -> Column:
    return F.regexp_extract_all(robots, F.lit(r"(?im)^Sitemap:\s*(\S+)"), F.lit(1))


def host_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy(host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n_pages"), F.count_distinct(normalize_url(F.col("url"))).alias("n_urls"))


def duplicates(texts: DataFrame, key: str, text_column: str) -> DataFrame:
    """key, content_hash, duplicate_of (the smallest key with the same content, null for that one itself)."""
    hashed = texts.select(key, F.sha2(F.coalesce(text_column, F.lit("")), 256).alias("content_hash"))
    first = hashed.groupBy("content_hash").agg(F.min(key).alias("_first"))
    return hashed.join(first, "content_hash").select(key, "content_hash", F.when(F.col(key) != F.col("_first"), F.col("_first")).alias("duplicate_of"))


def _present(analyzer: str, what: str, value: Column, title: str) -> Column:
    """A finding for each page, whether it has the value or not."""
    there = F.coalesce(trimmed(value), F.lit("")) != ""
    text = F.when(there, F.concat(F.lit(f"{title}: "), trimmed(value))).otherwise(F.lit(f"{title} missing"))
    return F.array(item(analyzer, "METADATA", F.concat(F.lit(f"{what}-"), F.when(there, "present").otherwise("missing")), text, evidence=value, location=F.col("url")))


def _each(analyzer: str, items: Column, title: str) -> Column:
    """A finding for each item, or one that says there is none."""
    none = F.array(item(analyzer, "METADATA", F.lit("none"), F.lit(f"No {title}"), location=F.col("url")))
    some = F.transform(items, lambda x, i: item(analyzer, "METADATA", i.cast("string"), F.concat(F.lit(f"{title}: "), x), evidence=x, location=F.col("url")))
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, some).otherwise(none)


def _pairs(prefix: str) -> Column:
    own = F.filter("page.metas", lambda m: F.lower(F.coalesce(m["property"], m["name"])).startswith(prefix))
    return F.transform(own, lambda m: F.concat_ws("=", F.lower(F.coalesce(m["property"], m["name"])), m["content"]))


def _hrefs(rel: str) -> Column:
    return F.filter(F.transform(links_of(rel), lambda x: x["href"]), lambda h: h.isNotNull())


def frameworks(html: Column) -> Column:
    """Names of the frameworks whose marks the page has."""
    return F.array_compact(F.array(*[F.when(any_of([html.contains(m) for m in marks]), F.lit(n)) for n, marks in FRAMEWORK_MARKS.items()]))


def _scripts_text() -> Column:
    return F.array_join(F.transform("page.scripts", lambda s: F.concat_ws(" ", s["src"], s["content"])), "\n")


# Analyzers by id: arrays of findings, in terms of page and url.
METADATA_ANALYZERS = {
    "html-metadata-analyzer": lambda: _present("html-metadata-analyzer", "title", F.col("page.title"), "Title"),
    "language-analyzer": lambda: _present("language-analyzer", "language", F.col("page.language"), "Language"),
    "application-metadata-analyzer": lambda: _present("application-metadata-analyzer", "application-name", meta("application-name"), "Application name"),
    "generator-meta-analyzer": lambda: _present("generator-meta-analyzer", "generator", meta("generator"), "Generator"),
    "theme-color-analyzer": lambda: _present("theme-color-analyzer", "theme-color", meta("theme-color"), "Theme color"),
    "html-comment-analyzer": lambda: _each("html-comment-analyzer", F.transform("page.comments", trimmed), "HTML comment"),
    "opengraph-analyzer": lambda: _each("opengraph-analyzer", _pairs("og:"), "OpenGraph property"),
    "twitter-card-analyzer": lambda: _each("twitter-card-analyzer", _pairs("twitter:"), "Twitter card property"),
    "canonical-link-analyzer": lambda: _each("canonical-link-analyzer", _hrefs("canonical"), "Canonical link"),
    "alternate-link-analyzer": lambda: _each("alternate-link-analyzer", _hrefs("alternate"), "Alternate link"),
    "favicon-analyzer": lambda: _each("favicon-analyzer", _hrefs("icon"), "Icon"),
    "web-app-manifest-analyzer": lambda: _each("web-app-manifest-analyzer", _hrefs("manifest"), "Web app manifest"),
    "framework-metadata-analyzer": lambda: _each("framework-metadata-analyzer", frameworks(_scripts_text()), "Framework hint"),
    "service-worker-analyzer": lambda: _each("service-worker-analyzer", F.regexp_extract_all(_scripts_text(), F.lit(r"serviceWorker\.register\(\s*['\"]([^'\"]+)"), F.lit(1)), "Service worker"),
    "sourcemap-analyzer": lambda: _each("sourcemap-analyzer", F.regexp_extract_all(_scripts_text(), F.lit(r"sourceMappingURL=([^\s\"']+)"), F.lit(1)), "Source map"),
}
# Analyzers of well-known resources by id: the type that each looks for.
WELL_KNOWN_ANALYZERS = {
    "robots-analyzer": "robots",
    "sitemap-analyzer": "sitemap",
    "security-txt-analyzer": "security",
    "humans-txt-analyzer": "humans",
    "ads-txt-analyzer": "ads",
    "assetlinks-analyzer": "assetlinks",
    "apple-app-site-association-analyzer": "apple-app-site-association",
    "browserconfig-analyzer": "browserconfig",
    "manifest-analyzer": "manifest",
}


def metadata_findings(parsed: DataFrame, enabled: list[str] | None = None) -> DataFrame:
    """All enabled analyzers' findings; those not enabled aren't part of the plan."""
    return exploded(parsed, [f() for n, f in METADATA_ANALYZERS.items() if enabled is None or n in enabled])


def well_known_findings(observed: DataFrame) -> DataFrame:
    """observed: page_id, resource_type, url, available. A finding by page and analyzer: present or missing."""
    own = F.create_map(*[F.lit(x) for n, t in WELL_KNOWN_ANALYZERS.items() for x in (t, n)])
    pages = observed.select("page_id").distinct().withColumn("resource_type", F.explode(F.array(*[F.lit(t) for t in WELL_KNOWN_ANALYZERS.values()])))
    got = observed.groupBy("page_id", "resource_type").agg(F.bool_or("available").alias("available"), F.min(F.when(F.col("available"), F.col("url"))).alias("url"))
    rows = pages.join(got, ["page_id", "resource_type"], "left").withColumn("analyzer", F.element_at(own, F.col("resource_type")))
    state = F.when(F.coalesce(F.col("available"), F.lit(False)), "present").otherwise("missing")
    return rows.select(*finding(F.col("page_id"), F.col("analyzer"), "METADATA", F.concat_ws("-", "resource_type", state), F.concat_ws(" ", "resource_type", state), location=F.col("url")))


def link_header_references(headers: DataFrame) -> DataFrame:
    """page_id, base, href, url: what the Link headers (page_id, base, header) of pages refer to, by their base address.

    A header's parts stand between commas; those that begin with an address in angle brackets count, whatever their
    parameters. url is null if it isn't http or https; null headers have none.
    """
    parts = F.transform(F.split(F.coalesce("header", F.lit("")), ","), lambda x: F.trim(x))
    found = headers.select("page_id", "base", F.explode(parts).alias("part")).where(F.col("part").rlike("^<[^>]+>"))
    return resolved(found.select("page_id", "base", F.regexp_extract("part", "^<([^>]+)>", 1).alias("href")))
