"""Analyzers of HTTP responses: page_id, url, final_url, status_code, headers (map), set_cookies, redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.functions import fixed_values as V
from gleanspark.operators.findings import exploded, item

SERVER_HEADERS = ("server", "x-powered-by", "via")


def lowered(headers: Column) -> Column:
    """Header names in lower case; of names that then collide the last one's value."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])))


def header_presence(responses: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """page_id, header, present, value for each named header: a literal array exploded in the scan, not a join."""
    rows = responses.withColumn("_h", lowered(F.col("headers"))).select("page_id", "_h", F.explode(F.array(*[F.lit(n) for n in names])).alias("header"))
    value = F.element_at("_h", F.col("header"))
    return rows.select("page_id", "header", value.isNotNull().alias("present"), value.alias("value"))


def cookie(raw: Column) -> Column:
    """A Set-Cookie header as a struct."""
    parts = F.split(F.trim(raw), r";\s*")
    first = parts[0]
    cut = F.instr(first, "=")
    name = F.when(cut > 0, F.substring(first, F.lit(1), cut - 1)).otherwise(first)
    value = F.when(cut > 0, F.substring(first, cut + 1, F.char_length(first))).otherwise("")
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))

    def attribute(key: str) -> Column:
        own = F.filter(rest, lambda p: F.lower(F.trim(F.split(p, "=", 2)[0])) == key)
        last = F.try_element_at(own, F.lit(-1))
        return F.when(last.contains("="), F.trim(F.regexp_replace(last, "^[^=]*=", ""))).when(last.isNotNull(), "true")

    return F.struct(
        F.trim(name).alias("name"),
        F.trim(value).alias("value"),
        *[attribute(a).alias(a) for a in ("domain", "path", "expires", "samesite", "priority")],
        attribute("max-age").try_cast("int").alias("max_age"),
        *[attribute(a).isNotNull().alias(a) for a in ("secure", "httponly", "partitioned")],
        F.when(name.startswith("__Host-"), "__Host-").alias("host_prefix"),
        F.when(name.startswith("__Secure-"), "__Secure-").alias("secure_prefix"),
        raw.alias("raw"),
    )


def cookies(responses: DataFrame) -> DataFrame:
    return responses.select("page_id", F.posexplode("set_cookies").alias("index", "raw")).select("page_id", "index", cookie(F.col("raw")).alias("c")).select("page_id", "index", "c.*")


def csp_directives(responses: DataFrame) -> DataFrame:
    """page_id, directive, sources of the content security policy."""
    policy = F.element_at(lowered(F.col("headers")), "content-security-policy")
    rows = responses.select("page_id", F.explode(F.filter(F.transform(F.split(policy, ";"), lambda d: F.trim(d)), lambda d: d != "")).alias("d"))
    return rows.select("page_id", F.lower(F.split("d", r"\s+", 2)[0]).alias("directive"), F.trim(F.regexp_replace("d", r"^\S+", "")).alias("sources"))


def _matrix(analyzer: str, category: str, names: tuple[str, ...]) -> Column:
    """A finding for each of these headers, whether the response has it or not."""
    have = lowered(F.col("headers"))

    def one(name: str) -> Column:
        value = F.element_at(have, name)
        state = F.when(F.array_contains(F.map_keys(have), name), "present").otherwise("missing")
        return item(analyzer, category, F.concat_ws("-", F.lit(name), state), F.concat_ws(" ", F.lit(name), state), evidence=value)

    return F.array(*[one(n) for n in names])


def _listed(analyzer: str, category: str, items: Column, none: str) -> Column:
    some = F.transform(items, lambda x, i: item(analyzer, category, i.cast("string"), x, evidence=x))
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, some).otherwise(F.array(item(analyzer, category, F.lit("none"), F.lit(none))))


def _one(analyzer: str, category: str, title: Column) -> Column:
    return F.array(item(analyzer, category, F.lit("one"), title, location=F.col("url")))


HTTP_ANALYZERS = {
    "http-header-analyzer": lambda: _matrix("http-header-analyzer", "HEADERS", V.COMMON_RESPONSE_HEADERS),
    "security-header-analyzer": lambda: _matrix("security-header-analyzer", "HEADERS", V.SECURITY_HEADERS),
    "cors-analyzer": lambda: _matrix("cors-analyzer", "HTTP", V.CORS_HEADERS),
    "cache-control-analyzer": lambda: _matrix("cache-control-analyzer", "HEADERS", V.CACHE_HEADERS),
    "server-fingerprint-analyzer": lambda: _matrix("server-fingerprint-analyzer", "INFRASTRUCTURE", SERVER_HEADERS),
    "content-type-analyzer": lambda: _one("content-type-analyzer", "HTTP", F.coalesce(F.element_at(lowered(F.col("headers")), "content-type"), F.lit("No content type"))),
    "http-response-metadata-analyzer": lambda: _one("http-response-metadata-analyzer", "METADATA", F.concat_ws(" ", F.lit("Status"), F.col("status_code").cast("string"))),
    "cookie-analyzer": lambda: _listed("cookie-analyzer", "COOKIES", F.transform("set_cookies", lambda c: F.concat(F.lit("Cookie: "), cookie(c)["name"])), "No cookies"),
    "redirect-analyzer": lambda: _listed("redirect-analyzer", "HTTP", F.transform("redirects", lambda x: F.concat_ws(" ", x["status_code"].cast("string"), x["url"], x["location"])), "No redirects"),
    "csp-analyzer": lambda: _listed("csp-analyzer", "HEADERS", F.filter(F.transform(F.split(F.element_at(lowered(F.col("headers")), "content-security-policy"), ";"), lambda d: F.trim(d)), lambda d: d != ""), "No content security policy"),
}


def http_findings(responses: DataFrame, enabled: list[str] | None = None) -> DataFrame:
    return exploded(responses, [f() for n, f in HTTP_ANALYZERS.items() if enabled is None or n in enabled])


def http_evidence(responses: DataFrame) -> DataFrame:
    """Each header and the status as evidence for technologies."""
    header = responses.select("page_id", "url", F.explode(lowered(F.col("headers"))).alias("header", "value"))
    rows = header.select("page_id", "url", F.lit("http_header").alias("evidence_type"), "value", F.create_map(F.lit("header"), F.col("header")).alias("metadata"))
    status = responses.select("page_id", "url", F.lit("http_metadata").alias("evidence_type"), F.col("status_code").cast("string").alias("value"), F.create_map(F.lit("header"), F.lit("status")).alias("metadata"))
    return rows.unionByName(status).withColumn("source", F.lit("network"))
