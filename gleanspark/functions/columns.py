"""Scalar functions as column expressions: they stay inside generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanspark.functions import fixed_values as V

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
#: All spaces of Unicode (Zs): what trim() takes away in the SQL, where Spark's knows U+0020 only.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    """The text without spaces of any width at its ends; tabs and line ends stay."""
    return F.trim(text, F.lit(SPACES))


def java_pattern(pattern: str, flags: str = "") -> str:
    """A pattern in Python's dialect for java.util.regex: only \\n ends a line, case folding is Unicode's."""
    on = "d" + ("iu" if "i" in flags else "") + ("m" if "m" in flags else "") + ("s" if "s" in flags else "")
    return f"(?{on}){pattern}"


def lookup(key: Column, table: Mapping[str, object], default: object = None) -> Column:
    """The table's value for the key (a small fixed table, as a literal map)."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def normalize_url(url: Column) -> Column:
    """Scheme and host lower-cased, an empty path is '/', slashes at a path's end fall; null if there's no scheme."""
    u = trimmed(url)
    part = lambda k: F.regexp_extract(u, _URL, k)
    path = part(3)
    short = F.when((path == "") | (path == "/"), F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))
    return F.when(u.rlike(_URL), F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), short, part(4), part(5)))


def validate_url(url: Column) -> Column:
    """The normalized URL, https by default; null unless it is http or https and has a host."""
    u = trimmed(url)
    full = normalize_url(F.when(u.rlike("^[A-Za-z][A-Za-z0-9+.\\-]*://"), u).otherwise(F.concat(F.lit("https://"), u)))
    return F.when(full.rlike("^https?://[^/?#]+"), full)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def asset_key(url: Column) -> Column:
    """What assets are told apart by: the normalized URL without its fragment."""
    return F.regexp_replace(normalize_url(url), "#.*$", "")


def filename(url: Column) -> Column:
    """The path's last part, script.js if it has none."""
    path = F.regexp_replace(F.regexp_extract(trimmed(url), _URL, 3), "/+$", "")
    last = F.element_at(F.split(path, "/"), -1)
    return F.when(F.coalesce(last, F.lit("")) == "", F.lit("script.js")).otherwise(last)


def asset_category(url: Column, name: Column, mime: Column, hint: Column) -> Column:
    """Hint, then name, worker suffix, extension, MIME type, path."""
    low, path = F.lower(name), F.lower(url)
    kind = F.lower(F.trim(F.split(mime, ";")[0]))
    extension = F.regexp_extract(low, r"[^./]+(\.[^./]+)$", 1)
    by_mime = (
        F.when(kind.isin("application/javascript", "text/javascript", "module"), "javascript")
        .when(kind == "text/css", "css")
        .when(kind == "application/json", "json")
        .when(kind == "application/wasm", "wasm")
        .when(kind.startswith("image/"), "image")
        .when(kind.startswith("font/") | kind.isin("application/font-woff", "application/font-woff2", "application/vnd.ms-fontobject"), "font")
        .when(kind.isin("text/xml", "application/xml"), "xml")
        .when(kind.startswith("text/"), "text")
    )
    worker = low.endswith(V.WORKER_SUFFIXES[0])
    for s in V.WORKER_SUFFIXES[1:]:
        worker = worker | low.endswith(s)
    return F.coalesce(
        F.when(hint.isNotNull() & (hint != "unknown"), hint),
        F.when(low.isin(*V.MANIFEST_FILES) | low.contains("manifest"), F.lit("manifest")),
        F.when(low == "robots.txt", F.lit("text")),
        F.when(low == "sitemap.xml", F.lit("xml")),
        F.when(worker, F.lit("worker")),
        lookup(extension, V.EXTENSION_CATEGORIES),
        by_mime,
        F.when(path.contains("serviceworker") | path.contains("service-worker"), F.lit("service_worker")),
        F.when(path.endswith(".map") | path.contains(".map?"), F.lit("map")),
        F.lit("unknown"),
    )


def download_status(ok: Column, status: Column, error: Column) -> Column:
    """downloaded, skipped, timeout, forbidden, rate_limited or failed; a missing status is read from the message."""
    message = F.lower(F.coalesce(error, F.lit("")))
    known = F.coalesce(status, F.regexp_extract(message, r"\b([1-5]\d\d)\b", 1).try_cast("int"))
    return (
        F.when(F.coalesce(ok, F.lit(False)), "downloaded")
        .when(message.contains("size limit") | message.contains("exceeds limit"), "skipped")
        .when(message.contains("timeout"), "timeout")
        .when(known == 403, "forbidden")
        .when(known == 429, "rate_limited")
        .otherwise("failed")
    )


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    total = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    return F.when(n > 0, total).otherwise(F.lit(0.0))


def redact(value: Column, keep: int = 4) -> Column:
    """First and last characters of a value long enough to hide the rest."""
    n = F.char_length(value)
    return F.when(n <= 2 * keep, F.lit("*" * keep)).otherwise(F.concat(F.left(value, F.lit(keep)), F.lit("..."), F.right(value, F.lit(keep))))


def confidence_level(confidence: Column) -> Column:
    return F.when(confidence >= 95, "very_high").when(confidence >= 80, "high").when(confidence >= 60, "medium").otherwise("low")


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


SEVERITIES: tuple[str, ...] = ("INFORMATIONAL", "LOW", "MEDIUM", "HIGH", "CRITICAL")


def severity_rank(severity: Column) -> Column:
    return lookup(severity, {s: k + 1 for k, s in enumerate(SEVERITIES)}, 0)


def severity_of(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank.cast("int"))


_VERSION = r"^(\d{1,4})(?:\.(\d{1,4}))?(?:\.(\d{1,4}))?(?:-([\w.-]+))?(?:\+([\w.-]+))?$"


def normalize_version(raw: Column) -> Column:
    """Without white space, quotes around it and a leading v."""
    return trimmed(F.regexp_replace(F.regexp_replace(trimmed(raw), "^[\"']+|[\"']+$", ""), "^[vV]", ""))


def valid_version(raw: Column) -> Column:
    """Semantic versions with a minor part at least, other than 0.0 and 0.0.0."""
    v = normalize_version(raw)
    part = lambda k: F.regexp_extract(v, _VERSION, k)
    zero = (part(1).cast("int") == 0) & (part(2).cast("int") == 0) & ((part(3) == "") | (part(3).cast("int") == 0))
    return v.rlike(_VERSION) & (part(2) != "") & ~F.coalesce(zero, F.lit(False))


def technology_id(name: Column) -> Column:
    """Lower-cased words joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9]+", "-"), "^-+|-+$", "")


def plain_text(text: Column) -> Column:
    """White space collapsed, lower-cased."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def finding_id(*parts: Column) -> Column:
    """A repeatable id in place of a random one."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def any_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
