"""Findings in a script's sources: banners, imports and exports, string literals, metadata, packages.

All are expressions over a script's text, in the JVM. Literals are read by one alternation of the three kinds of quotes,
so that a quote inside another kind's literal opens none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.functions.columns import java_pattern
from gleanspark.operators.evidence import package_identity

# How many characters count as the banner, as the head and for commits; how many literals and metadata count.
BANNER_CHARS, HEAD_CHARS, COMMIT_CHARS, MAX_LITERALS, LITERAL_CHARS, MAX_METADATA = 4096, 8192, 50_000, 500, 512, 100
# Patterns.
BANNER_COMMENT = r"(?m)^\s*(?://[^\n]*|/\*[\s\S]*?\*/)"
LICENSE = r"(?i)(?:MIT|Apache(?:-2\.0)?|BSD(?:-[\d]-Clause)?|GPL(?:-[\d\.]+)?|ISC|MPL(?:-[\d\.]+)?)\s+License"
COPYRIGHT = r"(?i)Copyright\s+(?:\(c\)|©)?\s*\d{4}(?:-\d{4})?\s+[^;\n]+"
GENERATED = r"(?i)(?:@generated|Generated by|Built with|Compiled by)\s+[^\n;]+"
REPOSITORY = r"(?i)https?://(?:www\.)?github\.com/[\w.-]+/[\w.-]+(?:/[\w./-]*)?"
FRAMEWORK = r"(?i)(?:React|Vue\.js|Angular|Svelte|Next\.js|Nuxt|SolidJS|Astro|webpack|Vite|Rollup|Parcel)"
VERSION = r"(?i)\b(?:v(?:er(?:sion)?)?[:=\s-]*)?(\d{1,4}\.\d{1,4}(?:\.\d{1,4})?(?:[-+][\w.-]+)?)\b"
BUILD_HASH = r"(?i)\b(?:hash|buildId|buildHash)[\"'\s:=]+([a-f0-9]{8,64})\b"
PACKAGE_PATH = r"(?i)(?:npm(?:js)?\.com/package/(@?[\w.-]+(?:/[\w.-]+)?)|node_modules/(@?[\w.-]+(?:/[\w.-]+)?))"
NODE_MODULES = r"node_modules/(@?[\w.-]+(?:/[\w.-]+)?)"
PACKAGE_JSON = r"(?s)['\"]name['\"]\s*:\s*['\"](@?[\w./-]+)['\"].*?['\"]version['\"]\s*:\s*['\"]([^'\"]+)['\"]"
IMPORT = r"(?m)^\s*import\s+(?:[\w*{}\s,]+\s+from\s+)?['\"]([^'\"]+)['\"]"
DYNAMIC_IMPORT = r"import\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"
EXPORT_FROM = r"(?m)^\s*export\s+(?:[\w*{}\s,]+\s+from\s+)?['\"]([^'\"]+)['\"]"
EXPORT = r"(?m)^\s*export\s+(?:default\s+)?(?:function|class|const|let|var)\s+(\w+)"
MEANINGFUL = r"(?i)react|vue|angular|svelte|webpack|vite|rollup|parcel|next|nuxt|solid|astro|license|repository|version|node_modules|@|\.|/|^npm:|^node:"
MODULE_MARKERS = (r"\brequire\s*\(\s*['\"]", r"\bimport\s+.+\s+from\s+['\"]", r"\bexport\s+(?:default\s+)?(?:function|class|const|let|var)\b", r"__webpack_require__", r"System\.register\s*\(")
BANNER_KINDS = (("license", LICENSE), ("copyright", COPYRIGHT), ("generated_by", GENERATED), ("github_url", REPOSITORY), ("framework", FRAMEWORK))
HEAD_KINDS = (("license", LICENSE), ("copyright", COPYRIGHT), ("github_url", REPOSITORY))
METADATA_KINDS = (("github_url", REPOSITORY, 0), ("generator", GENERATED, 0), ("build_hash", BUILD_HASH, 1))
LITERAL_KINDS = (("metadata", "metadata", "github_url", REPOSITORY), ("package", "package_reference", "literal", PACKAGE_PATH), ("package", "banner", "license", LICENSE))
#: A literal in either kind of quotes; possessive, as no other way to read it can be right.
LITERAL = "|".join(rf"{q}[^{q}\\]*+(?:\\.[^{q}\\]*+)*+{q}" for q in "\"'`")
#: Hexadecimal words with one of the words for commits at most 20 characters before or after.
COMMIT_BEFORE = r"(?s)(?i:commit(?=.{0,14}?\b([a-f0-9]{12,40})\b)|revision(?=.{0,12}?\b([a-f0-9]{12,40})\b)|(?:sha|git)(?=.{0,17}?\b([a-f0-9]{12,40})\b))"
COMMIT_AFTER = r"(?s)\b([a-f0-9]{12,40})\b(?=.{0,14}(?i:commit)|.{0,12}(?i:revision)|.{0,17}(?i:sha|git))"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(group))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _row(category: str, evidence_type: str, kind: str, value: Column) -> Column:
    return F.struct(F.lit(category).alias("category"), F.lit(evidence_type).alias("evidence_type"), F.lit(kind).alias("kind"), value.alias("value"))


def _rows(category: str, evidence_type: str, kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: _row(category, evidence_type, kind, v))


def _matching(values: Column, pattern: str) -> Column:
    return F.filter(values, lambda x: x.rlike(java_pattern(pattern)))


def _first(category: str, evidence_type: str, kinds: tuple, text: Column) -> Column:
    """The first match of each kind."""
    return F.array_compact(F.array(*[F.when(text.rlike(java_pattern(p)), _row(category, evidence_type, k, F.regexp_extract(text, java_pattern(p), 0))) for k, p in kinds]))


def literals(content: Column) -> Column:
    """The first literals of two characters or more, cut to LITERAL_CHARS."""
    inner = F.transform(_all(content, LITERAL), lambda x: F.substring(x, F.lit(2), F.char_length(x) - 2))
    return F.transform(F.slice(F.filter(inner, lambda x: F.char_length(x) >= 2), 1, MAX_LITERALS), lambda x: F.substring(x, 1, LITERAL_CHARS))


def script_findings(scripts: DataFrame) -> DataFrame:
    """script_id, category, evidence_type, kind, value: what banners, imports, exports, literals and metadata say.

    scripts: script_id, content (null: none). A statement that stands twice has two rows; literals and metadata are
    distinct within a script. An empty table gives no rows; other columns aren't looked at.
    """
    given = scripts.select("script_id", F.coalesce("content", F.lit("")).alias("content"))
    content = F.col("content")
    comments = F.array_join(F.transform(_all(F.substring(content, 1, BANNER_CHARS), BANNER_COMMENT), _strip), "\n")
    read = given.select("script_id", "content", F.when(comments != "", comments).otherwise(F.substring(content, 1, BANNER_CHARS)).alias("banner"), literals(content).alias("literals"))
    banner = F.col("banner")
    said = F.filter(F.array_distinct(F.transform("literals", _strip)), lambda x: (F.char_length(x) >= 3) & x.rlike(java_pattern(MEANINGFUL)))
    told = F.array_distinct(F.concat(*[_rows("metadata", "metadata", k, F.array_distinct(_all(content, p, g))) for k, p, g in METADATA_KINDS]))
    some = F.substring(content, 1, COMMIT_CHARS)
    commits = F.array_distinct(F.concat(*[F.filter(_all(some, COMMIT_BEFORE, g), lambda x: x != "") for g in (1, 2, 3)], _all(some, COMMIT_AFTER, 1)))
    statements = [(IMPORT, "import"), (DYNAMIC_IMPORT, "import"), (EXPORT_FROM, "export"), (EXPORT, "export")]
    parts = [
        _first("banner", "banner", BANNER_KINDS, banner),
        _rows("banner", "version_candidate", "banner", _all(banner, VERSION, 1)),
        *[_rows("ast", "import_export", k, _all(content, p, 1)) for p, k in statements],
        *[_rows("ast", "ast_extraction", k, F.transform(_all(content, p), _strip)) for p, k in statements[:2]],
        _rows("string", "string_literal", "literal", said),
        *[_rows(c, e, k, _matching(said, p)) for c, e, k, p in LITERAL_KINDS],
        F.slice(told, 1, MAX_METADATA),
        _rows("metadata", "metadata", "commit_hash", F.array_except(commits, F.transform(told, lambda x: x["value"]))),
        _first("package", "metadata", HEAD_KINDS, F.substring(content, 1, HEAD_CHARS)),
        F.array_distinct(_first("package", "package_marker", tuple(("module", p) for p in MODULE_MARKERS), content)),
    ]
    return read.select("script_id", F.explode(F.concat(*parts)).alias("x")).select("script_id", "x.*")


def script_packages(scripts: DataFrame) -> DataFrame:
    """script_id, package, version: packages that paths, imports and embedded package files name; version null but of the last.

    scripts: script_id, content. Names that can't be a package's are left out; each name has one row without a version,
    and one by embedded package file.
    """
    given = scripts.select("script_id", F.coalesce("content", F.lit("")).alias("content"))
    content = F.col("content")
    head = F.substring(content, 1, HEAD_CHARS)
    filled = lambda x: F.filter(x, lambda v: v != "")
    named = F.array_distinct(F.concat(_all(content, NODE_MODULES, 1), _all(content, IMPORT, 1), _all(content, DYNAMIC_IMPORT, 1), filled(_all(head, PACKAGE_PATH, 1)), filled(_all(head, PACKAGE_PATH, 2))))
    one = lambda name, version: F.struct(name.alias("package"), version.alias("version"))
    plain = F.transform(named, lambda x: one(x, F.lit(None).cast("string")))
    files = F.transform(F.arrays_zip(_all(content, PACKAGE_JSON, 1).alias("n"), _all(content, PACKAGE_JSON, 2).alias("v")), lambda x: one(x["n"], x["v"]))
    found = given.select("script_id", F.explode(F.concat(plain, files)).alias("x")).select("script_id", "x.*")
    return found.where(package_identity(F.col("package")).isNotNull())
