"""Evidence in scripts: tokens, runtimes, bundlers, versions, resource kinds, and how scripts lead to others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.functions import fixed_values as V
from gleanspark.functions.columns import asset_key, java_pattern, lookup, normalize_version, valid_version
from gleanspark.functions.js_patterns import JS_BUNDLE_PATTERNS, JS_RUNTIME_PATTERNS, JS_VERSION_PATTERNS
from gleanspark.functions.version_patterns import METHOD_WEIGHTS, VERSION_PATTERNS
from gleanspark.operators.pages import resolved, script_references

# Fixed values of the features: how much of a script counts, how many tokens, rounds and resources.
MAX_CHARS, MAX_STRINGS, MAX_IDENTIFIERS, MAX_ROUNDS, MAX_RESOURCES = 5 * 1024 * 1024, 500, 300, 20, 200
# Marks of bundlers in a name or the first 8 KiB, in this order.
BUNDLER_MARKS = (
    ("webpack", r"__webpack_require__|webpackChunk|webpackJsonp"),
    ("turbopack", r"turbopack|__turbopack__"),
    ("vite", r"__vite__|import\.meta\.env"),
    ("rollup", r"rollupVersion|\bRollup\b"),
    ("parcel", r"parcelRequire|\bParcel\b"),
    ("rspack", r"__rspack_require__"),
    ("esbuild", r"esbuild|__ESBUILD__"),
)
# Parts of a script's name that tell its kind.
WORKER_NAME = r"worker|sw\.js|service-worker|serviceworker"
ENTRY_NAME = r"main|index|app|entry|bootstrap|start"
RUNTIME_NAME = r"runtime|webpack-runtime|vite/runtime|turbopack/runtime"
VENDOR_NAME = r"vendor|vendors|lib(?:rary)?|node_modules|framework"
FRAMEWORK_NAME = r"react|vue|angular|svelte|next|nuxt|solid|ember|preact"
CHUNK_NAME = r"chunk|lazy|async|dynamic|split"
# One line is minified from so many characters on; up to so many lines, from so many on average.
MINIFIED_LINE, MINIFIED_LINES, MINIFIED_AVERAGE = 500, 50, 180


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(group))


def tokens(scripts: DataFrame) -> DataFrame:
    """script_id, imports, exports, strings, identifiers: distinct, as many as the features take."""
    text = F.substring(F.coalesce("content", F.lit("")), 1, MAX_CHARS)
    some = lambda c, n: F.slice(F.array_distinct(c), 1, n)
    imports = F.concat(_all(text, r"(?m)\bimport\s+(?:[^'\";]*?\sfrom\s+)?['\"]([^'\"]+)['\"]"), _all(text, r"\b(?:import|require)\(\s*['\"]([^'\"]+)['\"]\s*\)"))
    return scripts.select("script_id", F.array_distinct(imports).alias("imports"), F.array_distinct(_all(text, r"\bexport\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var)\s+([A-Za-z_$][\w$]*)")).alias("exports"), some(_all(text, r"(['\"])((?:(?!\1)[^\\\n]|\\.)*)\1", 2), MAX_STRINGS).alias("strings"), some(_all(text, r"\b([A-Za-z_$][\w$]{2,})\b"), MAX_IDENTIFIERS).alias("identifiers"))


def shape(content: Column) -> Column:
    """minified or readable: one very long line, or few lines that are long on average (line ends aside)."""
    lines, size = F.size(F.split(content, "\n")), F.char_length(content)
    few = (lines <= MINIFIED_LINES) & ((size - (lines - 1)) / lines >= MINIFIED_AVERAGE)
    return F.when(F.when(lines <= 1, size > MINIFIED_LINE).otherwise(few), "minified").otherwise("readable")


def bundler(name: Column, content: Column) -> Column:
    """The first bundler whose marks the name or the first 8 KiB have."""
    text = F.concat_ws("\n", name, F.substring(content, 1, 8192))
    return F.coalesce(*[F.when(text.rlike(java_pattern(p)), F.lit(n)) for n, p in BUNDLER_MARKS], F.lit("unknown"))


def resource_kind(name: Column, is_module: Column, source: Column | None = None) -> Column:
    """What a script is, by how it was found (source: service_worker, shared_worker, worker, dynamic_import, html_script ...) and its name."""
    low = F.lower(name)
    found = F.lit("") if source is None else F.coalesce(source, F.lit(""))
    by_worker = F.when(found.isin("service_worker", "shared_worker", "worker"), found).when(low.rlike(WORKER_NAME), "worker")
    return F.coalesce(
        by_worker,
        F.when(is_module, "module")
        .when(low.rlike(ENTRY_NAME), "entry_bundle")
        .when(low.rlike(RUNTIME_NAME), "runtime_bundle")
        .when(low.rlike(VENDOR_NAME), "vendor_bundle")
        .when(low.rlike(FRAMEWORK_NAME), "framework_bundle")
        .when((found == "dynamic_import") | low.rlike(CHUNK_NAME), F.when((found == "dynamic_import") | low.contains("lazy"), "lazy_chunk").otherwise("dynamic_chunk"))
        .when(found.isin("html_script", "html_module"), "entry_bundle")
        .otherwise("application_bundle"),
    )


def chunk_name(name: Column) -> Column:
    """x of chunk-x, chunk.x, or x.chunk, whichever comes first; null if none does."""
    p = java_pattern(r"chunk[-.]?([\w-]+)|([\w-]+)\.chunk", "i")
    return F.coalesce(F.nullif(F.regexp_extract(name, p, 1), F.lit("")), F.nullif(F.regexp_extract(name, p, 2), F.lit("")))


def script_evidence(scripts: DataFrame) -> DataFrame:
    """script_id, evidence_type, key, label, value: runtimes, bundlers and versions that a script shows."""
    text = F.substring(F.coalesce("content", F.lit("")), 1, MAX_CHARS)
    row = lambda kind, key, label, value: F.struct(F.lit(kind).alias("evidence_type"), F.lit(key).alias("key"), F.lit(label).alias("label"), value.alias("value"))
    found = [F.when(text.rlike(java_pattern(p)), row("runtime_pattern", k, n, F.regexp_extract(text, java_pattern(p), 0))) for k, n, p in JS_RUNTIME_PATTERNS]
    found += [F.when(text.rlike(java_pattern(p)), row("bundle_runtime", k, n, F.regexp_extract(text, java_pattern(p), 0))) for k, n, p in JS_BUNDLE_PATTERNS]
    found += [F.when(valid_version(F.regexp_extract(text, java_pattern(p), 1)), row("version_candidate", k, n, normalize_version(F.regexp_extract(text, java_pattern(p), 1)))) for k, n, p in JS_VERSION_PATTERNS]
    return scripts.select("script_id", F.explode(F.array_compact(F.array(*found))).alias("e")).select("script_id", "e.*")


def version_hits(scripts: DataFrame) -> DataFrame:
    """script_id, technology, method, version, weight: every valid version that an extractor's pattern finds."""
    text = F.coalesce("content", F.lit(""))

    def hit(technology: str, method: str) -> Callable[[Column], Column]:
        return lambda v: F.struct(F.lit(technology).alias("technology"), F.lit(method).alias("method"), v.alias("raw"))

    hits = [F.transform(_all(text, p), hit(t, m)) for t, m, p in VERSION_PATTERNS]
    rows = scripts.select("script_id", F.explode(F.flatten(F.array(*hits))).alias("h")).select("script_id", "h.*").where(valid_version(F.col("raw")))
    return rows.select("script_id", "technology", "method", normalize_version(F.col("raw")).alias("version"), lookup(F.col("method"), METHOD_WEIGHTS, 60.0).alias("weight")).distinct()


def version_source_priority(source: Column) -> Column:
    return lookup(source, V.VERSION_SOURCE_PRIORITIES, 30.0)


def duplicate_scripts(scripts: DataFrame) -> DataFrame:
    """script_id, content_hash, duplicate_of: the first script with the same content, null for itself."""
    hashed = scripts.select("script_id", F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash"))
    first = hashed.groupBy("content_hash").agg(F.min("script_id").alias("_first"))
    return hashed.join(first, "content_hash").select("script_id", "content_hash", F.when(F.col("script_id") != F.col("_first"), F.col("_first")).alias("duplicate_of"))


def reachable(seeds: DataFrame, assets: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """page_id, asset_key, round: scripts that a page's seeds lead to through the references of collected scripts.

    seeds: page_id, url. assets: url, content. Rounds of joins over the collected assets; ends when a round is empty.
    """
    links = assets.select(F.col("url").alias("base"), F.explode(script_references(F.col("content"))).alias("href"))
    links = resolved(links).where("url is not null").select(asset_key(F.col("base")).alias("asset_key"), asset_key(F.col("url")).alias("to")).distinct()
    known = seeds.select("page_id", asset_key(F.col("url")).alias("asset_key")).distinct().withColumn("round", F.lit(0))
    new = known
    for k in range(1, max_rounds + 1):
        further = new.join(links, "asset_key").select("page_id", F.col("to").alias("asset_key")).distinct().join(known, ["page_id", "asset_key"], "left_anti").withColumn("round", F.lit(k))
        further = further.checkpoint() if further.sparkSession.sparkContext.getCheckpointDir() else further.cache()
        if further.isEmpty():
            break
        known, new = known.unionByName(further), further
    return known
