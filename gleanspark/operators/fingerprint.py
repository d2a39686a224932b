"""Technologies told by patterns in scripts: matching, score, version, merge and quality gate.

All patterns become literal conditions of one projection, so a text is read once and no product of texts and patterns
is ever made; only matches leave it. One shuffle groups them by context and technology.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.functions import fixed_values as V
from gleanspark.functions.columns import any_of, clamp, java_pattern, lookup, normalize_version, valid_version
from gleanspark.functions.fingerprints import FINGERPRINTS
from gleanspark.session import literal

MIN_SCORE = 45.0
UNKNOWN = "Unknown"

# Markers that tell a bootstrap, hints of bundled files, weight of a version's source.
BOOTSTRAP_MARKERS = ("__webpack_require__", "__vite__", "webpackJsonp", "__NEXT_DATA__", "__NUXT__")
BUNDLE_HINTS = (".chunk.", "-chunk-", ".vendor.", "-vendor-", ".bundle.", "-bundle-")
VERSION_MULTIPLIERS = {"inline": 1.0, "global": 1.15, "metadata": 1.1, "sourcemap": 0.95, "minified": 0.9, "bundle": 0.85}


@dataclass(frozen=True)
class Pattern:
    technology: str
    matcher: str
    pattern: str
    weight: float
    flags: str = ""


def fingerprint_patterns() -> list[Pattern]:
    return [Pattern(t, k, p, float(w), f) for t, _, _, _, patterns, _ in FINGERPRINTS for k, w, p, f in patterns]


def version_patterns() -> list[Pattern]:
    return [Pattern(t, k, p, float(w), f) for t, _, _, _, _, patterns in FINGERPRINTS for k, w, p, f in patterns]


def weak_pattern(matcher: str, pattern: str) -> bool:
    low = pattern.lower()
    return f"{matcher}/{low}" in V.WEAK_PATTERNS or matcher == "global" and len(pattern.strip()) <= 2


def strong_pattern(matcher: str, pattern: str) -> bool:
    low = pattern.lower()
    if f"{matcher}/{low}" in V.STRONG_PATTERNS:
        return True
    if matcher == "regex":
        return pattern.startswith("__") or any(x in low for x in ("reconcilerversion", "window\\.next", "/_next/static/"))
    return matcher == "string" and (pattern.startswith(("__", "@")) or "version" in low or ".production." in low)


def evidence_tier(matcher: str, pattern: str, weight: float) -> str:
    """low, medium or high: how much one piece of evidence proves."""
    if weak_pattern(matcher, pattern):
        return "low"
    if strong_pattern(matcher, pattern) or matcher == "regex" and weight >= 25:
        return "high"
    return "medium" if weight >= 30 else "low"


def matches(p: Pattern) -> Column:
    """The condition of one pattern on a context's content, filename, url and source_map_url."""
    content = F.coalesce(F.col("content"), F.lit(""))
    name, url = F.lower(F.coalesce("filename", F.lit(""))), F.lower(F.coalesce("url", F.lit("")))
    if p.matcher == "string":
        return content.contains(p.pattern)
    if p.matcher == "regex":
        return content.rlike(java_pattern(p.pattern, p.flags))
    if p.matcher == "filename":
        low = p.pattern.lower()
        if low.startswith("re:"):
            return name.rlike(java_pattern(low[3:], "i")) | url.rlike(java_pattern(low[3:], "i"))
        found = name.contains(low) | url.contains(low)
        if low == "chunk":
            return found | name.contains("webpack") | url.contains("webpack")
        if low in ("vendor", "bundle"):
            return found | any_of([x.contains(h) for x in (name, url) for h in BUNDLE_HINTS])
        return found
    if p.matcher == "sourcemap":
        both = F.concat_ws("\n", F.col("source_map_url"), content)
        there = F.col("source_map_url").isNotNull() | content.contains("sourceMappingURL=")
        return there & (both.rlike(java_pattern(p.pattern[3:], "i")) if p.pattern.startswith("re:") else F.lower(both).contains(p.pattern.lower()))
    if p.matcher != "global":
        raise ValueError(f"no matcher {p.matcher}")
    if len(p.pattern.strip()) <= 2:
        return F.lit(False)
    n = re.escape(p.pattern)
    found = content.rlike(java_pattern(rf"\b(?:var|let|const)\s+{n}\b|\b(?:window|self|globalThis)\.{n}\b|\b{n}\s*[.=]"))
    if p.pattern in BOOTSTRAP_MARKERS:
        found = content.contains(p.pattern) | found
    if p.pattern == "webpackBootstrap":
        found = found | content.contains("__webpack_require__") | content.contains("webpackJsonp")
    if p.pattern == "viteBootstrap":
        found = found | content.contains("__vite__") | content.contains("import.meta.hot")
    return found


def pattern_matches(contexts: DataFrame, patterns: list[Pattern] | None = None) -> DataFrame:
    """page_id, ctx_id, url, filename, and technology, matcher, pattern, weight, weak, strong, tier of each match."""
    patterns = fingerprint_patterns() if patterns is None else patterns
    rows = [(k, p.technology, p.matcher, p.pattern, p.weight, weak_pattern(p.matcher, p.pattern), strong_pattern(p.matcher, p.pattern), evidence_tier(p.matcher, p.pattern, p.weight)) for k, p in enumerate(patterns)]
    about = literal(contexts.sparkSession, rows, "k int, technology string, matcher string, pattern string, weight double, weak boolean, strong boolean, tier string")
    hit = F.array_compact(F.array(*[F.when(matches(p), F.lit(k)) for k, p in enumerate(patterns)]))
    found = contexts.withColumn("_hits", hit).where(F.size("_hits") > 0).select("page_id", "ctx_id", "url", "filename", F.explode("_hits").alias("k"))
    return found.join(F.broadcast(about), "k").drop("k")


def context_versions(contexts: DataFrame) -> DataFrame:
    """page_id, ctx_id, technology, version, version_weight: the best valid version of each context and technology."""
    found = []
    for p in version_patterns():
        raw = F.regexp_extract(F.coalesce("content", F.lit("")), java_pattern(p.pattern, p.flags), 1)
        confidence = p.weight * VERSION_MULTIPLIERS.get(p.matcher, 1.0)
        found.append(F.when(valid_version(raw), F.struct(F.lit(confidence).alias("confidence"), F.lit(p.weight).alias("version_weight"), F.lit(p.technology).alias("technology"), normalize_version(raw).alias("version"))))
    rows = contexts.select("page_id", "ctx_id", F.explode(F.array_compact(F.array(*found))).alias("v")).select("page_id", "ctx_id", "v.*")
    best = F.max_by(F.struct("version", "version_weight"), F.struct("confidence", "version_weight", "version")).alias("b")
    return rows.groupBy("page_id", "ctx_id", "technology").agg(best).select("page_id", "ctx_id", "technology", "b.version", "b.version_weight")


def scores(found: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """One row by context and technology: confidence and the evidence counts behind it."""
    weighted = F.col("weight") * lookup(F.col("matcher"), V.MATCHER_MULTIPLIERS, 1.0)
    keys = ["page_id", "ctx_id", "technology"]
    own = found.groupBy(*keys).agg(
        F.sum(weighted).alias("raw"),
        F.count(F.lit(1)).alias("n"),
        F.count_if("strong").alias("n_strong"),
        F.count_if("weak").alias("n_weak"),
        F.count_if(F.col("tier") == "high").alias("n_high"),
        F.count_if(F.col("tier") != "low").alias("n_medium_high"),
        F.count_if(F.col("matcher") == "filename").alias("n_filename"),
        F.array_sort(F.collect_list(F.struct("matcher", "pattern", "weight"))).alias("evidence"),
    )
    base = F.least(F.lit(100.0), F.col("raw") * 1.15)
    if versions is not None:
        own = own.join(versions, keys, "left")
        base = F.when(F.col("version").isNotNull(), F.least(F.lit(100.0), base + F.least(F.lit(20.0), F.col("version_weight") * 0.6))).otherwise(base)
    else:
        own = own.withColumn("version", F.lit(None).cast("string"))
    several = F.when(F.col("n") >= 2, F.least(F.lit(100.0), base * 1.08)).otherwise(base)
    judged = (
        F.when(F.col("n_strong") >= 2, F.least(F.lit(100.0), several * 1.12))
        .when(F.col("n_strong") == 1, F.least(F.lit(100.0), several * 1.08))
        .when((F.col("n") == 1) & (F.col("n_filename") == 1), several * 0.65)
        .when((F.col("n") == 1) & (F.col("n_weak") == 1), several * 0.4)
        .otherwise(several)
    )
    prior = lookup(F.col("technology"), {t: float(c) for t, _, _, c, _, _ in FINGERPRINTS}, 0.0)
    return own.withColumn("confidence", F.round(clamp(judged * 0.82 + prior * 0.18), 2)).withColumn("version", F.coalesce("version", F.lit(UNKNOWN)))


def merged(scored: DataFrame, keys: tuple[str, ...] = ("page_id", "technology")) -> DataFrame:
    """Matches of a technology in several contexts as one: the best one's figures, more for each further context."""
    known = F.when(F.col("version") != UNKNOWN, F.col("version"))
    n = F.col("contexts")
    return (
        scored.groupBy(*keys)
        .agg(
            F.max("confidence").alias("top"),
            F.count(F.lit(1)).alias("contexts"),
            F.coalesce(F.max_by(known, F.struct(known.isNotNull(), "confidence", "ctx_id")), F.lit(UNKNOWN)).alias("version"),
            F.max("n_high").alias("n_high"),
            F.max("n_medium_high").alias("n_medium_high"),
            F.max(F.col("n") - F.col("n_weak")).alias("n_not_weak"),
        )
        .withColumn("confidence", F.round(F.least(F.lit(100.0), F.col("top") + F.least(F.lit(10.0), 2.0 * (n - 1))), 1))
        .drop("top")
    )


def gated(detections: DataFrame, providers: Column | None = None) -> DataFrame:
    """Adds confirmed: whether the evidence suffices (both outcomes stay; filter by it to part them)."""
    c = F.col("confidence")
    several = (providers >= 2) if providers is not None else F.lit(False)
    enough = (F.col("n_high") > 0) | (F.col("n_not_weak") > 0) & (several | (F.col("n_medium_high") >= 2) | (F.col("n_medium_high") == 1) & (c >= 70))
    return detections.withColumn("confirmed", (c >= 50) & ((F.col("version") != UNKNOWN) | enough))


def detect(contexts: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """contexts: page_id, ctx_id, url, filename, content, source_map_url. Returns one row by page and technology."""
    scored = scores(pattern_matches(contexts), context_versions(contexts)).where(F.col("confidence") >= min_score)
    return gated(merged(scored))


def ranked_versions(candidates: DataFrame, keys: tuple[str, ...] = ("page_id", "technology")) -> DataFrame:
    """The best version by confidence, then weight, then text."""
    best = Window.partitionBy(*keys).orderBy(F.desc("confidence"), F.desc("weight"), "version")
    return candidates.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")
