"""Technologies told by rules over pieces of evidence, and by the names that evidence carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.functions import fixed_values as V
from gleanspark.functions import identities as N
from gleanspark.functions.columns import clamp, host, java_pattern, lookup, plain_text
from gleanspark.functions.signatures import SIGNATURES
from gleanspark.session import literal

MIN_CONFIDENCE = 25.0
# Evidence types that a rule's target takes.
TARGETS = {
    "runtime": ("runtime_pattern",),
    "package": ("package_reference", "package_marker", "import_export"),
    "banner": ("banner",),
    "manifest": ("manifest",),
    "bundle": ("bundle_runtime", "bundle_marker"),
    "header": ("http_header", "http_metadata"),
    "html": ("html_element", "script_reference"),
    "metadata": ("metadata",),
    "sourcemap": ("source_map", "source_map_metadata"),
    "version": ("version_candidate",),
}
Rule = tuple[str, str, str, str, float, str]  # technology, role, target, matcher, weight, pattern


def signature_rules() -> list[Rule]:
    """The signatures' rules; required patterns are regexes over any evidence with a weight of 1."""
    out: list[Rule] = []
    for tech, _, _, _, required, optional, negative, _, _ in SIGNATURES:
        out += [(tech, "required", "content", "regex", 1.0, p) for p in required]
        for role, rules in (("optional", optional), ("negative", negative)):
            out += [(tech, role, t, "contains", float(w), p) for t, w, p in rules]
    return out


def target_takes(target: str) -> Column:
    kind = F.col("evidence_type")
    if target in TARGETS:
        return kind.isin(*TARGETS[target])
    if target == "filename":
        return F.coalesce(F.col("file"), F.lit("")) != ""
    if target == "url":
        return F.coalesce(F.col("url"), F.lit("")) != ""
    if target.startswith("evidence:"):
        return kind == target.split(":", 1)[1]
    return F.lit(True)


def rule_matches(target: str, matcher: str, pattern: str) -> Column:
    """The condition of one rule on a piece of evidence that `readied` has seen."""
    meta = F.col("_meta")
    hay = F.col({"filename": "_file", "url": "_url", "metadata": "_values"}.get(target, "_plain"))
    low = pattern.lower()
    found = {
        "contains": lambda: hay.contains(low),
        "string": lambda: hay.contains(low),
        "equals": lambda: hay == low,
        "regex": lambda: hay.rlike(java_pattern(pattern, "i")),
        "metadata_key": lambda: F.array_contains(F.map_keys(meta), pattern),
        "metadata_value": lambda: F.exists(F.map_values(meta), lambda v: F.lower(v) == low),
        "runtime_family": lambda: F.lower(F.element_at(meta, "runtime_family")) == low,
    }[matcher]()
    return target_takes(target) & found


def readied(evidence: DataFrame) -> DataFrame:
    """Adds the texts that rules look at, each made once: evidence_type, value, file, url, metadata (map) are given."""
    meta = F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>"))
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return evidence.withColumns({"_meta": meta, "_file": low("file"), "_url": low("url"), "_values": F.lower(F.array_join(F.map_values(meta), " ")), "_plain": plain_text(F.coalesce("value", F.lit("")))})


def matched_rules(evidence: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, evidence_id, source, url, file, evidence_type with technology, role, rule and weight of each match.

    The rules are literal conditions of one projection: no join of evidence and rules.
    """
    about = literal(evidence.sparkSession, [(k, r[0], r[1], r[4]) for k, r in enumerate(rules)], "rule int, technology string, role string, rule_weight double")
    hits = F.array_compact(F.array(*[F.when(rule_matches(r[2], r[3], r[5]), F.lit(k)) for k, r in enumerate(rules)]))
    found = readied(evidence).withColumn("_hits", hits).where(F.size("_hits") > 0).withColumn("rule", F.explode("_hits")).drop("_hits")
    base = lookup(F.col("evidence_type"), V.EVIDENCE_WEIGHTS, 20.0)
    out = found.join(F.broadcast(about), "rule").withColumn("weight", F.greatest(F.lit(0.1), F.col("rule_weight") * base / 100))
    return out.select("page_id", "evidence_id", "source", "url", "file", "evidence_type", "technology", "role", "rule", "weight").distinct()


def evaluated(found: DataFrame, signatures: DataFrame) -> DataFrame:
    """signatures: technology, n_required, minimum, priority. Raw score, rejection and confidence by page and technology."""
    support = F.col("role") != "negative"
    where = F.when(F.coalesce(F.col("url"), F.lit("")) == "", "unknown").when(F.col("url").startswith("inline://"), "inline").otherwise(F.coalesce(F.nullif(host(F.col("url")), F.lit("")), F.lit("unknown")))
    resource = lambda c: F.collect_set(F.when(support & (F.coalesce(F.col(c), F.lit("")) != ""), F.col(c)))
    per = found.groupBy("page_id", "technology").agg(
        F.sum(F.when(support, F.col("weight")).otherwise(0.0)).alias("raw_score"),
        F.count_if(support).alias("n_matches"),
        F.count_if(F.col("role") == "required").alias("required_pairs"),
        F.count_if(F.col("role") == "negative").alias("negative_pairs"),
        F.count_distinct(F.when(support, F.col("source"))).alias("sources"),
        F.count_distinct(F.when(support, where)).alias("domains"),
        F.count_distinct(F.when(support, F.col("evidence_type"))).alias("types"),
        F.size(F.array_union(resource("url"), resource("file"))).alias("resources"),
    )
    per = per.join(F.broadcast(signatures), "technology")
    missing = F.col("required_pairs") < F.col("n_required")
    negative, low = F.col("negative_pairs") > 0, F.col("raw_score") < F.col("minimum")
    reason = (
        F.when(negative & (F.col("required_pairs") > 0) & low, "negative_low_score")
        .when(negative & (F.col("required_pairs") == 0), "negative_without_required")
        .when(missing, "required_missing")
        .when(low, "below_minimum")
    )
    bonus = 5 * F.col("sources") + 3 * F.greatest(F.lit(0), F.col("resources") - 1) + 2 * F.greatest(F.lit(0), F.col("domains") - 1) + 1.5 * F.greatest(F.lit(0), F.col("types") - 2)
    bonus = F.when(F.col("n_matches") > 1, F.least(F.lit(25.0), bonus)).otherwise(0.0)
    first = F.round(clamp(F.least(F.lit(75.0), F.col("raw_score")) + bonus + F.least(F.lit(10.0), F.col("priority") / 10)), 1)
    more = F.when(F.col("sources") >= 2, F.least(F.lit(12.0), 4.0 * (F.col("sources") - 1))).otherwise(0.0)
    more = more + F.when(F.col("resources") >= 2, F.least(F.lit(8.0), 2.0 * (F.col("resources") - 1))).otherwise(0.0)
    final = F.round(clamp(first + more - F.least(F.lit(15.0), 5.0 * F.col("negative_pairs"))), 1)
    confidence = F.when(reason.isNotNull() | (F.col("n_matches") == 0), 0.0).otherwise(F.when(final < MIN_CONFIDENCE, 0.0).otherwise(final))
    return per.select("page_id", "technology", F.round("raw_score", 4).alias("raw_score"), "required_pairs", "negative_pairs", reason.alias("rejected"), confidence.alias("confidence"))


def signature_table(spark) -> DataFrame:  # noqa: ANN001
    rows = [(t, len(req), float(m), float(p)) for t, _, p, m, req, _, _, _, _ in SIGNATURES]
    return literal(spark, rows, "technology string, n_required int, minimum double, priority double")


def by_signatures(evidence: DataFrame) -> DataFrame:
    """Technologies that the signature catalog accepts, by page."""
    return evaluated(matched_rules(evidence, signature_rules()), signature_table(evidence.sparkSession)).where("confidence > 0")


def reduced(evaluations: DataFrame) -> DataFrame:
    """Accepted evaluations only, the highest raw score of a page's technology."""
    return evaluations.where("rejected is null").groupBy("page_id", "technology").agg(F.max("raw_score").alias("raw_score"), F.max_by("confidence", "raw_score").alias("confidence"))


def package_key(value: Column) -> Column:
    """What follows node_modules/; scoped names keep two parts, others one; lower case."""
    path = F.regexp_replace(F.lower(F.trim(value)), r"^.*node_modules/", "")
    scoped = F.regexp_extract(path, r"^(@[^/]+/[^/]+)", 1)
    return F.when(scoped != "", scoped).otherwise(F.regexp_extract(path, r"^([^/]+)", 1))


def package_identity(value: Column) -> Column:
    """The technology of a package, package:<key> for others that look like packages, else null."""
    raw, key = F.lower(F.trim(value)), package_key(value)
    odd = raw.rlike(r"^\.{0,2}/|^[a-z][a-z0-9+.\-]*://|[\s\\?#`$]|\{\{") | (F.char_length(raw) > 214)
    known = F.coalesce(lookup(raw, N.PACKAGE_NAMES), lookup(F.regexp_extract(raw, r"^([^/]+/[^/]+)", 1), N.PACKAGE_NAMES), lookup(key, N.PACKAGE_NAMES))
    shaped = key.rlike(r"^(@[a-z0-9~-][a-z0-9._~-]*/)?[a-z0-9~-][a-z0-9._~-]*$") & ~key.rlike(r"^v?\d+(\.\d+)*$") & (F.char_length(key) >= 2)
    file = key.rlike(r"\.(js|mjs|cjs|css|json|map|ts|tsx|jsx)$") & ~raw.contains("node_modules/")
    blocked = key.isin(*sorted(N.INVALID_PACKAGE_NAMES))
    return F.when(odd, None).when(known.isNotNull(), known).when(shaped & ~file & ~blocked, F.concat(F.lit("package:"), key))


def header_identity(header: Column, value: Column) -> Column:
    """The technology of an identifying header: by the fixed list, else http:<product>."""
    h, v = F.lower(header), F.lower(F.coalesce(value, F.lit("")))
    known = F.coalesce(*[F.when((h == a) & v.contains(b), F.lit(c)) for a, b, c in N.HEADER_NAMES])
    product = F.regexp_extract(v, r"^\s*([a-z][a-z0-9._-]{2,})", 1)
    dull = product.isin("http", "https", "none", "null", "server", "true", "false", "unknown", *sorted(N.CONSERVATIVE_PACKAGE_NAMES))
    return F.when(h.isin(*sorted(N.IDENTITY_HEADERS)), F.coalesce(known, F.when((product != "") & ~dull, F.concat(F.lit("http:"), product))))


def identities(evidence: DataFrame) -> DataFrame:
    """evidence with identity: the technology (or open name) that each piece names; pieces without one are left out."""
    kind, value = F.col("evidence_type"), F.col("value")
    meta = lambda k: F.lower(F.element_at(F.col("metadata"), k))
    marker = F.coalesce(lookup(value, N.BUNDLE_MARKER_NAMES), lookup(F.lower(value), {k.lower(): v for k, v in N.BUNDLE_MARKER_NAMES.items()}))
    bundler = F.coalesce(meta("bundler"), F.lower(value))
    runtime = F.coalesce(meta("runtime_family"), F.lower(value))
    first = F.regexp_extract(F.lower(value), r"^\s*([a-z][a-z0-9.]*)", 1)
    css = F.nullif(F.trim(meta("css_family")), F.lit(""))
    found = (
        F.when(kind.isin("package_reference", "package_marker", "import_export"), package_identity(value))
        .when(kind == "runtime_pattern", F.coalesce(lookup(runtime, N.RUNTIME_NAMES), F.when(meta("runtime_family").isNotNull() & ~runtime.isin(*sorted(N.CONSERVATIVE_PACKAGE_NAMES)), F.concat(F.lit("runtime:"), runtime))))
        .when(kind.isin("bundle_runtime", "bundle_marker"), F.coalesce(lookup(bundler, N.BUNDLER_NAMES), marker))
        .when(kind.isin("http_header", "http_metadata"), header_identity(meta("header"), value))
        .when(kind == "css_marker", F.coalesce(lookup(css, N.CSS_NAMES), F.when(~css.isin(*sorted(N.GENERIC_CSS_SELECTORS | N.CONSERVATIVE_PACKAGE_NAMES)), F.concat(F.lit("css:"), css))))
        .when(kind.isin("html_element", "html_marker"), F.coalesce(lookup(first, N.HTML_NAMES), F.when((F.char_length(first) >= 3) & ~first.isin(*sorted(N.GENERIC_HTML_ELEMENTS | N.CONSERVATIVE_PACKAGE_NAMES)), F.concat(F.lit("html:"), first))))
    )
    return evidence.withColumn("identity", found).where("identity is not null")


# What a candidate's best piece of evidence is worth by its type, and all others.
CANDIDATE_WEIGHTS = {
    "package_reference": 85.0,
    "runtime_pattern": 80.0,
    "import_export": 70.0,
    "bundle_marker": 75.0,
    "bundle_runtime": 75.0,
    "http_header": 70.0,
    "package_marker": 55.0,
    "ast_extraction": 50.0,
    "source_map_metadata": 65.0,
    "css_marker": 80.0,
    "html_marker": 80.0,
}
OTHER_WEIGHT = 40.0
# Which kind of discovery a piece of evidence is: two kinds confirm each other.
DISCOVERY = {"package_reference": "package", "package_marker": "package", "import_export": "package", "runtime_pattern": "runtime", "bundle_runtime": "bundle", "bundle_marker": "bundle", "http_header": "http", "http_metadata": "http", "css_marker": "css", "html_element": "html", "html_marker": "html"}


def candidates(evidence: DataFrame) -> DataFrame:
    """Technologies by name: score, whether known, and whether the evidence is enough (known 55, open 70 at least).

    The score is the best piece's weight, 5 for each further type (15 at most), 10 if two kinds of discovery agree, a
    twentieth of the highest confidence hint (metadata `confidence_hint`; 5 at most), less 5 for names not in the catalog.
    """
    hint = F.coalesce(F.expr("try_cast(metadata['confidence_hint'] AS double)"), F.lit(0.0))
    named = identities(evidence).withColumns({"base": lookup(F.col("evidence_type"), CANDIDATE_WEIGHTS, OTHER_WEIGHT), "_kind": lookup(F.col("evidence_type"), DISCOVERY), "_hint": hint})
    known = ~F.col("identity").contains(":")
    per = named.groupBy("page_id", "identity").agg(F.max("base").alias("best"), F.count_distinct("evidence_type").alias("types"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("evidence_type") == "package_reference").alias("packages"), F.count_if(F.col("base") >= 70).alias("strong"), F.count_distinct("_kind").alias("_kinds"), F.max("_hint").alias("_hint"))
    score = F.least(F.lit(100.0), F.col("best") + F.least(F.lit(15.0), 5.0 * (F.col("types") - 1)) + F.when(F.col("_kinds") >= 2, 10.0).otherwise(0.0) + F.least(F.lit(5.0), F.col("_hint") / 20) - F.when(known, 0.0).otherwise(5.0))
    open_ok = (F.col("score") >= 70) & (~F.col("identity").startswith("package:") | (F.col("packages") > 0) | (F.col("strong") >= 2))
    return per.withColumn("score", F.round(score, 1)).drop("_kinds", "_hint").withColumn("known", known).withColumn("accepted", F.when(known, F.col("score") >= 55).otherwise(open_ok))
