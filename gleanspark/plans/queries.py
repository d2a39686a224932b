"""The named queries of the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.functions import columns as C
from gleanspark.functions import fixed_values as V
from gleanspark.operators import artifacts, evidence, findings, fingerprint, http, intelligence, javascript, ownership, pages, providers, rules, scan, script_findings, sensitive, styles
from gleanspark.plans.fixtures import frame
from gleanspark.session import few_rows_a_batch, stored
from gleanspark.sources import html, sinks, source_maps

Query = Callable[[SparkSession, str], DataFrame]

RULES = [
    rules.PageRule("has-react", "string", "React.createElement", "React used", "TECHNOLOGY", severity="LOW", confidence=80.0),
    rules.PageRule("version-set", "regex", r"(\w+)\.version\s*=\s*\"[\d.]+\"", "Version set"),
    rules.PageRule("bundle-name", "regex", r"bundle", "Bundle", target="filename", flags="i"),
    rules.PageRule("has-react", "string", "nothing here", "Second of its id"),
    rules.PageRule("off", "string", "nothing here", "Off", enabled=False),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.parsed(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: all metadata analyzers over all pages."""
    return findings.deduplicated(pages.metadata_findings(_pages(spark, sf_dir))).drop("finding_id")


def _page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.metadata_findings(_pages(spark, sf_dir))


def _document_values(kind: str, table: str = "documents", key: str = "doc_id", text: str = "text") -> Query:
    return lambda s, d: scan.contact_counts(_table(s, d, table), kind, key, text)


def _entropy_tokens(s: SparkSession, d: str) -> DataFrame:
    rows = _table(s, d, "documents").select("doc_id", F.explode(scan.values(F.col("text"), scan.ENTROPY_ASSIGNMENT, "i", 1)).alias("value"))
    return rows.where(C.entropy(F.col("value")) >= scan.ENTROPY_THRESHOLD).select("doc_id", "value", F.round(C.entropy(F.col("value")), 4).alias("entropy"), C.redact(F.col("value")).alias("shown"))


def _anchor_inventory(s: SparkSession, d: str) -> DataFrame:
    rows = _pages(s, d).select("page_id", F.col("url").alias("base"), F.lit("anchor").alias("source"), F.explode("page.anchors").alias("href"))
    return pages.inventory(pages.resolved(rows))


#: Ids of the literal edge cases begin here, beyond those of the tables that they are put to.
CASES = 1_000_000_000
#: Numbers of a page's scripts are below it.
SCRIPTS = 1000


def _with_cases(s: SparkSession, name: str, key: str, real: DataFrame) -> DataFrame:
    """A table's rows and the literal edge cases of the same columns."""
    cases = frame(s, name)
    return real.select(*cases.columns).unionByName(cases.withColumn(key, F.col(key) + CASES))


def _script_texts(s: SparkSession, d: str) -> DataFrame:
    return pages.inline_script_texts(_pages(s, d)).withColumn("script_id", F.col("page_id") * SCRIPTS + F.col("index"))


def _scripts(s: SparkSession, d: str) -> DataFrame:
    """script_id, url, content: inline scripts of all pages, and cases."""
    return _with_cases(s, "scripts", "script_id", _script_texts(s, d))


def _sources(s: SparkSession, d: str) -> DataFrame:
    """script_id, content: inline scripts of all pages, and cases."""
    return _with_cases(s, "script_sources", "script_id", _script_texts(s, d))


def _maps(s: SparkSession, d: str) -> DataFrame:
    """map_id, text: the maps that inline scripts of all pages carry, and cases."""
    inline = source_maps.inline_maps(_script_texts(s, d)).withColumn("map_id", F.col("script_id") * SCRIPTS + F.col("position"))
    return _with_cases(s, "source_maps", "map_id", inline)


def _contexts(s: SparkSession, d: str) -> DataFrame:
    """Inline scripts of all pages as what patterns and rules look at, and cases."""
    nothing = F.lit(None).cast("string")
    real = _script_texts(s, d).withColumns({"ctx_id": F.col("script_id"), "filename": nothing, "source_map_url": nothing})
    return _with_cases(s, "contexts", "page_id", real)


#: Pages sent to Python at once where what they show is stored.
PAGES_A_BATCH = 512


def _script_evidence(s: SparkSession, d: str) -> DataFrame:
    """What the inline scripts of all pages show, as evidence for technologies.

    It is stored, so that pages are parsed once however often it is used, and few at a time: a worker holds no more of
    a large task than of a small one.
    """
    with few_rows_a_batch(s, PAGES_A_BATCH):
        shown = stored(javascript.script_evidence(_script_texts(s, d)), "script-evidence")
    kind, key = F.col("evidence_type"), F.col("key")
    name = F.when(kind == "runtime_pattern", "runtime_family").when(kind == "bundle_runtime", "bundler").otherwise("technology")
    return shown.withColumns(
        {
            "page_id": F.floor(F.col("script_id") / SCRIPTS).cast("long"),
            "evidence_id": F.concat_ws(":", F.col("script_id").cast("string"), kind, key),
            "source": F.lit("javascript"),
            "url": F.concat(F.lit("inline://"), F.col("script_id").cast("string")),
            "file": F.lit(None).cast("string"),
            "metadata": F.create_map(name, key),
            "technology": F.lit(None).cast("string"),
        }
    )


def _evidence(s: SparkSession, d: str) -> DataFrame:
    """What the inline scripts of all pages show, and cases."""
    return _with_cases(s, "evidence", "page_id", _script_evidence(s, d))


def _case(s: SparkSession, name: str, *keys: str) -> DataFrame:
    """Literal edge cases only, with the ids that they have beside a table's rows."""
    return frame(s, name).withColumns({k: F.col(k) + CASES for k in keys})


def _evidence_owners(s: SparkSession, d: str) -> DataFrame:
    """Whose the evidence of all pages' scripts is, among the technologies that signatures find there, and cases."""
    real = _script_evidence(s, d)
    columns = ["page_id", "technology"]
    detections = evidence.by_signatures(real.drop("technology")).select(*columns).unionByName(_case(s, "owned_detections", "page_id"))
    return ownership.evidence_ownership(_with_cases(s, "owned_evidence", "page_id", real), detections, _case(s, "owned_matches", "page_id"))


def _resources(s: SparkSession, d: str) -> DataFrame:
    """page_id, asset_id, url, filename, content: inline scripts of all pages, and cases."""
    number = F.col("index").cast("string")
    real = _script_texts(s, d).select("page_id", F.col("script_id").alias("asset_id"), F.concat(F.lit("inline://script/"), number).alias("url"), F.concat(F.lit("inline-"), number, F.lit(".js")).alias("filename"), "content")
    return real.unionByName(_case(s, "resources", "page_id", "asset_id"))


def _scopes(s: SparkSession, d: str) -> DataFrame:
    """Detections with what they came from: technologies that a page's own address names, from nowhere, and cases."""
    cases = _case(s, "scopes", "page_id")
    named = _table(s, d, "pages").select("page_id", C.asset_key(F.col("url")).alias("asset_key")).join(_page_owners(s, d), "asset_key")
    nothing = {c: F.lit(None).cast(cases.schema[c].dataType) for c in ("url", "filename", "resources", "evidence_files")}
    return named.select("page_id", "technology").withColumns(nothing).unionByName(cases)


def _page_owners(s: SparkSession, d: str) -> DataFrame:
    """Technologies that the addresses of pages, of what they link to, and of cases name."""
    linked = _anchor_inventory(s, d).select(F.col("asset_key").alias("url"))
    assets = _table(s, d, "pages").select("url").unionByName(linked).withColumn("filename", C.filename(F.col("url")))
    return ownership.asset_owners(assets.unionByName(frame(s, "owner_assets")))


def _extracted(s: SparkSession, d: str) -> DataFrame:
    resources = _resources(s, d)
    hits = javascript.version_hits(resources.withColumnRenamed("asset_id", "script_id")).withColumnRenamed("script_id", "asset_id")
    return ownership.extracted_candidates(hits, resources, _scopes(s, d))


def _style_evidence(s: SparkSession, d: str) -> DataFrame:
    """What the inline style sheets of all pages show, and cases."""
    nothing = F.lit(None).cast("string")
    sheets = _pages(s, d).select("page_id", F.posexplode("page.styles").alias("index", "content"))
    real = sheets.withColumns({"style_id": (F.col("page_id") * SCRIPTS + F.col("index")).cast("long"), "url": nothing, "filename": nothing})
    return styles.style_evidence(_with_cases(s, "sheets", "style_id", real))


def _intelligence_records(s: SparkSession) -> DataFrame:
    return intelligence.evidence_records(frame(s, "intelligence_matches"), frame(s, "intelligence_assets"))


def _secret_texts(s: SparkSession, d: str) -> DataFrame:
    """All turns of all conversations, and cases."""
    turns = _table(s, d, "conversations").select(F.col("conv_id").alias("page_id"), F.concat_ws(":", "role", F.col("turn").cast("string")).alias("source"), "text")
    return _with_cases(s, "secret_texts", "page_id", turns)


def _assignments(s: SparkSession, d: str) -> DataFrame:
    """All documents, and cases."""
    return _with_cases(s, "assignments", "page_id", _table(s, d, "documents").select(F.col("doc_id").alias("page_id"), "text"))


def _artifact_texts(s: SparkSession, d: str) -> DataFrame:
    """All pages, and cases."""
    return _with_cases(s, "artifact_texts", "page_id", _table(s, d, "pages").select("page_id", F.lit("html").alias("source"), F.col("html").alias("text")))


def _assessed(s: SparkSession, d: str) -> DataFrame:
    return artifacts.with_risk(artifacts.artifact_references(_artifact_texts(s, d)))


def _judged(s: SparkSession, d: str) -> DataFrame:
    return sensitive.judged(sensitive.signalled(sensitive.sensitive_hits(_secret_texts(s, d))))


def _calibrated(s: SparkSession, d: str) -> DataFrame:
    found = _judged(s, d)
    return sensitive.calibrated(found, sensitive.pairs(found), sensitive.database_triples(found))


def _evaluated(s: SparkSession, d: str) -> DataFrame:
    return evidence.evaluated(evidence.matched_rules(_evidence(s, d), evidence.signature_rules()), evidence.signature_table(s))


def _reachable(s: SparkSession, d: str) -> DataFrame:
    """From each page to the scripts that its own ones name, and from the first case on."""
    scripts = _scripts(s, d)
    seeds = scripts.where(F.col("script_id") == CASES + 1).select(F.lit(CASES + 1).cast("long").alias("page_id"), "url").unionByName(_table(s, d, "pages").select("page_id", "url"))
    return javascript.reachable(seeds, scripts)


def _hash_counts(s: SparkSession, d: str) -> DataFrame:
    rows = pages.duplicates(_table(s, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return rows.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


QUERIES: dict[str, Query] = {
    "page_findings": page_findings,
    "html_title_lang": lambda s, d: _pages(s, d).select("page_id", F.col("page.title").alias("title"), F.col("page.language").alias("language"), F.col("page.charset").alias("charset")),
    "html_comments": lambda s, d: pages.comments(_pages(s, d)),
    "html_anchors": lambda s, d: pages.anchors(_pages(s, d)),
    "inline_scripts": lambda s, d: pages.inline_scripts(_pages(s, d)),
    "page_styles": lambda s, d: _pages(s, d).select("page_id", F.posexplode("page.styles").alias("index", "content")),
    "anchor_inventory": _anchor_inventory,
    "asset_category_summary": lambda s, d: _anchor_inventory(s, d).groupBy("category").agg(F.count(F.lit(1)).alias("n_assets"), F.sum("n_references").alias("n_references")),
    "url_normalize": lambda s, d: _table(s, d, "pages").select("page_id", C.normalize_url(F.col("url")).alias("normalized"), C.asset_key(F.col("url")).alias("asset_key"), C.filename(F.col("url")).alias("filename")),
    "url_cases": lambda s, d: frame(s, "urls").select("id", C.normalize_url(F.col("url")).alias("normalized"), C.validate_url(F.col("url")).alias("valid"), C.filename(F.col("url")).alias("filename")),
    "url_host_counts": lambda s, d: pages.host_counts(_table(s, d, "pages")),
    "well_known_targets": lambda s, d: pages.well_known(_table(s, d, "pages")),
    "duplicate_of": lambda s, d: pages.duplicates(_table(s, d, "documents").select("doc_id", "text"), "doc_id", "text"),
    "content_hash_dedupe": _hash_counts,
    "sens_email": _document_values("email"),
    "sens_ip_documents": _document_values("ipv4"),
    "sens_phone": _document_values("phone"),
    "sens_domain": _document_values("domain"),
    "sens_domain_pages": _document_values("domain", "pages", "page_id", "html"),
    "sens_url_pages": _document_values("external-url", "pages", "page_id", "html"),
    "sens_uuid_conversations": _document_values("uuid", "conversations", "conv_id", "text"),
    "contact_hits": lambda s, d: scan.contact_hits(_table(s, d, "documents").select("doc_id", "text")),
    "contact_candidates": lambda s, d: sensitive.contact_candidates(_table(s, d, "documents").select("doc_id", "text")),
    "entropy_tokens": _entropy_tokens,
    "finding_statistics": lambda s, d: findings.statistics(_page_findings(s, d)),
    "finding_stats_by_category": lambda s, d: findings.counts(_page_findings(s, d), "category"),
    "finding_stats_by_analyzer": lambda s, d: findings.counts(_page_findings(s, d), "analyzer"),
    "finding_stats_by_severity": lambda s, d: findings.counts(_page_findings(s, d), "severity"),
    "sarif_rows": lambda s, d: sinks.sarif_results(_page_findings(s, d)),
    "header_presence_matrix": lambda s, d: http.header_presence(frame(s, "responses"), V.SECURITY_HEADERS),
    "cookie_attributes": lambda s, d: http.cookies(frame(s, "responses")),
    "csp_directives": lambda s, d: http.csp_directives(frame(s, "responses")),
    "http_findings": lambda s, d: http.http_findings(frame(s, "responses")).drop("finding_id"),
    "http_evidence": lambda s, d: http.http_evidence(frame(s, "responses")).select("page_id", "evidence_type", "value", F.element_at("metadata", "header").alias("header")),
    "asset_categories": lambda s, d: frame(s, "assets").select("id", C.asset_category(F.col("url"), F.col("filename"), F.col("mime"), F.col("hint")).alias("category")),
    "download_outcomes": lambda s, d: frame(s, "downloads").select("id", C.download_status(F.col("ok"), F.col("status"), F.col("error")).alias("outcome")),
    "fp_matches": lambda s, d: fingerprint.pattern_matches(_contexts(s, d)).select("page_id", "ctx_id", "technology", "matcher", "pattern", "weight", "tier"),
    "fp_score": lambda s, d: fingerprint.scores(fingerprint.pattern_matches(_contexts(s, d)), fingerprint.context_versions(_contexts(s, d))).select("page_id", "ctx_id", "technology", "version", "n", "confidence"),
    "fp_versions": lambda s, d: fingerprint.context_versions(_contexts(s, d)),
    "fp_detect": lambda s, d: fingerprint.detect(_contexts(s, d)).select("page_id", "technology", "version", "confidence", "contexts", "confirmed"),
    "signature_evaluations": lambda s, d: _evaluated(s, d),
    "signature_detections": lambda s, d: evidence.by_signatures(_evidence(s, d)).select("page_id", "technology", "confidence"),
    "signature_reduced": lambda s, d: evidence.reduced(_evaluated(s, d)),
    "evidence_identities": lambda s, d: evidence.identities(_evidence(s, d)).select("page_id", "evidence_id", "identity"),
    "identity_candidates": lambda s, d: evidence.candidates(_evidence(s, d)),
    "evidence_summary": lambda s, d: frame(s, "evidence").groupBy("source", "evidence_type").agg(F.count(F.lit(1)).alias("n")),
    "version_validate": lambda s, d: frame(s, "versions").select("id", C.normalize_version(F.col("raw")).alias("normalized"), F.coalesce(C.valid_version(F.col("raw")), F.lit(False)).alias("valid")),
    "version_primary": lambda s, d: providers.resolved_versions(frame(s, "version_candidates")),
    "asset_owners": _page_owners,
    "evidence_owners": _evidence_owners,
    "version_scopes": lambda s, d: ownership.scoped_resources(_scopes(s, d), _resources(s, d)),
    "version_extracted": lambda s, d: _extracted(s, d).drop("origin"),
    "version_resolved": lambda s, d: providers.resolved_versions(_extracted(s, d)),
    "technology_records": lambda s, d: intelligence.tracked(_intelligence_records(s)).drop("technology_key"),
    "technology_entries": lambda s, d: intelligence.technology_entries(frame(s, "intelligence_matches"), _intelligence_records(s)).withColumns({"files": F.array_join("files", ","), "methods": F.array_join("methods", ",")}),
    "style_evidence": _style_evidence,
    "style_identities": lambda s, d: evidence.identities(styles.as_evidence(_style_evidence(s, d), F.col("style_id"))).select("page_id", "evidence_id", "identity"),
    "js_tokens": lambda s, d: javascript.tokens(_scripts(s, d)).select("script_id", F.array_join("imports", ",").alias("imports"), F.array_join("exports", ",").alias("exports"), F.size("strings").alias("n_strings")),
    "source_map_parse": lambda s, d: source_maps.parsed_maps(_maps(s, d)).withColumns({"sources": F.array_join("sources", "|"), "names": F.array_join("names", "|")}),
    "source_map_sources": lambda s, d: source_maps.map_sources(source_maps.parsed_maps(_maps(s, d))),
    "script_findings": lambda s, d: script_findings.script_findings(_sources(s, d)),
    "script_packages": lambda s, d: script_findings.script_packages(_sources(s, d)),
    "js_evidence": lambda s, d: javascript.script_evidence(_scripts(s, d)),
    "js_versions": lambda s, d: javascript.version_hits(_scripts(s, d)),
    "js_duplicates": lambda s, d: javascript.duplicate_scripts(_scripts(s, d)),
    "js_reachable": _reachable,
    "js_kinds": lambda s, d: _scripts(s, d).select("script_id", javascript.bundler(C.filename(F.col("url")), F.col("content")).alias("bundler"), javascript.resource_kind(C.filename(F.col("url")), F.lit(False)).alias("kind"), javascript.chunk_name(C.filename(F.col("url"))).alias("chunk"), javascript.shape(F.coalesce("content", F.lit(""))).alias("shape")),
    "artifact_references": lambda s, d: artifacts.artifact_references(_artifact_texts(s, d)).select("page_id", "source", "category", "artifact_type", "shown", "start"),
    "artifact_classify_risk": lambda s, d: _assessed(s, d).select("page_id", "artifact_type", "classification", "severity", "risk_confidence"),
    "artifact_classes": lambda s, d: artifacts.classes(_assessed(s, d)),
    "artifact_findings": lambda s, d: artifacts.artifact_findings(_assessed(s, d)).drop("finding_id"),
    "sensitive_verdicts": lambda s, d: _judged(s, d).select("page_id", "source", "rule_id", "start", "state", "reason", "adjusted_confidence"),
    "cred_pair_range_join": lambda s, d: sensitive.pairs(_judged(s, d)),
    "severity_calibrate": lambda s, d: _calibrated(s, d).select("page_id", "source", "rule_id", "start", "final_severity", "final_confidence"),
    "sensitive_values": lambda s, d: sensitive.sensitive_values(_secret_texts(s, d)).drop("content_key"),
    "sensitive_summary": lambda s, d: sensitive.summary(sensitive.sensitive_values(_secret_texts(s, d))),
    "sensitive_documents": lambda s, d: sensitive.sensitive_values(_table(s, d, "documents").select(F.col("doc_id").alias("page_id"), F.col("source"), "text")),
    "provider_merge": lambda s, d: providers.merged_providers(providers.canonical(frame(s, "provider_rows"))),
    "provider_import": lambda s, d: providers.imported_results(frame(s, "provider_json")),
    "benchmark_full_outer": lambda s, d: providers.compared(frame(s, "ours"), frame(s, "theirs")),
    "benchmark_pr": lambda s, d: providers.comparison_statistics(providers.compared(frame(s, "ours"), frame(s, "theirs"))),
    "regression_metrics": lambda s, d: providers.regression_metrics(frame(s, "samples")),
    "relationships": lambda s, d: providers.relationships(frame(s, "detections")),
    "conflict_removal": lambda s, d: providers.without_conflicts(frame(s, "detections"), frame(s, "conflicts"), frame(s, "needs")),
    "dependency_addback": lambda s, d: providers.with_dependencies(frame(s, "detections").where("confidence >= 85"), frame(s, "detections")),
    "assigned_pairs": lambda s, d: sensitive.assigned_pairs(_assignments(s, d)),
    "database_triples": lambda s, d: sensitive.database_triples(_judged(s, d)),
    "database_sets": lambda s, d: sensitive.database_sets(_judged(s, d)),
    "report_groups": lambda s, d: findings.report_groups(frame(s, "detections")),
    "report_csv": lambda s, d: findings.csv_rows(frame(s, "detections")),
    "sitemap_lines": lambda s, d: frame(s, "robots").select("id", F.explode(pages.sitemap_lines(F.col("text"))).alias("url")),
    "well_known_findings": lambda s, d: pages.well_known_findings(frame(s, "observed")).drop("finding_id"),
    "css_references": lambda s, d: frame(s, "styles").select("id", F.posexplode(pages.css_urls(F.coalesce("css", F.lit("")))).alias("index", "url")),
    "source_map_references": lambda s, d: _scripts(s, d).select("script_id", html.source_map_reference(F.coalesce("content", F.lit(""))).alias("url")).where("url is not null"),
    "manifest_references": lambda s, d: frame(s, "manifests").select("id", F.explode(html.manifest_references(F.col("text"))).alias("url")),
    "confidence_levels": lambda s, d: frame(s, "detections").select("page_id", "technology", C.confidence_level(F.col("confidence")).alias("level")),
    "version_priorities": lambda s, d: frame(s, "version_candidates").select("page_id", "technology", "version", "source", javascript.version_source_priority(F.col("source")).alias("source_priority")),
    "best_versions": lambda s, d: fingerprint.ranked_versions(frame(s, "ranked")),
    "rule_findings": lambda s, d: rules.rule_findings(_contexts(s, d).withColumn("headers", F.create_map().cast("map<string,string>")), RULES).drop("finding_id"),
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)
