"""Artifacts named in texts: scan, classification, risk, and their rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.functions import fixed_values as V
from gleanspark.functions.artifact_patterns import ARTIFACT_PATTERNS, SENSITIVE_ARTIFACT_PATTERNS
from gleanspark.functions.columns import entropy, lookup
from gleanspark.operators.findings import finding, united
from gleanspark.operators.scan import ENTROPY_ASSIGNMENT, ENTROPY_THRESHOLD, Rule, scanned
from gleanspark.session import stored

# Types that stay hidden in reports.
HIDDEN_TYPES = ("aws-access-key", "google-api-key", "github-token", "gitlab-token", "stripe-secret-key", "jwt-token", "bearer-token-ref", "basic-auth-token")
# Artifact types of each typed analyzer, category of its findings.
TYPED_ANALYZERS = {
    "analytics-service-analyzer": ("INFORMATION", ("google-analytics", "google-tag-manager", "matomo")),
    "api-key-analyzer": ("SENSITIVE_ARTIFACT", ("api-key",)),
    "aws-metadata-analyzer": ("INFRASTRUCTURE", ("aws", "s3", "cloudfront")),
    "azure-metadata-analyzer": ("INFRASTRUCTURE", ("azure", "blob-storage")),
    "cdn-analyzer": ("INFRASTRUCTURE", ("cloudflare", "fastly", "akamai", "netlify", "vercel", "github-pages")),
    "firebase-analyzer": ("INFRASTRUCTURE", ("firebase",)),
    "google-cloud-metadata-analyzer": ("INFRASTRUCTURE", ("gcp",)),
    "graphql-metadata-analyzer": ("ENDPOINT", ("graphql", "graphql-playground", "graphql-voyager", "apollo")),
    "jwt-analyzer": ("SENSITIVE_ARTIFACT", ("jwt", "bearer-token")),
    "monitoring-service-analyzer": ("INFORMATION", ("sentry", "rollbar", "bugsnag")),
    "oauth-metadata-analyzer": ("INFRASTRUCTURE", ("oauth", "authorization-endpoint", "token-endpoint")),
    "openapi-analyzer": ("ENDPOINT", ("openapi", "swagger", "swagger-ui", "redoc", "rest-api-version", "api-documentation")),
    "openid-connect-analyzer": ("INFRASTRUCTURE", ("oidc", "openid", "jwks", "issuer")),
    "technology-exposure-analyzer": ("TECHNOLOGY", ("technology-exposure", "public-key")),
    "third-party-service-analyzer": ("INFORMATION", ("hotjar", "intercom", "zendesk", "stripe", "paypal", "recaptcha", "hcaptcha")),
}
# Artifact category of each category analyzer, category of its findings.
CATEGORY_ANALYZERS = {
    "backup-artifact-analyzer": ("SENSITIVE_ARTIFACT", "backup"),
    "build-artifact-analyzer": ("TECHNOLOGY", "build"),
    "client-configuration-analyzer": ("CONFIGURATION", "client-config"),
    "configuration-artifact-analyzer": ("CONFIGURATION", "configuration"),
    "debug-artifact-analyzer": ("INFORMATION", "debug"),
    "development-artifact-analyzer": ("INFORMATION", "development"),
    "environment-artifact-analyzer": ("CONFIGURATION", "environment"),
    "infrastructure-metadata-analyzer": ("INFRASTRUCTURE", "infrastructure"),
    "source-artifact-analyzer": ("METADATA", "source"),
}
_BAR = "\x1f"


def artifact_rules() -> list[Rule]:
    """Rule ids carry category and type; the client-config pattern counts for two categories."""
    out = [Rule(f"{c}{_BAR}{t}", p, "i") for t, c, p in ARTIFACT_PATTERNS]
    out += [Rule(f"{c}{_BAR}{t}", p, f) for t, c, f, p in SENSITIVE_ARTIFACT_PATTERNS]
    out += [Rule(f"client-config{_BAR}{t}", p, f) for t, c, f, p in SENSITIVE_ARTIFACT_PATTERNS if t == "client-config"]
    # Tokens of the general scan.
    out.append(Rule(f"token{_BAR}jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"))
    out.append(Rule(f"token{_BAR}bearer-token", r"Bearer\s+[A-Za-z0-9._~+/=-]{10,}", "i"))
    out.append(Rule(f"token{_BAR}api-key", r"(?:api[_-]?key|x-api-key)\s*[:=]\s*['\"][A-Za-z0-9_\-]{8,}['\"]", "i"))
    out.append(Rule(f"secret{_BAR}high-entropy-token", ENTROPY_ASSIGNMENT, "i", 1))
    return out


def artifact_references(texts: DataFrame, text_column: str = "text") -> DataFrame:
    """page_id, source, category, artifact_type, value, start: distinct by page, type, category, value and source; first places."""
    hits = scanned(texts, artifact_rules(), text_column, margin=20)
    parts = F.split("rule_id", _BAR)
    hits = hits.withColumns({"category": parts[0], "artifact_type": parts[1]})
    hits = hits.where((F.col("artifact_type") != "high-entropy-token") | (entropy(F.col("value")) >= ENTROPY_THRESHOLD))
    first = hits.groupBy("page_id", "source", "category", "artifact_type", "value").agg(F.min("start").alias("start"), F.min_by("snippet", "start").alias("snippet"))
    shown = F.when(F.col("artifact_type").isin(*HIDDEN_TYPES), F.concat("artifact_type", F.lit(" [redacted]"))).when(F.char_length("value") > 80, F.concat(F.left("value", F.lit(80)), F.lit("..."))).otherwise(F.col("value"))
    return first.withColumn("shown", shown)


def classification(kind: Column, category: Column) -> Column:
    return F.coalesce(lookup(kind, V.TYPE_CLASSES), lookup(category, V.CATEGORY_CLASSES), F.lit("METADATA"))


def with_risk(references: DataFrame) -> DataFrame:
    """Adds classification, severity, risk_confidence and recommendation."""
    kind, c = F.col("artifact_type"), F.col("classification")
    def of(severity: str, confidence: float) -> Column:
        return F.struct(F.lit(severity).alias("s"), F.lit(confidence).alias("c"))

    level = (
        F.when(kind.isin(*V.SECRET_TYPES), of("HIGH", 92.0))
        .when(kind.isin(*V.HIGH_RISK_TYPES), of("MEDIUM", 85.0))
        .when(c == "SECRETS", of("HIGH", 88.0))
        .when(c == "AUTHENTICATION", of("MEDIUM", 82.0))
        .when(c == "DEBUG", of("MEDIUM", 78.0))
        .when(c == "BACKUP", of("LOW", 75.0))
        .when(c == "CONFIGURATION", of("LOW", 80.0))
        .when(c == "BUILD", of("INFO", 85.0))
        .when(c == "DEVELOPMENT", of("LOW", 70.0))
        .otherwise(of("INFO", 75.0))
    )
    advice = (
        F.when(c.isin("SECRETS", "AUTHENTICATION"), "Remove credentials from public content and rotate them.")
        .when(c == "CONFIGURATION", "Keep public configuration free of sensitive values.")
        .when(c == "DEBUG", "Remove debug output from production assets.")
        .when(c == "BACKUP", "Remove backup and temporary files from public places.")
        .otherwise(F.concat(F.lit("Confirm that "), kind, F.lit(" is meant to be public.")))
    )
    out = references.withColumn("classification", classification(kind, F.col("category"))).withColumn("_level", level)
    return out.select(*references.columns, "classification", F.col("_level.s").alias("severity"), F.col("_level.c").alias("risk_confidence"), advice.alias("recommendation"))


def classes(assessed: DataFrame) -> DataFrame:
    return assessed.groupBy("page_id", "classification").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("artifact_type")), ", ").alias("types"), F.max("risk_confidence").alias("top_confidence"))


def artifact_findings(assessed: DataFrame) -> DataFrame:
    """Findings of the typed, the category, the exposure and the risk analyzers.

    What was found is stored: both kinds of findings are made of it, and the texts are scanned once.
    """
    assessed = stored(assessed, "artifacts")
    kind, category = F.col("artifact_type"), F.col("category")
    def by(analyzer: str, category_: str, severity: Column) -> Column:
        return F.struct(F.lit(analyzer).alias("analyzer"), F.lit(category_).alias("category"), severity.alias("severity"))

    typed = [F.when(kind.isin(*types), by(n, c, F.lit("INFO"))) for n, (c, types) in TYPED_ANALYZERS.items()]
    listed = [F.when(category == own, by(n, c, F.col("severity"))) for n, (c, own) in CATEGORY_ANALYZERS.items()]
    above = F.when(F.col("severity").isin("MEDIUM", "HIGH", "CRITICAL"), by("risk-classification-analyzer", "INFORMATION", F.col("severity")))
    rows = assessed.withColumn("_a", F.explode(F.array_compact(F.array(*typed, *listed, above))))
    found = rows.select(*finding(F.col("page_id"), F.col("_a.analyzer"), F.col("_a.category"), F.concat_ws(_BAR, "category", kind, "value", "source"), F.concat_ws(": ", kind, "shown"), severity=F.col("_a.severity"), confidence=F.col("risk_confidence"), evidence=F.col("snippet"), location=F.col("source")))
    by_class = classes(assessed)
    exposure = by_class.select(*finding(F.col("page_id"), "exposure-classification-analyzer", "INFORMATION", F.col("classification"), F.concat_ws(" ", "classification", F.col("n").cast("string"), "types")))
    return united([found, exposure])
