"""What style sheets tell of technologies: banners, directives, variables, names of assets and packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns, how much each is trusted, how many variables tell, packages that count.
BOOTSTRAP_BANNER = r"(?diuU)/\*!?\s*Bootstrap\s+v?([\d.]+)"
BOOTSTRAP_ASSET = r"(?diuU)bootstrap(?:\.bundle)?(?:\.min)?\.(?:css|js)"
TAILWIND_DIRECTIVE = r"(?diuU)@tailwind\s+(?:base|components|utilities|screens)\b"
TAILWIND_VARIABLE = r"(?dU)--tw-[a-z0-9-]+\s*:"
TAILWIND_BANNER = r"(?diuU)/\*!?\s*tailwindcss\s+v?([\d.]+)"
PACKAGE = r"(?diuU)(?:node_modules[/\\]|@import\s+['\"](~?/?)?)((?:@[\w-]+/)?[\w.-]+)"
PACKAGES = ("bootstrap", "tailwindcss", "tailwind")
TRUST = {"banner": 90.0, "asset": 85.0, "directive": 90.0, "css_variables": 80.0, "package_path": 75.0, "cdn_path": 85.0}
MIN_VARIABLES = 3
SHOWN = 80


def style_evidence(sheets: DataFrame) -> DataFrame:
    """style_id, family, kind, value, version, n, confidence: what each sheet shows, one row by family and value.

    sheets: style_id, content and, if they are files, url and filename (else null). Null and empty sheets show nothing,
    but an address still does; of one value's several kinds the first of banner, asset, directive, variables and package
    counts. Sheets that repeat an id are judged each for itself.
    """
    text, none = F.coalesce("content", F.lit("")), F.lit(None)

    def row(family: Column, kind: str, value: Column, version: Column = none, n: Column = none) -> Column:
        return F.struct(family.alias("family"), F.lit(kind).alias("kind"), value.alias("value"), version.cast("string").alias("version"), n.cast("long").alias("n"), F.lit(TRUST[kind]).alias("confidence"))

    first = lambda p, t=text: F.nullif(F.regexp_extract(t, p, 0), F.lit(""))
    every = lambda p, g: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    banner = lambda family, p: F.array(F.when(first(p).isNotNull(), row(F.lit(family), "banner", F.substring(first(p), 1, SHOWN), F.regexp_extract(text, p, 1))))
    asset = F.coalesce(first(BOOTSTRAP_ASSET), first(BOOTSTRAP_ASSET, F.coalesce("filename", F.lit(""))))
    variables = F.size(every(TAILWIND_VARIABLE, 0))
    packages = F.filter(every(PACKAGE, 2), lambda p: F.lower(p).isin(*PACKAGES))
    cdn = F.contains(F.lower(F.replace(F.coalesce("url", F.lit("")), F.lit("\\"), F.lit("/"))), F.lit("/cdn-cgi/"))
    found = F.concat(
        banner("bootstrap", BOOTSTRAP_BANNER),
        F.array(F.when(asset.isNotNull(), row(F.lit("bootstrap"), "asset", asset))),
        F.transform(every(TAILWIND_DIRECTIVE, 0), lambda v: row(F.lit("tailwindcss"), "directive", v)),
        F.array(F.when(variables >= MIN_VARIABLES, row(F.lit("tailwindcss"), "css_variables", F.lit("--tw-*"), n=variables))),
        banner("tailwindcss", TAILWIND_BANNER),
        F.transform(packages, lambda p: row(F.lower(p), "package_path", p)),
        F.array(F.when(cdn, row(F.lit("cloudflare"), "cdn_path", F.lit("/cdn-cgi/")))),
    )
    rows = sheets.select("style_id", F.array_compact(found).alias("_all"))
    fresh = F.filter("_all", lambda x, i: ~F.exists(F.slice("_all", 1, i), lambda y: (y["family"] == x["family"]) & (y["value"] == x["value"])))
    return rows.select("style_id", F.explode(fresh).alias("e")).select("style_id", "e.*")


def as_evidence(found: DataFrame, page_of: Column) -> DataFrame:
    """Rows of style_evidence as evidence for signatures and identities: page_id by the given column of style_id."""
    return found.select(
        page_of.alias("page_id"), F.concat_ws(":", F.lit("css"), F.col("style_id").cast("string"), "family", "value").alias("evidence_id"), F.lit("css").alias("source"), F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("string").alias("file"), F.lit("css_marker").alias("evidence_type"), "value", F.map_filter(F.create_map(F.lit("css_family"), "family", F.lit("kind"), "kind", F.lit("version"), "version"), lambda _, v: v.isNotNull()).alias("metadata"),
    )
