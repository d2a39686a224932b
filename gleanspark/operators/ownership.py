"""Whose a version is: evidence and scripts assigned to technologies, and versions resolved from what they own.

No pair of a page's evidence and technologies is made a row unless it says something: a page's technologies travel as
one array with its evidence, and only assessments with a reason leave the expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.functions.columns import asset_key, lookup
from gleanspark.functions.fingerprints import FINGERPRINTS
from gleanspark.session import stored

# Further names of technologies; methods that prove a library by themselves; methods and sources that
# never confirm; the least priority that confirms; what owned and associated versions need to confirm.
OTHER_NAMES = {"nextjs": ("next",), "react": ("react-dom", "reactdom"), "material-ui": ("mui", "@mui")}
SELF_PROVING = ("runtime_constant", "framework_object", "package_identifier", "package_manifest", "build_metadata", "technology_marker")
WEAK_METHODS = ("reference", "generic_literal", "unknown")
WEAK_SOURCES = ("bundle", "inline", "global", "minified", "regex", "unknown", "reference", "generic_literal")
MIN_PRIORITY = 65.0
CONFIRMS = {"OWNED": 65.0, "ASSOCIATED": 70.0}
# Affinity by where a name stands, and from where on it makes an asset a technology's own.
IN_NAME, IN_PATH, IN_URL, ENOUGH = 95.0, 90.0, 75.0, 70.0
STAMPED, WEAK_STAMP, NO_AFFINITY = 95.0, 60.0, 70.0
# What a method's versions are called, and what the ground of an ownership and a version in the address add.
METHOD_SOURCES = {
    "runtime_constant": "runtime",
    "framework_object": "runtime",
    "package_identifier": "package",
    "package_manifest": "manifest",
    "build_metadata": "build_metadata",
    "metadata": "metadata",
    "banner": "banner",
    "source_map": "sourcemap",
    "asset_filename": "filename",
    "technology_marker": "runtime",
    "reference": "content",
    "generic_literal": "content",
    "unknown": "unknown",
}
BASIS_BONUS = {"js_asset_affinity": 12.0, "js_extractor_low_affinity": -2.0, "js_self_proving_method": 6.0}
IN_ADDRESS = 8.0


def name_tokens(technology: Column) -> Column:
    """What a technology is called in packages and addresses: its id, without hyphens, with dots, and other names."""
    name = F.regexp_replace(F.replace(F.lower(technology), F.lit("_"), F.lit("-")), "^package:", "")
    more = F.array().cast("array<string>")
    for known, names in OTHER_NAMES.items():
        more = F.when(name == known, F.array(*map(F.lit, names))).otherwise(more)
    return F.array_distinct(F.concat(F.array(name, F.replace(name, F.lit("-"), F.lit("")), F.replace(name, F.lit("-"), F.lit("."))), more))


def names_of(technology: str) -> list[str]:
    """As `name_tokens`, of a technology that is known beforehand."""
    name = technology.lower().replace("_", "-").removeprefix("package:")
    return list(dict.fromkeys((name, name.replace("-", ""), name.replace("-", "."), *OTHER_NAMES.get(name, ()))))


def _names(text: Column, technology: Column) -> Column:
    return F.exists(name_tokens(technology), lambda k: text.contains(k))


def asset_affinity(technology: Column, filename: Column, url: Column) -> Column:
    """0 to 100: how much an asset's name and address say that it is the technology. Names of one letter say nothing."""
    return _best(name_tokens(technology), F.lower(F.coalesce(filename, F.lit(""))), F.lower(F.coalesce(url, F.lit(""))))


def _best(names: Column, file: Column, path: Column) -> Column:
    """The best affinity that any of the names gives; file and path are in lower case."""
    slash, at, dash = F.lit("/"), F.lit("@"), F.lit("-")

    def of(k: Column) -> Column:
        near = path.contains(F.concat(slash, k)) | path.contains(F.concat(k, at)) | path.contains(F.concat(k, dash))
        return F.when(F.length(k) < 2, 0.0).when(file.contains(k), IN_NAME).when(near, IN_PATH).when(path.contains(k), IN_URL).otherwise(0.0)

    return F.coalesce(F.array_max(F.transform(names, of)), F.lit(0.0))


def asset_owners(assets: DataFrame, technologies: list[str] | None = None) -> DataFrame:
    """asset_key, technology, affinity of every asset (url, filename) whose name or address holds a technology's name.

    technologies: by default those of the fingerprints. Assets of one key are one, with their best affinity.
    """
    technologies = sorted({f[0] for f in FINGERPRINTS}) if technologies is None else technologies
    # names are literals, and an asset's texts are stored: else they'd be made again for each technology and name
    known = F.array(*[F.struct(F.lit(t).alias("technology"), F.array(*map(F.lit, names_of(t))).alias("names")) for t in technologies])
    ready = assets.where("url is not null").select(asset_key(F.col("url")).alias("asset_key"), F.lower(F.coalesce("filename", F.lit(""))).alias("_file"), F.lower("url").alias("_path"))
    ready = stored(ready.distinct(), "owner-assets")
    there = lambda k: (F.length(k) > 1) & (F.contains(F.col("_path"), k) | F.contains(F.col("_file"), k))
    told = F.filter(known, lambda t: F.exists(t["names"], there))
    each = F.transform(told, lambda t: F.struct(t["technology"].alias("technology"), _best(t["names"], F.col("_file"), F.col("_path")).alias("affinity")))
    rows = ready.select("asset_key", F.explode(each).alias("o"))
    return rows.groupBy("asset_key", "o.technology").agg(F.max("o.affinity").alias("affinity"))


def _assessed(technology: Column) -> Column:
    """technology, ownership, confidence, basis of a piece of evidence for one technology; null where nothing is said."""
    name, typed = F.lower(technology), F.col("evidence_type") == "version_candidate"
    said = lambda k: F.nullif(F.lower(F.trim(F.try_element_at("metadata", F.lit(k)))), F.lit(""))
    told, family, package, value = said("technology"), said("runtime_family"), said("package"), F.nullif(F.lower(F.trim("value")), F.lit(""))
    matched = F.coalesce(F.exists("_matched", lambda m: F.lower(m) == name), F.lit(False))
    is_ = lambda ownership, confidence, basis: F.struct(technology.alias("technology"), F.lit(ownership).alias("ownership"), F.lit(confidence).alias("confidence"), F.lit(basis).alias("basis"))
    nothing = F.lit(None)
    return (
        F.when(F.lower("_technology") == name, is_("OWNED", 98.0, "technology_field"))
        .when(told == name, is_("OWNED", 95.0, "metadata_technology"))
        .when(told.isNotNull(), nothing)
        .when(family == name, is_("OWNED", 90.0, "runtime_family"))
        .when(family.isNotNull(), nothing)
        .when(_names(package, technology), is_("OWNED", 82.0, "package_hint"))
        .when(matched & ~typed, is_("ASSOCIATED", 72.0, "matched_detection_evidence"))
        .when(_names(value, technology), is_("OWNED", 55.0, "value_hint"))
        .when(matched, is_("INCIDENTAL", 20.0, "matched_evidence_version_candidate"))
    )


def evidence_ownership(evidence: DataFrame, detections: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """page_id, evidence_id, technology, ownership, confidence, basis, relevant, confirms.

    evidence: page_id, evidence_id, evidence_type, value, metadata and, if it has one, technology. detections: page_id,
    technology. matched: page_id, evidence_id, technology of what detections were made from. A pair without a row is
    unknown, or incidental as the evidence names another technology. Evidence of a null page or without a technology
    on its page has no row; repeated detections count once; null and empty technologies are none. relevant: it may tell
    a version (version candidates only if owned). A page's technologies, as many as are known, are one array.
    """
    named = detections.where("technology <> ''").groupBy("page_id").agg(F.array_sort(F.collect_set("technology")).alias("_all"))
    if matched is None:
        matched = evidence.select("page_id", "evidence_id", F.lit(None).cast("string").alias("technology")).limit(0)
    of = matched.where("technology is not null").groupBy("page_id", "evidence_id").agg(F.collect_set("technology").alias("_matched"))
    technology = F.col("technology") if "technology" in evidence.columns else F.lit(None).cast("string")
    rows = evidence.select("page_id", "evidence_id", "evidence_type", "value", "metadata", technology.alias("_technology"))
    rows = rows.join(named, "page_id").join(of, ["page_id", "evidence_id"], "left")
    out = rows.select("page_id", "evidence_id", "evidence_type", F.explode(F.array_compact(F.transform("_all", _assessed))).alias("a"))
    ownership, typed = F.col("a.ownership"), F.coalesce(F.col("evidence_type") == "version_candidate", F.lit(False))
    relevant = (ownership == "OWNED") | (ownership == "ASSOCIATED") & ~typed
    return out.select("page_id", "evidence_id", "a.*", relevant.alias("relevant"), confirms(ownership, F.col("a.confidence")).alias("confirms"))


def confirms(ownership: Column, confidence: Column) -> Column:
    """Whether an ownership is firm enough to confirm a version."""
    return F.coalesce(confidence >= lookup(ownership, CONFIRMS, 1e9), F.lit(False))


def extraction_ownership(technology: Column, method: Column, filename: Column, url: Column) -> Column:
    """ownership, confidence, basis of a version that an extractor of the technology found in an asset.

    Weak methods are associated only; methods that prove the library own it wherever they stand; others own it firmly
    in an asset of the technology's name and with 70 elsewhere, so that a mention can't outweigh the library itself.
    """
    how = F.lower(F.trim(method))
    is_ = lambda ownership, confidence, basis: F.struct(F.lit(ownership).alias("ownership"), F.lit(confidence).alias("confidence"), F.lit(basis).alias("basis"))
    return (
        F.when(how.isin(*WEAK_METHODS), is_("ASSOCIATED", WEAK_STAMP, "js_weak_method"))
        .when(how.isNull() | (how == "") | how.isin(*SELF_PROVING), is_("OWNED", STAMPED, "js_self_proving_method"))
        .when(asset_affinity(technology, filename, url) >= ENOUGH, is_("OWNED", STAMPED, "js_asset_affinity"))
        .otherwise(is_("OWNED", NO_AFFINITY, "js_extractor_low_affinity"))
    )


def _scope(matches: DataFrame) -> DataFrame:
    """page_id, technology, keys: addresses and names of files that a detection came from, as (kind, key)."""
    trimmed = lambda c: F.nullif(F.trim(c), F.lit(""))
    key = lambda kind, c: F.when(trimmed(c).isNotNull(), F.struct(F.lit(kind).alias("kind"), trimmed(c).alias("key")))
    address = lambda r: F.contains(r, F.lit("://")) | F.startswith(r, F.lit("/"))
    named = F.transform(F.coalesce("resources", F.array().cast("array<string>")), lambda r: F.when(address(F.trim(r)), key("url", r)).otherwise(key("file", F.substring_index(F.trim(r), "/", -1))))
    files = F.transform(F.coalesce("evidence_files", F.array().cast("array<string>")), lambda f: key("file", f))
    keys = F.array_compact(F.concat(F.array(key("url", F.col("url")), key("file", F.col("filename"))), named, files))
    return matches.select("page_id", "technology", keys.alias("keys"))


def scoped_resources(matches: DataFrame, resources: DataFrame) -> DataFrame:
    """page_id, technology, asset_id: the assets in which a detected technology's version is looked for.

    matches: page_id, technology, url, filename, resources and evidence_files (arrays of what was matched in).
    resources: page_id, asset_id, url, filename; of equal addresses and names the smallest id counts. A detection that
    names no asset at all has all of its page's; one that names assets has those only, even if none is known.
    """
    first = resources.groupBy("page_id", "url", "filename").agg(F.min("asset_id").alias("asset_id"))
    scope = _scope(matches).groupBy("page_id", "technology").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"))
    wanted = scope.select("page_id", "technology", F.explode("keys").alias("k")).select("page_id", "technology", "k.*")
    keys = F.array(F.struct(F.lit("url").alias("kind"), F.col("url").alias("key")), F.struct(F.lit("file").alias("kind"), F.col("filename").alias("key")))
    known = first.select("page_id", "asset_id", F.explode(keys).alias("k")).select("page_id", "asset_id", "k.*").where("key is not null")
    scoped = wanted.join(known, ["page_id", "kind", "key"]).select("page_id", "technology", "asset_id").distinct()
    anywhere = scope.where(F.size("keys") == 0).select("page_id", "technology").join(first, "page_id").select("page_id", "technology", "asset_id")
    return scoped.unionByName(anywhere)


def _plain_url(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(url), r"\?.*$", ""), "/+$", "")


def _ends_alike(known: str, text: Column) -> Column:
    """Whether the text and one of the array's are equal or one ends with the other; empty ones never."""
    near = F.exists(known, lambda k: (k != "") & (F.endswith(text, k) | F.endswith(k, text)))
    return F.coalesce((text != "") & near, F.lit(False))


def extracted_candidates(hits: DataFrame, resources: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """Candidates for providers.resolved_versions from what version extractors found in assets.

    hits: asset_id, technology, method, version, weight. resources and matches: as in scoped_resources. Without matches
    every technology found on a page is looked for in all its assets and none is preferred; with them, only detected
    ones in their scope, and the asset that a detection came from itself (url, filename; also if one ends with the other)
    is preferred. bonus: more for assets of the technology's name, self-proving methods and addresses that hold the
    version, less for mentions elsewhere. Equal versions by one method in one asset count once.
    """
    at = hits.join(resources.select("page_id", "asset_id", "url", "filename"), "asset_id")
    url, file = F.coalesce("url", F.lit("")), F.coalesce("filename", F.lit(""))
    preferred = F.lit(False)
    if matches is not None:
        at = at.join(scoped_resources(matches, resources), ["page_id", "technology", "asset_id"], "left_semi")
        origin = matches.groupBy("page_id", "technology").agg(F.collect_set(_plain_url(F.col("url"))).alias("_urls"), F.collect_set(F.lower(F.trim("filename"))).alias("_files"))
        at = at.join(origin, ["page_id", "technology"], "left")
        preferred = _ends_alike("_urls", _plain_url(url)) | _ends_alike("_files", F.lower(F.trim(file)))
    method = F.lower("method")
    rows = at.withColumn("o", extraction_ownership(F.col("technology"), method, F.col("filename"), F.col("url")))
    source = lookup(method, METHOD_SOURCES, "content")
    firm = ~method.isin(*WEAK_METHODS) & ~source.isin(*WEAK_SOURCES) & (F.col("weight") >= MIN_PRIORITY) & confirms(F.col("o.ownership"), F.col("o.confidence"))
    named = F.contains(F.lower(F.concat_ws(" ", file, url)), F.lower("version"))
    bonus = lookup(F.col("o.basis"), BASIS_BONUS, 0.0) + F.when(named, IN_ADDRESS).otherwise(0.0) + F.when((F.col("o.ownership") == "ASSOCIATED") & (source == "content"), 1.0).otherwise(0.0)
    return rows.select(
        "page_id", "technology", "version", source.alias("source"), F.col("weight").alias("priority"), F.col("o.confidence").alias("ownership_confidence"), F.col("o.basis").alias("basis"),
        bonus.alias("bonus"), preferred.alias("preferred"), firm.alias("confirmable"), F.coalesce(F.nullif("url", F.lit("")), F.col("filename")).alias("origin"),
    ).distinct()
