"""What is known of each technology of a page: evidence put to assets, files, confidence, version and relationships.

Addresses meet the inventory by equality of their keys; records are told apart by a key and counted by when they came
first, so that a technology's matches are merged by running counts and never by comparing them with one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.functions.columns import asset_key, lookup
from gleanspark.functions.identities import RELATIONSHIPS
from gleanspark.session import literal

UNKNOWN = "Unknown"

# What further files and records add, and at most; types of records by matcher and of discovery by source;
# prefixes that aren't part of what was matched, and those of labels that no text shows.
FILE_STEP, FILE_MOST = 3.0, 12.0
RECORD_STEP, RECORD_MOST = 1.0, 8.0
RECORD_TYPES = {"filename": "filename", "sourcemap": "source_map", "global": "runtime_constant"}
DISCOVERY = {"html": "html", "javascript": "javascript", "css": "css", "http_header": "network", "manifest": "manifest", "well_known": "well_known", "inline": "inline"}
PREFIXES = r"(?i)^\s*(?:(?:wappalyzer|retirejs|runtime|javascript|html|headers|resource|source|filename|other):\s*)+"
LABELS = ("wappalyzer:", "resource:", "source:")

_KEYS = ["page_id", "technology_key"]


def _set(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def attributed(rows: DataFrame, inventory: DataFrame) -> DataFrame:
    """rows (page_id, url, filename, ...) with source_file, asset_id and discovery of the page's asset with that address.

    inventory: page_id, asset_id, url, original_url, filename, source. Addresses are equal if their keys are; of several
    assets with one key the smallest id counts. Without an asset the row's own file name counts, then that of an inline
    script, then the address's last part if it has a dot; null addresses meet nothing.
    """
    named = inventory.select("page_id", "asset_id", "filename", "source", F.explode(F.array_distinct(F.array("url", "original_url"))).alias("u")).where("u <> ''")
    one = F.struct("asset_id", F.col("filename").alias("file"), "source")
    known = named.groupBy("page_id", asset_key(F.col("u")).alias("_key")).agg(F.min(one).alias("_asset"))
    last = F.substring_index("url", "/", -1)
    plain = F.when(F.startswith("url", F.lit("inline://")), F.concat(last, F.lit(".js"))).when(F.contains(last, F.lit(".")), last)
    out = rows.withColumn("_key", asset_key(F.col("url"))).join(known, ["page_id", "_key"], "left")
    columns = {
        "source_file": F.coalesce(F.col("_asset.file"), _set(F.col("filename")), plain),
        "asset_id": F.col("_asset.asset_id"),
        "discovery": lookup(F.coalesce(F.col("_asset.source"), F.lit("")), DISCOVERY, "unknown"),
    }
    return out.withColumns(columns).drop("_key", "_asset")


def stripped(text: Column) -> Column:
    """Without what names a provider or kind in front."""
    return F.trim(F.regexp_replace(F.trim(text), PREFIXES, ""))


def _shown(matcher: Column, pattern: Column, detail: Column) -> Column:
    label = F.lit(False)
    for prefix in LABELS:
        label = label | detail.startswith(prefix)
    own = F.when(~label, _set(detail))
    known = F.when(matcher == "filename", pattern).when(matcher.isin("global", "string", "regex", "sourcemap"), F.coalesce(own, pattern))
    clean = F.coalesce(F.when(~label, _set(stripped(detail))), _set(stripped(pattern)), _set(pattern), detail)
    return F.coalesce(known, clean)


def evidence_records(matches: DataFrame, inventory: DataFrame) -> DataFrame:
    """page_id, technology, name, position, evidence_type, pattern, text, confidence, url, source_file, asset_id, discovery.

    matches: page_id, position (order within the page), technology, name, version, confidence, url, filename, reason,
    resources (array of addresses), patterns (array of matcher, pattern, weight, detail). A record for each pattern in
    the match's asset and in every other resource; one for the match itself if it has no pattern but a place.
    """
    none = F.array().cast("array<string>")
    places = F.transform(F.array_except(F.coalesce("resources", none), F.array("url")), lambda r: F.struct(r.alias("url"), F.lit(None).cast("string").alias("filename")))
    # one row for a place, then one for a pattern: addresses are looked up once a place
    at = matches.select("*", F.explode(F.concat(F.array(F.struct("url", "filename")), places)).alias("_p"), (F.size(F.coalesce("patterns", F.array().cast(matches.schema["patterns"].dataType))) > 0).alias("_any"), F.col("url").alias("_url"))
    at = at.withColumns({"url": F.col("_p.url"), "filename": F.col("_p.filename")})
    at = attributed(at.where(F.col("_any") | F.col("url").eqNullSafe(F.col("_url")) & (F.col("url").isNotNull() | _set(F.col("filename")).isNotNull())), inventory)
    rows = at.select("*", F.explode_outer("patterns").alias("e"))
    matcher, pattern = F.coalesce("e.matcher", F.lit("")), F.coalesce("e.pattern", F.lit(""))
    return rows.select(
        "page_id", "technology", "name", "position",
        F.when(F.col("_any"), lookup(matcher, RECORD_TYPES, "pattern_match")).otherwise("pattern_match").alias("evidence_type"),
        F.when(F.col("_any"), F.col("e.pattern")).alias("pattern"),
        F.when(F.col("_any"), _shown(matcher, pattern, F.coalesce("e.detail", F.lit("")))).otherwise(F.col("reason")).alias("text"),
        F.when(F.col("_any"), F.least("confidence", "e.weight")).otherwise(F.col("confidence")).alias("confidence"),
        "url", "source_file", "asset_id", "discovery",
    )


def tracked(records: DataFrame) -> DataFrame:
    """Of records that say the same (name, type, pattern, place, text; of one page and technology) the surest.

    The place is the address, or the file. Ties: the match that comes first, then the smallest remaining columns.
    first_position: where the record came up first.
    """
    keyed = records.withColumns({"technology_key": F.lower("technology"), "_name": F.lower("name"), "_place": F.coalesce(_set(F.col("url")), F.col("source_file"), F.lit(""))})
    null = lambda c: F.coalesce(c, F.lit(""))
    rest = [c for c in records.columns if c not in ("page_id", "confidence", "position")]
    best = F.min_by(F.struct("confidence", *rest), F.struct(-F.col("confidence"), "position", *[null(c).alias(c) for c in rest])).alias("b")
    rows = keyed.groupBy(*_KEYS, "_name", "evidence_type", null("pattern").alias("_pattern"), "_place", null("text").alias("_text")).agg(best, F.min("position").alias("first_position"))
    return rows.select("page_id", "technology_key", "b.*", "first_position")


def _named_files(matches: DataFrame) -> DataFrame:
    """page_id, technology_key, position, file: file names that a match names itself."""
    last = lambda r: F.when(F.contains(F.substring_index(r, "/", -1), F.lit(".")), F.substring_index(r, "/", -1))
    files = F.concat(F.array(_set(F.col("filename"))), F.transform(F.coalesce("resources", F.array().cast("array<string>")), last))
    return matches.select("page_id", F.lower("technology").alias("technology_key"), "position", F.explode(F.array_compact(files)).alias("file"))


def _firsts(rows: DataFrame, what: list[str], name: str) -> DataFrame:
    """How many different ones came up first at each position."""
    first = rows.groupBy(*_KEYS, *what).agg(F.min("position").alias("position"))
    return first.groupBy(*_KEYS, "position").agg(F.count(F.lit(1)).alias(name))


def _counts(rows: DataFrame, what: list[str], name: str) -> DataFrame:
    return rows.groupBy(*_KEYS, "position").agg(F.count_distinct(*what).alias(name))


def technology_entries(matches: DataFrame, records: DataFrame) -> DataFrame:
    """One row by page and technology: name, version, confidence, n_files, n_records, n_assets, files, methods, n_relationships.

    matches: as for evidence_records, with methods (array). records: what evidence_records and other sources tell, of the
    same columns. A match's confidence grows by 3 for each further file (12 at most) and 1 for each further record (8 at
    most), up to 100; a technology's matches are merged in their order, each time from the better of both confidences
    and by all files and records so far. The first known version counts. A technology's matches on one page are few and
    are folded in one expression; its files and records are counted by grouping. Ids differ by more than case; rows
    of null technology or position are left out.
    """
    matches = matches.where("technology is not null and position is not null")
    records = records.where("technology is not null and position is not null").withColumn("technology_key", F.lower("technology"))
    said = records.withColumns({"_name": F.lower("name"), "_place": F.coalesce(_set(F.col("url")), F.col("source_file"), F.lit(""))}).na.fill("", ["pattern", "text", "_name"])
    what = ["_name", "evidence_type", "pattern", "_place", "text"]
    files = _named_files(matches).unionByName(records.where("source_file <> ''").select(*_KEYS, "position", F.col("source_file").alias("file")))
    own = matches.withColumn("technology_key", F.lower("technology")).join(_counts(said, what, "_records"), [*_KEYS, "position"], "left").join(_counts(files, ["file"], "_files"), [*_KEYS, "position"], "left")
    own = own.join(_firsts(said, what, "_new_records"), [*_KEYS, "position"], "left").join(_firsts(files, ["file"], "_new_files"), [*_KEYS, "position"], "left").na.fill(0, ["_records", "_files", "_new_records", "_new_files"])
    so_far = Window.partitionBy(*_KEYS).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    boost = lambda f, r: F.least(F.lit(FILE_MOST), F.greatest(F.lit(0.0), FILE_STEP * (f - 1))) + F.least(F.lit(RECORD_MOST), F.greatest(F.lit(0.0), RECORD_STEP * (r - 1)))
    own = own.withColumns({"_all_files": F.sum("_new_files").over(so_far), "_all_records": F.sum("_new_records").over(so_far)})
    own = own.withColumns({"_one": F.least(F.lit(100.0), F.col("confidence") + boost(F.col("_files"), F.col("_records"))), "_more": boost(F.col("_all_files"), F.col("_all_records"))})
    version = F.when((F.col("version") != UNKNOWN) & (F.col("version") != ""), F.col("version"))
    none = F.array().cast("array<string>")
    per = own.groupBy(*_KEYS).agg(
        F.array_sort(F.collect_list(F.struct("position", "_one", "_more"))).alias("m"),
        F.min_by(F.struct("technology", "name"), F.struct("position", "technology", "name")).alias("t"),
        F.min_by(version, F.struct("position", "version")).alias("_null"),
        F.min(F.when(version.isNotNull(), F.struct("position", version.alias("version")))).alias("v"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("methods", none))))).alias("methods"),
    )
    step = lambda a, x: F.when(a < 0, x["_one"]).otherwise(F.least(F.lit(100.0), F.greatest(a, x["_one"]) + x["_more"]))
    per = per.withColumn("confidence", F.aggregate("m", F.lit(-1.0), step))
    listed = files.groupBy(*_KEYS).agg(F.array_sort(F.collect_set("file")).alias("files"))
    counts = said.groupBy(*_KEYS).agg(F.count_distinct(*what).alias("n_records"), F.count_distinct("asset_id").alias("n_assets"))
    entries = per.join(listed, _KEYS, "left").join(counts, _KEYS, "left")
    spark = matches.sparkSession
    known = literal(spark, [(a.lower(), b.lower()) for a, b, _ in RELATIONSHIPS], "technology_key string, other string")
    ids = entries.select(*_KEYS)
    related = ids.join(F.broadcast(known), "technology_key").join(ids.select("page_id", F.col("technology_key").alias("other")), ["page_id", "other"]).groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n_relationships"))
    out = entries.join(related, _KEYS, "left").na.fill(0, ["n_relationships", "n_records", "n_assets"])
    return out.select(
        "page_id", "t.technology", "t.name", F.coalesce("v.version", F.lit(UNKNOWN)).alias("version"), F.round("confidence", 2).alias("confidence"), F.coalesce(F.size(F.coalesce("files", none)), F.lit(0)).cast("long").alias("n_files"),
        "n_records", "n_assets", F.coalesce("files", none).alias("files"), "methods", "n_relationships",
    )
