"""Detections of several providers as one, how two sets of detections compare, and what technologies stand on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanspark.functions.columns import lookup, technology_id, valid_version
from gleanspark.functions.signatures import SIGNATURES
from gleanspark.functions.identities import RELATIONSHIPS
from gleanspark.session import literal

UNKNOWN = "Unknown"
# What a version's source adds to its score.
SOURCE_BONUS = {"package": 5.0, "package_metadata": 5.0, "manifest": 5.0, "runtime": 4.0, "build_metadata": 4.0, "version_candidate": 4.0, "banner": 3.0, "metadata": 3.0, "sourcemap": 3.0, "source_map": 3.0}
AGREEMENT = {1: 90.0, 2: 97.0, 3: 99.0}  # fixed values: confidence by number of providers


def provider_rank(provider: Column) -> Column:
    """Our own first, then the import of one scanner's shapes, then the other's, then the rest."""
    return F.when(provider == "internal", 0).when(provider == "wappalyzer", 1).when(provider == "retirejs", 2).otherwise(3)


def canonical(rows: DataFrame) -> DataFrame:
    """provider, name, version, confidence: with technology_id; a missing confidence is 75, a missing version Unknown."""
    return rows.withColumns({"technology_id": technology_id(F.col("name")), "confidence": F.coalesce("confidence", F.lit(75.0)), "version": F.coalesce(F.nullif("version", F.lit("")), F.lit(UNKNOWN))})


def merged_providers(rows: DataFrame) -> DataFrame:
    """One row by page and technology: name of the first provider, agreement and evidence in the confidence, version by priority."""
    rank = provider_rank(F.col("provider"))
    known = F.when(F.col("version") != UNKNOWN, F.col("version"))
    out = rows.groupBy("page_id", "technology_id").agg(
        F.min_by("name", F.struct(rank, F.col("name"))).alias("name"),
        F.count_distinct("provider").alias("n_providers"),
        F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("providers"),
        F.sum("n_evidence").alias("n_evidence"),
        F.coalesce(F.min_by(known, F.when(known.isNotNull(), F.struct(rank, F.col("version")))), F.lit(UNKNOWN)).alias("version"),
        F.count_distinct(known).alias("n_versions"),
    )
    agreed = F.when(F.col("n_providers") >= 3, AGREEMENT[3]).when(F.col("n_providers") == 2, AGREEMENT[2]).otherwise(AGREEMENT[1])
    confidence = agreed + F.least(F.lit(5.0), 0.5 * F.col("n_evidence")) + F.when((F.col("version") != UNKNOWN) & (F.col("n_versions") == 1), 5.0).otherwise(0.0)
    return out.withColumn("confidence", F.round(F.least(F.lit(100.0), confidence), 2)).withColumn("version_conflict", F.col("n_versions") > 1)


_ITEM = T.StructType([T.StructField("name", T.StringType()), T.StructField("version", T.StringType()), T.StructField("confidence", T.DoubleType())])


def imported_results(documents: DataFrame, text_column: str = "json") -> DataFrame:
    """page_id, name, version, confidence from a scanner's JSON: a list, {"technologies": [...]} or {url: {"technologies": [...]}}."""
    text = F.col(text_column)
    items = T.ArrayType(_ITEM)
    by_url = T.MapType(T.StringType(), T.StructType([T.StructField("technologies", items)]))
    flat = F.when(F.ltrim(text).startswith("["), F.from_json(text, items))
    direct = F.from_json(F.get_json_object(text, "$.technologies"), items)
    nested = F.flatten(F.transform(F.map_values(F.from_json(text, by_url)), lambda v: F.coalesce(v["technologies"], F.array().cast(items))))
    return documents.select("page_id", F.explode(F.coalesce(flat, direct, nested)).alias("t")).select("page_id", "t.*").where("name is not null")


def compared(left: DataFrame, right: DataFrame, left_name: str = "ours", right_name: str = "theirs") -> DataFrame:
    """page_id, technology_id, detected_by (one side's name or both), versions and whether known versions agree."""
    a = left.select("page_id", "technology_id", F.col("version").alias("left_version"), F.lit(True).alias("_l"))
    b = right.select("page_id", "technology_id", F.col("version").alias("right_version"), F.lit(True).alias("_r"))
    both = a.join(b, ["page_id", "technology_id"], "full_outer")
    l, r = F.col("_l").isNotNull(), F.col("_r").isNotNull()  # noqa: E741
    known = (F.col("left_version") != UNKNOWN) & (F.col("right_version") != UNKNOWN)
    return both.select("page_id", "technology_id", F.when(l & r, "both").when(l, left_name).otherwise(right_name).alias("detected_by"), "left_version", "right_version", F.when(known, F.col("left_version") == F.col("right_version")).alias("version_match"))


def comparison_statistics(comparison: DataFrame, left_name: str = "ours", right_name: str = "theirs") -> DataFrame:
    """One row: counts, precision and recall of the left side against the right, coverage, share of equal versions."""
    by = F.col("detected_by")
    c = comparison.agg(F.count_if(by == "both").alias("both"), F.count_if(by == left_name).alias("left_only"), F.count_if(by == right_name).alias("right_only"), F.count_if("version_match").alias("versions_equal"), F.count("version_match").alias("versions_known"))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 4)).otherwise(0.0)
    both, l, r = F.col("both"), F.col("left_only"), F.col("right_only")  # noqa: E741
    return c.select("both", "left_only", "right_only", ratio(both, both + l).alias("precision"), ratio(both, both + r).alias("recall"), ratio(both + l, both + l + r).alias("coverage"), F.when(F.col("versions_known") > 0, F.round(100 * F.col("versions_equal") / F.col("versions_known"), 2)).otherwise(0.0).alias("version_match_rate"))


def regression_metrics(samples: DataFrame) -> DataFrame:
    """samples: sample_id, expected, found (arrays). One row: tp, fp, fn, precision, recall, f1."""
    s = samples.agg(F.sum(F.size(F.array_intersect("expected", "found"))).alias("tp"), F.sum(F.size(F.array_except("found", "expected"))).alias("fp"), F.sum(F.size(F.array_except("expected", "found"))).alias("fn"))
    p, r = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / (F.col("tp") + F.col("fn"))
    return s.select("tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(2 * p * r / (p + r), 4).alias("f1"))


def relationships(detections: DataFrame) -> DataFrame:
    """page_id, technology, stands_on, kind: for pairs that are both detected on a page."""
    known = literal(detections.sparkSession, RELATIONSHIPS, "technology string, stands_on string, kind string")
    own = detections.select("page_id", "technology").distinct()
    return own.join(F.broadcast(known), "technology").join(own.withColumnRenamed("technology", "stands_on"), ["page_id", "stands_on"]).select("page_id", "technology", "stands_on", "kind")


def without_conflicts(detections: DataFrame, conflicts: DataFrame, dependencies: DataFrame | None = None) -> DataFrame:
    """Detections that are accepted when a page's are taken by falling confidence (ties: smaller name).

    conflicts: technology, other, minimum_score. A technology isn't accepted if an accepted one of its own others has its
    minimum score at least; it may still displace others that don't name it. dependencies: technology, needs. What an
    accepted technology needs is accepted with it if it was found. As the accepted set grows in order, a page's few
    detections (one a technology, the most confident) are folded in order within one expression.
    """
    spark = detections.sparkSession
    no = F.array().cast("array<string>")
    against = conflicts.groupBy("technology").agg(F.collect_set("other").alias("against"), F.max("minimum_score").alias("minimum"))
    needs = (dependencies or literal(spark, [], "technology string, needs string")).groupBy("technology").agg(F.collect_set("needs").alias("needs"))
    best = detections.groupBy("page_id", "technology").agg(F.max("confidence").alias("confidence"))
    rows = best.join(against, "technology", "left").join(needs, "technology", "left")
    one = F.struct((-F.col("confidence")).alias("o"), "technology", "confidence", F.coalesce("against", no).alias("against"), F.coalesce("minimum", F.lit(0.0)).alias("minimum"), F.coalesce("needs", no).alias("needs"))
    page = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(one)).alias("all"))
    names = F.transform("all", lambda d: d["technology"])

    def accept(taken: Column, d: Column) -> Column:
        strong = F.transform(F.filter("all", lambda x: x["confidence"] >= d["minimum"]), lambda x: x["technology"])
        blocked = F.arrays_overlap(taken, F.array_intersect(d["against"], strong))
        return F.when(blocked, taken).otherwise(F.array_union(F.array_union(taken, F.array(d["technology"])), F.array_intersect(d["needs"], names)))

    kept = F.aggregate("all", no, accept)
    return page.withColumn("kept", kept).select("page_id", F.explode(F.filter("all", lambda d: F.array_contains(F.col("kept"), d["technology"]))).alias("d")).select("page_id", "d.technology", "d.confidence")


def with_dependencies(accepted: DataFrame, found: DataFrame, dependencies: DataFrame | None = None) -> DataFrame:
    """accepted (page_id, technology, confidence) and, of found, what an accepted technology of the page stands on.

    dependencies: technology, needs; by default those of the signatures. One step: what is added back adds nothing.
    """
    if dependencies is None:
        rows = [(s[0], n) for s in SIGNATURES for n in s[7]]
        dependencies = literal(accepted.sparkSession, rows, "technology string, needs string")
    wanted = accepted.join(F.broadcast(dependencies), "technology").select("page_id", F.col("needs").alias("technology")).distinct()
    columns = ["page_id", "technology", "confidence"]
    back = found.join(wanted, columns[:2], "left_semi").join(accepted, columns[:2], "left_anti")
    return accepted.select(*columns).unionByName(back.select(*columns))


def resolved_versions(candidates: DataFrame) -> DataFrame:
    """The version of each page's technology, or why there is none.

    candidates: page_id, technology, version, source, priority, ownership_confidence, preferred, confirmable, origin (the
    address, asset or file it comes from; null: its source and version stand for it). A version's group is judged by its
    confirmable candidates, or by all if there is none: the best one's score, and 8 for each further origin, 20 at most.
    Groups that can't confirm are held down. If the best two are within 12 points, and the confirmable groups have
    several origins between them, they conflict; within 6 they are ambiguous. Candidates may hold a bonus to their score.
    """
    bonus = F.coalesce("bonus", F.lit(0.0)) if "bonus" in candidates.columns else F.lit(0.0)
    score = 0.5 * F.col("priority") + 0.35 * F.col("ownership_confidence") + lookup(F.lower("source"), SOURCE_BONUS, 0.0) + F.when(F.col("preferred"), 20.0).otherwise(0.0) + bonus
    origin = F.coalesce(F.nullif("origin", F.lit("")), F.concat_ws(":", "source", "version"))
    fit = lambda f, what: F.coalesce(f(F.when(F.col("confirmable"), what)), f(what))
    groups = (
        candidates.where(valid_version(F.col("version")))
        .withColumns({"score": score, "origin": origin})
        .groupBy("page_id", "technology", "version")
        .agg(fit(F.max, F.col("score")).alias("best"), fit(F.max, F.col("ownership_confidence")).alias("owned"), F.bool_or("confirmable").alias("ok"), F.array_sort(F.collect_set(F.when(F.col("confirmable"), F.col("origin")))).alias("firm"), F.array_sort(F.collect_set("origin")).alias("any"))
    )
    origins = F.when(F.col("ok"), F.col("firm")).otherwise(F.col("any"))
    total = F.col("best") + F.least(F.lit(20.0), 8.0 * (F.size(origins) - 1))
    groups = groups.withColumns({"score": F.round(F.when(F.col("ok"), total).otherwise(F.least(0.4 * total, F.lit(40.0))), 2), "origins": origins})
    one = F.struct((-F.col("score")).alias("o"), (-F.col("owned")).alias("p"), "version", "score", "ok", "origins")
    per = groups.groupBy("page_id", "technology").agg(F.array_sort(F.collect_list(one)).alias("g"))
    good = F.filter("g", lambda x: x["ok"])
    first, second = F.try_element_at(good, F.lit(1)), F.try_element_at(good, F.lit(2))
    margin = F.coalesce(first["score"] - second["score"], F.lit(1e9))
    apart = F.size(F.array_distinct(F.flatten(F.transform(good, lambda x: x["origins"])))) > 1
    kind = F.when(first.isNull(), "WEAK_ONLY").when((margin < 6) & apart, "AMBIGUOUS").when((margin < 12) & apart, "STRONG_CONFLICT").when(F.size("g") > 1, "WEAK_ALTERNATE").otherwise("NO_CONFLICT")
    version = F.when(kind.isin("WEAK_ALTERNATE", "NO_CONFLICT"), first["version"]).otherwise(UNKNOWN)
    others = F.array_join(F.array_sort(F.transform(F.filter("g", lambda x: x["version"] != version), lambda x: x["version"])), ",")
    return per.select("page_id", "technology", version.alias("version"), kind.alias("conflict"), others.alias("alternates"))
