"""Findings: one row shape for all analyzers, their merge, order and statistics, and reports made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.functions.columns import finding_id

COLUMNS = ("page_id", "finding_id", "analyzer", "category", "title", "severity", "confidence", "evidence", "location")


def finding(page: Column, analyzer: str | Column, category: str | Column, key: Column, title: Column, *, severity: Column | str = "INFO", confidence: Column | float = 100.0, evidence: Column | None = None, location: Column | None = None) -> list[Column]:
    """The columns of one finding; its id is made of the analyzer, the page and the key."""
    text = F.lit(None).cast("string")
    analyzer = F.lit(analyzer) if isinstance(analyzer, str) else analyzer
    values = {
        "page_id": page,
        "finding_id": finding_id(analyzer, page.cast("string"), key),
        "analyzer": analyzer,
        "category": F.lit(category) if isinstance(category, str) else category,
        "title": title,
        "severity": F.lit(severity) if isinstance(severity, str) else severity,
        "confidence": F.lit(confidence).cast("double") if isinstance(confidence, int | float) else confidence.cast("double"),
        "evidence": text if evidence is None else evidence,
        "location": text if location is None else location,
    }
    return [values[c].alias(c) for c in COLUMNS]


def item(analyzer: str, category: str, key: Column, title: Column, *, severity: str = "INFO", confidence: float = 100.0, evidence: Column | None = None, location: Column | None = None) -> Column:
    """A finding as a struct, for arrays that are exploded once for all analyzers."""
    text = F.lit(None).cast("string")
    return F.struct(
        F.lit(analyzer).alias("analyzer"), F.lit(category).alias("category"), key.alias("key"), title.alias("title"), F.lit(severity).alias("severity"), F.lit(float(confidence)).alias("confidence"),
        (text if evidence is None else evidence).alias("evidence"), (text if location is None else location).alias("location"),
    )


def exploded(rows: DataFrame, arrays: list[Column]) -> DataFrame:
    """Findings of rows (page_id, ...), from arrays of `item`: one pass over the rows whatever the number of analyzers."""
    f = lambda name: F.col(f"_f.{name}")
    found = rows.select("page_id", F.explode(F.flatten(F.array(*arrays))).alias("_f"))
    return found.select(*finding(F.col("page_id"), f("analyzer"), f("category"), f("key"), f("title"), severity=f("severity"), confidence=f("confidence"), evidence=f("evidence"), location=f("location")))


def united(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def deduplicated(findings: DataFrame) -> DataFrame:
    """Of findings with one id the most confident."""
    row = F.struct(*[c for c in COLUMNS if c != "finding_id"])
    return findings.groupBy("finding_id").agg(F.max_by(row, F.struct("confidence", "title")).alias("r")).select("finding_id", "r.*").select(*COLUMNS)


def in_report_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.desc("confidence"), "category", "title", "finding_id")


def counts(findings: DataFrame, by: str) -> DataFrame:
    return findings.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 2).alias("avg_confidence"), F.max("confidence").alias("max_confidence"))


def statistics(findings: DataFrame) -> DataFrame:
    """dimension, value, n: counts by category, severity and analyzer from one scan and one shuffle, and all."""
    kind = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("category", "severity", "analyzer")], F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value"))))
    return findings.select(kind.alias("k")).groupBy("k.dimension", "k.value").agg(F.count(F.lit(1)).alias("n"))


def report_groups(detections: DataFrame) -> DataFrame:
    """By category: technologies, with and without a version."""
    known = F.col("version") != "Unknown"
    return detections.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(known).alias("known_versions"), F.count_if(~known).alias("unknown_versions"), F.array_join(F.array_sort(F.collect_set("technology")), ", ").alias("technologies"))


def csv_rows(detections: DataFrame) -> DataFrame:
    """Six columns of text, as the CSV export has them; evidence: array of text."""
    return detections.select("technology", "category", "version", F.format_string("%.2f", F.col("confidence")).alias("confidence"), F.coalesce("filename", F.lit("")).alias("filename"), F.array_join("evidence", "; ").alias("evidence"))
