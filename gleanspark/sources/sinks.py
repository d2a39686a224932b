"""Writers of results: JSON, CSV, Markdown, HTML and SARIF."""

from __future__ import annotations

import html as escaping
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.operators.findings import csv_rows

#: A rendered report is for reading: the driver takes so many rows at most, in the report's order, and says if there are more.
REPORT_ROWS = 10_000


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(detections: DataFrame, path: str) -> None:
    csv_rows(detections).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _shown(df: DataFrame) -> tuple[list[dict], bool]:
    rows = [r.asDict() for r in df.limit(REPORT_ROWS + 1).collect()]
    return rows[:REPORT_ROWS], len(rows) > REPORT_ROWS


def markdown(df: DataFrame, title: str = "Report") -> str:
    rows, more = _shown(df)
    cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join(cell(r[c]) for c in df.columns) + " |" for r in rows]
    return "\n".join([*lines, *(["", "More rows follow."] if more else []), ""])


def html(df: DataFrame, title: str = "Report") -> str:
    rows, more = _shown(df)
    cell = lambda v: escaping.escape(str("" if v is None else v))
    head = "".join(f"<th>{cell(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(r[c])}</td>" for c in df.columns) + "</tr>" for r in rows)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{cell(title)}</title></head><body><h1>{cell(title)}</h1><table><tr>{head}</tr>{body}</table>{'<p>More rows follow.</p>' if more else ''}</body></html>"


def sarif_results(findings: DataFrame) -> DataFrame:
    """rule_id, result: each finding as a SARIF result in JSON, made where the row is."""
    place = F.array(F.struct(F.struct(F.struct(F.coalesce("location", F.lit("")).alias("uri")).alias("artifactLocation")).alias("physicalLocation")))
    result = F.struct(F.col("analyzer").alias("ruleId"), F.lit("note").alias("level"), F.struct(F.col("title").alias("text")).alias("message"), place.alias("locations"))
    return findings.select(F.col("analyzer").alias("rule_id"), F.to_json(result).alias("result"))


def sarif(findings: DataFrame, tool: str = "gleanspark") -> str:
    rows, _ = _shown(sarif_results(findings))
    rules = [{"id": r} for r in sorted({r["rule_id"] for r in rows})]
    return json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": rules}}, "results": [json.loads(r["result"]) for r in rows]}]})
