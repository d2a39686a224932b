"""Generic rules over page contexts: page_id, url, filename, content, headers (map)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.functions.columns import java_pattern
from gleanspark.operators.findings import exploded, item

SNIPPET = 500


@dataclass(frozen=True)
class PageRule:
    id: str
    type: str  # regex, string or header
    pattern: str
    name: str = ""
    category: str = "INFORMATION"
    target: str = "content"
    flags: str = ""
    severity: str = "INFO"
    confidence: float = 100.0
    enabled: bool = True

    def hit(self) -> Column:
        """What the rule matches in a context, null if nothing."""
        if self.type == "header":
            regex = self.pattern.startswith("regex:")
            want = self.pattern.removeprefix("regex:")
            entries = F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>")))
            own = lambda e: F.lower(e["key"]) if self.target == "header_name" else F.concat(F.lower(e["key"]), F.lit(": "), e["value"])
            test = (lambda x: x.rlike(java_pattern(want, "i"))) if regex else (lambda x: F.lower(x).contains(want.lower()))
            first = F.try_element_at(F.array_sort(F.filter(F.transform(entries, own), test)), F.lit(1))
            return F.left(first, F.lit(SNIPPET))
        text = F.coalesce(F.col(self.target if self.target in ("content", "filename", "url") else "content"), F.lit(""))
        if self.type == "string":
            return F.when(text.contains(self.pattern), F.lit(self.pattern))
        if self.type == "regex":
            p = java_pattern(self.pattern, self.flags)
            return F.when(text.rlike(p), F.left(F.regexp_extract(text, p, 0), F.lit(SNIPPET)))
        raise ValueError(f"no rule type {self.type}")


def usable(rules: Sequence[PageRule], min_confidence: float = 0.0) -> list[PageRule]:
    """Enabled rules of enough confidence, the first of each id."""
    out: dict[str, PageRule] = {}
    for r in rules:
        if r.enabled and r.confidence >= min_confidence:
            out.setdefault(r.id, r)
    return list(out.values())


def rule_findings(contexts: DataFrame, rules: Sequence[PageRule], min_confidence: float = 0.0) -> DataFrame:
    """A finding for each context and usable rule that matches it; one pass over the contexts."""
    found = []
    for r in usable(rules, min_confidence):
        hit = r.hit()
        found.append(F.when(hit.isNotNull(), item(f"rule:{r.id}", r.category, F.lit(r.id), F.lit(r.name or r.id), severity=r.severity, confidence=r.confidence, evidence=hit, location=F.col("url"))))
    return exploded(contexts, [F.array_compact(F.array(*found))])


def load_rules(folder: str) -> list[PageRule]:
    """Rules of a folder's YAML and JSON files: a list, one rule, or a list under `rules`."""
    import yaml

    known = set(PageRule.__dataclass_fields__)
    out = []
    for p in sorted(x for x in Path(folder).rglob("*") if x.suffix in (".yaml", ".yml", ".json")):
        found = yaml.safe_load(p.read_text())
        found = found.get("rules", [found]) if isinstance(found, dict) else found or []
        out += [PageRule(**{k: v for k, v in r.items() if k in known}) for r in found]
    return out
