"""Source maps as tables: what they map, and the packages whose files they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.functions.columns import java_pattern
from gleanspark.operators.evidence import package_identity

#: A map within a script, as base64.
INLINE_MAP = r"sourceMappingURL=data:application/json[^,\s]*;base64,([A-Za-z0-9+/=]+)"

#: The package within the last node_modules of a path; scoped names have two parts.
LAST_PACKAGE = r"^(?:.*/)?node_modules/((?:@[\w.-]+/)?[\w.-]+)"


def inline_maps(scripts: DataFrame) -> DataFrame:
    """script_id, position (from 0), text: the maps that scripts (script_id, content) carry themselves."""
    found = F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(java_pattern(INLINE_MAP)), F.lit(1))
    rows = scripts.select("script_id", F.posexplode(found).alias("position", "code"))
    return rows.select("script_id", "position", F.try_to_binary("code", F.lit("base64")).cast("string").alias("text"))


def _texts(map_: Column, path: str) -> Column:
    """The strings of a list; other members are left out, and what isn't a list has none."""
    members = F.coalesce(F.try_variant_get(map_, path, "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(F.filter(members, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))


def parsed_maps(maps: DataFrame, key: str = "map_id") -> DataFrame:
    """key, status, version, file, sources, names, n_contents of each map (key, text).

    status: ok, broken (not JSON, or null) or not_object; only maps that are ok have the rest. version must be a whole
    number and file a string, else they are null; of lists the strings count. Members of unexpected kinds do no harm.
    """
    given = maps.select(key, F.try_parse_json("text").alias("m"))
    kind = F.schema_of_variant("m")
    ok = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    status = F.when(F.col("m").isNull(), "broken").when(ok, "ok").otherwise("not_object")
    map_ = F.when(ok, F.col("m"))
    typed = lambda name, wanted, cast: F.when(F.schema_of_variant(F.try_variant_get(map_, f"$.{name}", "variant")) == wanted, F.try_variant_get(map_, f"$.{name}", cast))
    return given.select(
        key,
        status.alias("status"),
        typed("version", "BIGINT", "long").alias("version"),
        typed("file", "STRING", "string").alias("file"),
        F.when(ok, _texts(map_, "$.sources")).alias("sources"),
        F.when(ok, _texts(map_, "$.names")).alias("names"),
        F.when(ok, F.size(_texts(map_, "$.sourcesContent"))).alias("n_contents"),
    )


def map_sources(parsed: DataFrame, key: str = "map_id") -> DataFrame:
    """key, position (from 0), source, package: the files of parsed maps, and the package whose file it is, null if none."""
    rows = parsed.select(key, F.posexplode("sources").alias("position", "source"))
    named = F.regexp_extract("source", LAST_PACKAGE, 1)
    return rows.select(key, "position", "source", F.when(package_identity(named).isNotNull(), named).alias("package"))
