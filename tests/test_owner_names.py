from pyspark.sql import functions as F

from gleanspark.functions.fingerprints import FINGERPRINTS
from gleanspark.operators.ownership import asset_owners, name_tokens, names_of


def test_names_known_beforehand_are_those_of_columns(spark):
    names = sorted({f[0] for f in FINGERPRINTS} | {"package:Material-UI", "a_b-c"})
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", name_tokens(F.col("n")).alias("t")).collect()
    assert {r["n"]: r["t"] for r in rows} == {n: names_of(n) for n in names}


def test_texts_of_assets_are_made_once(spark):
    """Stored, so that the plan over all names reads them as they are."""
    assets = spark.createDataFrame([("https://a.example/react.js",)], "url string").withColumn("filename", F.regexp_extract("url", "([^/]+)$", 1))
    plan = asset_owners(assets)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan and "owner-assets" not in assets.columns
    assert [(r["technology"], r["affinity"]) for r in asset_owners(assets).collect()] == [("react", 95.0)]
