"""Connected components of any number of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns id, root for each id in a link: the smallest id that it reaches.

    Each round every node joins its smallest neighbour, chains are followed twice, and links between what has become
    one node vanish. All state is in tables; a hub's links are joined with skew handling and only ever aggregated.
    """
    links = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    known: DataFrame | None = None
    while not links.isEmpty():
        # to each node its smallest neighbour, if smaller
        parent = materialize(links.groupBy("a").agg(F.min("b").alias("up")), "parents")
        for _ in range(2):
            further = parent.select(F.col("a").alias("up"), F.col("up").alias("higher"))
            new = materialize(parent.join(further, "up", "left").select("a", F.coalesce("higher", "up").alias("up")), "parents")
            discard(parent)
            parent = new
        nodes = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
        step = materialize(nodes.join(parent.withColumnRenamed("a", "id"), "id", "left").select("id", F.coalesce("up", "id").alias("root")), "roots")
        a = step.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        b = step.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        new = links.join(a, "a").join(b, "b").where("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct()
        new = materialize(new, "links")
        discard(links)
        links = new
        if known is None:
            known = step
        else:
            later = step.select(F.col("id").alias("root"), F.col("root").alias("next"))
            known = materialize(known.join(later, "root", "left").select("id", F.coalesce("next", "root").alias("root")), "roots")
    return links.select(F.col("a").alias("id"), F.col("b").alias("root")) if known is None else known
