"""Shards of near equal size, by longest-processing-time scheduling of groups that must stay together.

The plan is made from bounded summaries: groups with more than 1/1000 of a shard (at most 1000 a shard) are planned
one by one, larger ones of the rest by hashed bundles, the others by size and number. All are taken by falling size
and given to the least-loaded shard through a heap. No row or group list of the corpus comes to the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import like, materialize, ranked, text_of

SHARDS = 8
#: Groups with more than 1/HEAVY of a shard's bytes (or rows) are planned singly: HEAVY of them a shard at most.
HEAVY = 1000
#: Groups of up to so many bytes are planned by their size: as many sizes at most.
EXACT_BYTES = 131_072
#: The rest go into so many hashed bundles.
BUNDLES = 4096


def longest_first(items: Iterable[tuple[int, int]], shards: int) -> list[list[int]]:
    """items: (size, number of groups of that size). Returns, by item, how many of its groups each shard gets.

    Items go by falling size (ties: as given) and each group to the least-loaded shard, ties to the smaller one. A
    number of equal groups is dealt at once where all loads are level: whole turns of one group a shard change no order.
    """
    items = list(items)
    heap = [(0, s) for s in range(shards)]
    out: list[list[int]] = [[0] * shards for _ in items]
    for i in sorted(range(len(items)), key=lambda i: -items[i][0]):
        size, n = items[i]
        got = out[i]
        while n:
            if n > 2 * shards and size and heap[0][0] + size > max(heap)[0]:
                # every shard is within one group of the lowest: each turn gives one group to each
                turns = n // shards - 1
                heap = [(load + turns * size, s) for load, s in heap]
                for s in range(shards):
                    got[s] += turns
                n -= turns * shards
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            got[s] += 1
            n -= 1
    return out


def shard(docs: DataFrame, *, shards: int = SHARDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row; equal texts share a shard, shards have near equal bytes.

    Size: UTF-8 bytes of the text and 1. A null text is a group of its own, apart from the empty one, with size 1 a row
    and crc32 0. Repeated rows are placed one by one in their group's shard. An empty table gives no rows; other columns are not looked at.
    Slots number a shard's rows without gaps, in the order of a hash.
    """
    text = text_of(docs, text_column)
    key = F.when(F.col(text_column).isNull(), F.lit("null")).otherwise(F.md5(text))
    rows = materialize(
        docs.select(F.col(id_column).cast("long").alias("doc_id"), key.alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("row")),
        "shard-rows",
    )
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "shard-groups")
    total = groups.agg(F.sum("bytes"), F.sum("n"), F.count(F.lit(1))).first()
    n_bytes, n_rows, n_groups = (x or 0 for x in total)
    is_heavy = (F.col("bytes") * (HEAVY * shards) > n_bytes) | (F.col("n") * (HEAVY * shards) > n_rows)
    heavy = [(r["key"], r["bytes"]) for r in groups.where(is_heavy).orderBy(F.desc("bytes"), "key").collect()]
    light = groups.where(~is_heavy)
    exact = light.where(F.col("bytes") <= EXACT_BYTES)
    bundle = F.pmod(F.xxhash64("key"), F.lit(BUNDLES)).cast("int")
    bundles = [(r["bundle"], r["bytes"]) for r in light.where(F.col("bytes") > EXACT_BYTES).groupBy(bundle.alias("bundle")).agg(F.sum("bytes").alias("bytes")).orderBy(F.desc("bytes"), "bundle").collect()]
    sizes = [(r["bytes"], r["n"]) for r in exact.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("bytes")).collect()]
    dealt = longest_first([*((b, 1) for _, b in heavy), *((b, 1) for _, b in bundles), *sizes], shards)
    one = [int(np.argmax(d)) for d in dealt[: len(heavy) + len(bundles)]]

    by_key = like(docs, [(k, s) for (k, _), s in zip(heavy, one, strict=False)], "key string, shard int")
    by_bundle = like(docs, [(k, s) for (k, _), s in zip(bundles, one[len(heavy) :], strict=False)], "bundle int, shard int")
    upto = [(b, np.cumsum(d).tolist()) for (b, _), d in zip(sizes, dealt[len(one) :], strict=True)]
    by_size = like(docs, upto, "bytes long, upto array<long>")
    place = ranked(exact, ["bytes"], ["key"], "rank", n_groups).join(F.broadcast(by_size), "bytes")
    placed = place.select("key", F.size(F.filter("upto", lambda x: x <= F.col("rank"))).cast("int").alias("shard"))
    bundled = light.where(F.col("bytes") > EXACT_BYTES).withColumn("bundle", bundle).join(F.broadcast(by_bundle), "bundle").select("key", "shard")
    # groups of many rows are all heavy: theirs is a broadcast join, and no key of the other one is large
    some = materialize(placed.unionByName(bundled), "shard-places")
    ours = rows.join(F.broadcast(by_key), "key", "left")
    of_heavy = ours.where(F.col("shard").isNotNull())
    of_light = ours.where(F.col("shard").isNull()).drop("shard").join(some, "key")
    both = of_heavy.select(*of_light.columns).unionByName(of_light)
    out = ranked(both, ["shard"], ["row"], "slot", n_rows)
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")
