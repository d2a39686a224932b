"""Sources interleaved to target weights by Pfair scheduling.

Each source's documents, in a hashed order, are cut into blocks of `block_bytes`. A source of weight p/Q owns p of any
Q slots: its i-th block is released at slot floor(i Q / p) and due by slot ceil((i + 1) Q / p). Earliest deadline
first serves one block a slot and misses no deadline, so at each slot each source is less than one block away from
its weight. Weights are whole numbers, so the schedule repeats after Q slots: one period is worked out, and a block's
slot follows from its number. When a source ends, the others go on with their weights among themselves.

The heaviest sources are scheduled one by one. All others together are scheduled as one more source, whose blocks come
in the order of their own deadlines within the group, so that there may be any number of them.
"""

from __future__ import annotations

import heapq
from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import like, materialize, range_ranked, ranked, text_of

BLOCK_BYTES = 65_536
#: Weights that aren't whole numbers are rounded to so many parts of their sum.
PARTS = 10_000
#: So many sources are scheduled one by one, the others as a group. The plan has at most (SINGLE + 1)^2 rows and
#: (SINGLE + 1) * PARTS slots.
SINGLE = 256
#: The mixture that the queries aim at: how often a source is read for each time that one not named here is.
TARGET_WEIGHTS = {"src0": 8, "src1": 6, "src2": 4, "src3": 3, "src4": 2}


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers, without a common divisor, in proportion to the weights (rounded to 1/PARTS, 1 at least)."""
    total = sum(weights.values())
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights are above 0")
    if all(float(w).is_integer() for w in weights.values()) and total <= PARTS * max(1, len(weights)):
        whole = {s: int(w) for s, w in weights.items()}
    else:
        whole = {s: max(1, round(w / total * PARTS)) for s, w in weights.items()}
    d = gcd(*whole.values())
    return {s: w // d for s, w in whole.items()}


def one_period(weights: dict[str, int]) -> dict[str, list[int]]:
    """For each source the slots, within a period of sum(weights) slots, of its blocks, in order."""
    period = sum(weights.values())
    slots: dict[str, list[int]] = {s: [] for s in weights}
    # by release: blocks that may not run yet; by deadline: those that may
    later = [(0, s) for s in sorted(weights)]
    ready: list[tuple[int, str]] = []
    heapq.heapify(later)
    for t in range(period):
        while later and later[0][0] <= t:
            _, s = heapq.heappop(later)
            i = len(slots[s])
            heapq.heappush(ready, (-(-(i + 1) * period // weights[s]), s))
        due, s = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a deadline was missed")
        slots[s].append(t)
        if (i := len(slots[s])) < weights[s]:
            heapq.heappush(later, (i * period // weights[s], s))
    return slots


def schedule(blocks: dict[str, int], weights: dict[str, int]) -> list[tuple[str, int, int, int, int, int, int, list[int]]]:
    """Rows (source, phase, first block, end block, first slot, weight, period, slots in a period), a phase ending when a source does."""
    left = {s: n for s, n in blocks.items() if n}
    done = dict.fromkeys(left, 0)
    rows = []
    base = phase = 0
    while left:
        own = {s: weights[s] for s in left}
        d = gcd(*own.values())
        own = {s: w // d for s, w in own.items()}
        period = sum(own.values())
        slots = one_period(own)
        # the slot after a source's last block ends the phase
        end = min((n - 1) // own[s] * period + slots[s][(n - 1) % own[s]] + 1 for s, n in left.items())
        for s in sorted(left):
            turns, rest = divmod(end, period)
            n = turns * own[s] + sum(x < rest for x in slots[s])
            if n:
                rows.append((s, phase, done[s], done[s] + n, base, own[s], period, slots[s]))
            done[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
        base += end
        phase += 1
    return rows


def mixed(
    docs: DataFrame, *, weights: dict[str, float] | None = None, block_bytes: int = BLOCK_BYTES, source_column: str = "source", text_column: str = "text", key_columns: tuple[str, ...] = ("doc_id",), single: int = SINGLE
) -> DataFrame:
    """All rows and columns of docs with mix_source, mix_block, mix_phase, mix_release, mix_deadline and mix_slot.

    Null sources are the source ''; sources without a weight have weight 1. Null texts count one byte, as empty ones do.
    A text longer than a block takes the slot of the block it begins in, and the next one that of the block where it
    ends. Rows of one source whose key columns are equal (nulls too) are placed together. No row is dropped or repeated: a
    source that ends leaves its slots to the others. Only columns of docs named as the new ones are replaced. An empty
    table gives no rows. Sources beyond the `single` heaviest share a group's slots; for them mix_release and mix_deadline
    are those of the group's block.
    """
    new_names = ("mix_source", "mix_block", "mix_phase", "mix_release", "mix_deadline", "mix_slot")
    own = "_mix"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    keys = [f"{own}_k{i}" for i in range(len(key_columns))]
    size, before, group = f"{own}_size", f"{own}_before", f"{own}_group"
    source = F.coalesce(F.col(source_column).cast("string"), F.lit(""))
    narrow = docs.select(source.alias("mix_source"), *[F.col(k).alias(n) for k, n in zip(key_columns, keys, strict=True)], (F.octet_length(text_of(docs, text_column)) + 1).cast("long").alias(size))
    units = materialize(narrow.groupBy("mix_source", *keys).agg(F.sum(size).alias(size)), "mix-units")
    given = {k: float(v) for k, v in (weights or {}).items()}
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in given.items() for x in kv]).cast("map<string,double>"), F.col("mix_source")), F.lit(1.0)) if given else F.lit(1.0)
    sources = units.groupBy("mix_source").agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n")).withColumn("weight", weight)
    sources = materialize(sources.withColumn("blocks", F.ceil(F.col("bytes") / block_bytes).cast("long")), "mix-sources")
    top = sources.orderBy(F.desc("weight"), F.desc("bytes"), "mix_source").limit(single).collect()
    alone = like(docs, [(r["mix_source"],) for r in top], "mix_source string")
    tail = sources.join(F.broadcast(alone), "mix_source", "left_anti")
    n_units, n_blocks, tail_weight = sources.agg(F.sum("n"), F.sum("blocks"), F.sum("weight")).first()
    blocks, wanted = {r["mix_source"]: r["blocks"] for r in top}, {r["mix_source"]: r["weight"] for r in top}
    # the group's name is longer than any source's, so it is none of theirs
    rest = "rest" + "".join(x[:1] for x in blocks) + "x" * max(map(len, blocks), default=0)
    some = len(top) == single and not tail.isEmpty()
    if some:
        blocks[rest], wanted[rest] = n_blocks - sum(blocks.values()), tail_weight - sum(wanted.values())
    plan = schedule(blocks, whole_weights(wanted) if wanted else {})

    units = ranked(units, ["mix_source"], keys, before, n_units or 0, weight=size, spread=keys)
    units = units.withColumn("mix_block", F.floor(F.col(before) / block_bytes).cast("long"))
    if some:
        # all blocks of the group's sources, empty ones too, in the order of their deadlines
        dealt = tail.select("mix_source", "weight", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("mix_block"))
        inner = range_ranked(dealt.withColumn("due", (F.col("mix_block") + 1) / F.col("weight")), ["due", "mix_source", "mix_block"], group).select("mix_source", "mix_block", group)
        units = units.join(inner, ["mix_source", "mix_block"], "left")
        planned, nth = F.when(F.col(group).isNull(), F.col("mix_source")).otherwise(F.lit(rest)), F.coalesce(F.col(group), F.col("mix_block"))
    else:
        planned, nth = F.col("mix_source"), F.col("mix_block")
    names = [f"{own}_{x}" for x in ("of", "phase", "first", "until", "base", "weight", "period", "slots")]
    kinds = ("string", "int", "long", "long", "long", "long", "long", "array<int>")
    table = like(docs, plan, ", ".join(map(" ".join, zip(names, kinds, strict=True))))
    of, phase, first, until, base, share, period, slots = map(F.col, names)
    units = units.withColumns({f"{own}_planned": planned, f"{own}_nth": nth})
    block = F.col(f"{own}_nth")
    at = units.join(F.broadcast(table), (F.col(f"{own}_planned") == of) & (block >= first) & (block < until))
    i = block - first
    turn = F.floor(i / share).cast("long")
    new = {
        "mix_phase": phase,
        "mix_release": (base + F.floor(i * period / share)).cast("long"),
        "mix_deadline": (base + F.ceil((i + 1) * period / share)).cast("long"),
        "mix_slot": base + turn * period + F.element_at(slots, (i - turn * share + 1).cast("int")),
    }
    at = at.withColumns(new).select(*keys, *new_names).withColumnRenamed("mix_source", f"{own}_source")
    kept = docs.select(*[c for c in docs.columns if c.lower() not in new_names], *[F.col(k).alias(n) for k, n in zip(key_columns, [f"{k}_own" for k in keys], strict=True)], source.alias(f"{own}_source_own"))
    on = kept[f"{own}_source_own"] == at[f"{own}_source"]
    for k in keys:
        on = on & kept[f"{k}_own"].eqNullSafe(at[k])
    joined = kept.join(at, on)
    return joined.withColumn("mix_source", F.col(f"{own}_source")).select(*[c for c in docs.columns if c.lower() not in new_names], *new_names)


def in_order(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of `mixed` dealt over the partitions by slot and sorted: read in order, they follow the schedule.

    Rows of one slot are in the order of a hash of the key, equal keys and nulls next to each other.
    """
    return rows.repartitionByRange("mix_slot", F.xxhash64(key)).sortWithinPartitions("mix_slot", F.xxhash64(key))
