"""Best-fit packing of token sequences, in bulk-synchronous steps.

Documents become pieces of at most `capacity` tokens, taken by classes of falling length. A superstep range-sorts the
pieces of a class and the gaps of all open sequences by size and sweeps both from the largest down: a gap waits until
a piece no larger comes, and a piece takes the gap that came last, its smallest successor. That is how brackets match,
so a distributed prefix sum does it: a piece and a gap that meet have the same depth, and where several pieces want
one gap, the rank at this depth decides. Then the gaps are updated. Of the pieces left over, the largest fill as many
new sequences as must be opened, in the order of falling length, as best fit does with pieces that no gap takes. The
step is repeated with the others, until none is left.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import accumulate, chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from gleanspark.llm.common import few_rows_a_batch, materialize, parcels, prepared, range_ranked, released, text_of

CAPACITY = 2048
END_ID = 0
#: A task keeps the ids of parts of words it has met, and of those met before that, each in about so many bytes; longer ones are not kept.
KEPT_BYTES = 32 << 20
KEPT_LENGTH = 64
#: Rows of texts that go to Python at once.
BATCH_ROWS = 1000
#: Words that the tokenizer's steps before its merges leave as they are: ASCII but the apostrophe, small Latin-1 letters;
#: texts of such words alone; the parts that its pattern cuts them into; words, parted by ASCII white space.
_PLAIN = re.compile("[!-&(-~ß-öø-ÿ]+")
_PLAIN_TEXT = re.compile("[\\t-\\r -&(-~ß-öø-ÿ]*")
_PARTS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\\t-\\r ]+")
_WORDS = re.compile("[^\\t-\\r ]+")
#: The character of the vocabulary for each byte: printable ones themselves, the others by 256 and on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_CHARACTER = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(_PRINTED))}
#: Lengths are taken by classes: up to the whole capacity, a half of it, a third ...
CLASSES = (1, 2, 3, 4, 8, 16, 32)
#: Supersteps of a class end when gaps could save no more than one in so many sequences: of the last class, and of
#: others, whose sequences shorter pieces still fill.
WASTE, FILLED_LATER = 500, 50


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """The library's ids of whole texts.

    Where the tokenizer drops white space between words and changes nothing across it, a text's ids are those of its
    words, parted by ASCII white space. Plain words are cut into the parts that the tokenizer's pattern makes of them,
    each of which goes to the library's merges once; others go through all its steps. Other tokenizers get whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        told = json.loads(Path(path).read_text())
        steps = [x.get("type") for x in (told.get("normalizer") or {}).get("normalizers", [])]
        splits = [x for x in (told.get("pre_tokenizer") or {}).get("pretokenizers", []) if x.get("type") == "Split"]
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and [(x["behavior"], x["invert"]) for x in splits] == [("Removed", True)] and "\\s" in splits[0]["pattern"].get("Regex", "")
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.size = 0

    def forget(self) -> None:
        """Drop all parts: workers outlive their tasks, and other stages need the memory."""
        self.known, self.before, self.size = {}, {}, 0

    @staticmethod
    def _cut(text: str) -> list[str]:
        """The parts of a text's plain words, and its other words as they are."""
        low = text.lower()
        if _PLAIN_TEXT.fullmatch(low) and "<|" not in low:
            return _PARTS.findall(low)
        out = []
        for word in _WORDS.findall(text.encode("utf-8", "replace").decode()):
            low = word.lower()
            if _PLAIN.fullmatch(low) and "<|" not in low:
                out += _PARTS.findall(low)
            else:
                out.append(word)
        return out

    def _learn(self, new: list[str]) -> None:
        """Add the library's ids of parts and words; those of many are made into one array."""
        merged = self.library.model.tokenize
        for k in range(0, len(new), 5000):
            plain, other = [], []
            for x in new[k : k + 5000]:
                (plain if _PLAIN.fullmatch(x) and "<|" not in x else other).append(x)
            found = [[t.id for t in merged(x if x.isascii() else x.encode().decode("latin-1").translate(_CHARACTER))] for x in plain]
            found += [e.ids for e in self.library.encode_batch(other, add_special_tokens=False)] if other else []
            raw = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
            ends = list(accumulate(4 * len(ids) for ids in found))
            self.known.update(zip(plain + other, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=False))

    def ids(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]
        cut = [self._cut(t) for t in texts]
        if self.size > KEPT_BYTES:
            self.before, self.known, self.size = self.known, {}, 0
        new = set(chain.from_iterable(cut)).difference(self.known)
        met = new.intersection(self.before)
        self.known.update((x, self.before[x]) for x in met)
        self._learn(list(new.difference(met)))
        get = self.known.__getitem__
        out = [b"".join(map(get, parts)) for parts in cut]
        for x in new:
            if len(x) > KEPT_LENGTH:
                del self.known[x]
            else:
                self.size += 200 + len(x)
        return out


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text", order_column: str | None = None) -> DataFrame:
    """row, doc_id, piece, start, length, ids_crc32 of every piece of every row; row: the order column, or any number."""
    prepared(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    row = F.col(order_column).cast("long") if order_column else F.monotonically_increasing_id()
    rows = docs.select(row.alias("row"), F.col(id_column).cast("long").alias("doc_id"), text_of(docs, text_column).alias("text"))
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = word_ids(path)
        for b in batches:
            i = 0
            for part in parcels(b.column(2)):
                of, piece, start, length, crc = [], [], [], [], []
                for raw in w.ids(part):
                    whole = raw + end
                    for k, a in enumerate(range(0, len(whole), 4 * capacity)):
                        cut = whole[a : a + 4 * capacity]
                        of.append(i)
                        piece.append(k)
                        start.append(a // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                    i += 1
                at = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())],
                    names=["row", "doc_id", "piece", "start", "length", "ids_crc32"],
                )
        w.forget()
        released()

    return rows.mapInArrow(run, "row long, doc_id long, piece int, start long, length int, ids_crc32 long")


def sweep(items: DataFrame, gaps: DataFrame, *, high: int, low: int, slots: int, chunks: int) -> DataFrame:
    """One superstep. items: id, length (low < length <= high); gaps: bin, gap. Returns kind, ref, size, gap, level, mate, mate_size.

    Rows of kind 0 are gaps, or their slots: one for each `high` tokens of a gap, `slots` at most, and the rest of it if
    it may hold a piece. Rows of kind 1 are pieces; mate is the bin a piece goes to. Pieces without a mate have the
    levels 0, -1, -2 ... by falling length. Each of a gap's slots is matched with one piece at most.

    Rows of one size are cut into `chunks` by a hash; sums over the chunks and ranks inside them give a row's depth.
    """
    whole = F.least(F.floor(F.col("gap") / high), F.lit(slots)).cast("int")
    rest = F.col("gap") - whole * high
    rest = F.when((rest > low) & (rest < high), F.array(rest.cast("int"))).otherwise(F.array().cast("array<int>"))
    opened = gaps.where(F.col("gap") > low).select(F.lit(0).alias("kind"), F.col("bin").alias("ref"), F.explode(F.concat(F.array_repeat(F.lit(high), whole), rest)).alias("size"), F.col("gap").cast("int").alias("gap"))
    closed = items.select(F.lit(1).alias("kind"), F.col("id").alias("ref"), F.col("length").cast("int").alias("size"), F.lit(0).alias("gap"))
    chunk = ["size", "kind", "gap", "chunk"]
    events = opened.unionByName(closed).withColumn("chunk", F.pmod(F.xxhash64("ref"), F.lit(chunks)).cast("int"))
    per = events.groupBy(*chunk).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.desc("size"), "kind", F.desc("gap"), "chunk")
    per = per.withColumn("at", F.row_number().over(order)).withColumn("before", F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(-F.col("n"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy(*chunk).orderBy("ref"))
    placed = events.withColumn("nth", nth).join(per.drop("n"), chunk)
    level = F.when(F.col("kind") == 0, F.col("before") + F.col("nth")).otherwise(F.col("before") - F.col("nth") + 1)
    by_level = Window.partitionBy("level").orderBy("at")
    met = placed.withColumn("level", level)
    met = met.withColumns({"prev_kind": F.lag("kind").over(by_level), "prev_ref": F.lag("ref").over(by_level), "next_kind": F.lead("kind").over(by_level), "next_size": F.lead("size").over(by_level)})
    mate = F.when((F.col("kind") == 1) & (F.col("prev_kind") == 0), F.col("prev_ref"))
    mate_size = F.when((F.col("kind") == 0) & (F.col("next_kind") == 1), F.col("next_size"))
    return met.select("kind", "ref", "size", "gap", "level", mate.alias("mate"), mate_size.alias("mate_size"))


def dealing(of_length: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """How pieces by falling length fill new sequences, each with as many as its first and longest one fits in.

    of_length: how many pieces there are of each length. By length: the rank of its first piece; how many of its first
    pieces go to the sequence `at` that longer ones opened; the number of the first sequence that it opens itself, and
    how many pieces that one and each after it get. Then the number of sequences.
    """
    out, first, opened, room = [], 0, 0, 0
    for length, n in sorted(of_length.items(), reverse=True):
        carried, deal = min(n, room), capacity // length
        out.append((length, first, carried, opened - 1, opened, deal))
        room -= carried
        if n > carried:
            own = -(-(n - carried) // deal)
            opened += own
            room = own * deal - (n - carried)
        first += n
    return out, opened


def best_fit(items: DataFrame, capacity: int) -> DataFrame:
    """items: id, length (1 to capacity). Returns id, bin: no bin's lengths sum up to more than capacity; a bin is named by an item in it."""
    spark = items.sparkSession
    bounds = sorted({capacity // c for c in CLASSES if capacity // c} | {0}, reverse=True)
    of_class = F.lit(len(bounds) - 2)
    for k in range(len(bounds) - 2, -1, -1):
        of_class = F.when(F.col("length") > bounds[k + 1], F.lit(k)).otherwise(of_class)
    counts = {r["class"]: (r["n"], r["longest"]) for r in items.groupBy(of_class.alias("class")).agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).collect()}
    placed: list[DataFrame] = []
    bins = spark.createDataFrame([], "bin long, gap int")
    wide, opened, free = [0] * len(bounds), 0, 0  # gaps above each bound, sequences, tokens in gaps that the longest piece left fits in

    def kept(now: DataFrame, longest: int) -> DataFrame:
        """The gaps that are left, written; what counts of them is counted as they are."""
        nonlocal wide, free
        seen = Observation()
        room = F.coalesce(F.sum(F.when(F.col("gap") >= longest, F.col("gap").cast("long"))), F.lit(0)).alias("room")
        written = materialize(now.where("gap > 0").observe(seen, room, *[F.count_if(F.col("gap") > b).alias(f"n{k}") for k, b in enumerate(bounds)]), "pack-bins")
        wide, free = [seen.get[f"n{k}"] for k in range(len(bounds))], seen.get["room"]
        return written

    for k, (high, low) in enumerate(zip(bounds, bounds[1:], strict=False)):
        n, longest = counts.get(k, (0, 0))
        left = items.where((F.col("length") > low) & (F.col("length") <= high)).select("id", "length")
        if n and capacity // (low + 1) == 1:
            # no two fit together, and nothing is open yet
            placed.append(left.select("id", F.col("id").alias("bin")))
            bins, opened, n = kept(left.select(F.col("id").alias("bin"), (F.lit(capacity) - F.col("length")).cast("int").alias("gap")), 1), opened + n, 0
        while n:
            chunks = max(1, int((n + wide[k + 1]) ** 0.5) // 256)
            step = sweep(left, bins, high=longest, low=low, slots=max(1, -(-2 * n // max(1, wide[k + 1]))), chunks=chunks)
            alone, seen = (F.col("kind") == 1) & F.col("mate").isNull(), Observation()
            told = [F.count_if(alone).alias("n"), F.coalesce(F.sum(F.when(alone, F.col("size"))), F.lit(0)).alias("tokens"), F.coalesce(F.max(F.when(alone, F.col("size"))), F.lit(1)).alias("longest")]
            step = materialize(step.observe(seen, *told), "pack-step")
            n, tokens, longest = (seen.get[c] for c in ("n", "tokens", "longest"))
            placed.append(step.where("kind = 1 and mate is not null").select(F.col("ref").alias("id"), F.col("mate").alias("bin")))
            used = step.where("kind = 0").groupBy(F.col("ref").alias("bin")).agg((F.max("gap") - F.coalesce(F.sum("mate_size"), F.lit(0))).cast("int").alias("gap"))
            bins = kept(bins.where(F.col("gap") <= low).unionByName(used), longest)
            if not n:
                continue
            ranked_left = step.where(alone).select(F.col("ref").alias("id"), F.col("size").alias("length"), (-F.col("level")).alias("rank"))
            of_length = {r["length"]: r["n"] for r in ranked_left.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
            plan, all_of_them = dealing(of_length, capacity)
            # so many sequences must be opened whatever the gaps take; where they can save few more, all that is left opens some
            must = max(0, -(-(tokens - free) // capacity))
            if (all_of_them - must) * (FILLED_LATER if low else WASTE) <= opened + must:
                must = all_of_them
            plan = spark.createDataFrame(plan, "length int, first long, carried long, at long, base long, deal long")
            later = F.col("rank") - F.col("first") - F.col("carried")
            group_of = F.when(later < 0, F.col("at")).otherwise(F.col("base") + F.floor(later / F.col("deal")))
            together, seen = Window.partitionBy("group").orderBy("rank"), Observation()
            dealt = ranked_left.join(F.broadcast(plan), "length").withColumn("group", group_of).withColumn("bin", F.when(F.col("group") < must, F.first("id").over(together)))
            told = [F.count_if(F.col("bin").isNull()).alias("n"), F.count_if(F.col("bin") == F.col("id")).alias("opened"), F.coalesce(F.max(F.when(F.col("bin").isNull(), F.col("length"))), F.lit(0)).alias("longest")]
            dealt = materialize(dealt.select("id", "length", "bin").observe(seen, *told), "pack-dealt")
            n, longest, opened = seen.get["n"], seen.get["longest"], opened + seen.get["opened"]
            placed.append(dealt.where("bin is not null").select("id", "bin"))
            bins = bins.unionByName(dealt.where("bin is not null").groupBy("bin").agg((F.lit(capacity) - F.sum("length")).cast("int").alias("gap")))
            wide = [w + seen.get["opened"] for w in wide]
            left = dealt.where("bin is null").select("id", "length")
    return reduce(DataFrame.unionByName, placed) if placed else spark.createDataFrame([], "id long, bin long")


def pack(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text", order_column: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row.

    A row's tokens are its text's ids (null: none) and the end id 0; only rows longer than `capacity` are cut, wherever
    in the text that is, however long it is. Rows that repeat are packed each; pieces of equal length go in the order
    of a number of their own. An empty table gives no rows; other columns are not looked at.

    order_column: a column with a different whole number for each row. Sequences are then numbered from 0 in the order
    of the rows whose pieces opened them, so that who reads sequence after sequence meets the rows' order.
    """
    cut = pieces(docs, tokenizer=tokenizer, capacity=capacity, id_column=id_column, text_column=text_column, order_column=order_column)
    with few_rows_a_batch(docs.sparkSession, BATCH_ROWS):
        cut = materialize(cut.withColumn("id", F.monotonically_increasing_id()), "pack-pieces")
    binned = cut.join(best_fit(cut.select("id", "length"), capacity), "id")
    inside = Window.partitionBy("bin").orderBy("row", "piece", "id")
    offset = F.coalesce(F.sum(F.col("length").cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = binned.withColumn("offset", offset.cast("long"))
    if order_column:
        opened = materialize(cut.select("id", "row", "piece").join(binned.select(F.col("bin").alias("id")).distinct(), "id"), "pack-opened")
        numbered = range_ranked(opened, ["row", "piece", "id"], "sequence_id").select(F.col("id").alias("bin"), "sequence_id")
        out = out.join(numbered, "bin")
    else:
        out = out.withColumn("sequence_id", F.col("bin"))
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
