"""Hard negatives by branch and bound over ball trees.

Vectors become whole numbers, floor(scale x). Rows are grouped by label and dealt to cells by pivots, and the rows of a
group and cell to blocks of bounded size, each with a ball tree. All inner products of a query q with the rows of a ball
of centre c and radius r lie within q.c - |q| r and q.c + |q| r. A node is passed over if this range lies outside the
window of scores that is asked for, or strictly beneath the current k-th score, or if its labels can't count.

Positives are looked for among the rows of an anchor's label, then negatives in the windows that the positives' scores
make. Both start in the anchor's own cell; other cells get a copy of the anchor if their ball can still matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.llm.common import few_rows_a_batch, materialize
from gleanspark.llm.vector_blocks import MOST_ROWS, PACK_QUERIES, SHARED_BYTES, Best, block_rows, drawn, entries, extent, fits, matrix, one_row_an_id, whole_vectors
from gleanspark.llm.vectors import floors, scores

SCALE = 256
LEAF_ROWS = 64
#: Labels are put into so many groups at most that each has about so many rows.
GROUP_ROWS = MOST_ROWS // 8
_LONG = (1 << 63) - 1

_NODE = np.dtype([("radius", "<f8"), ("least_label", "<i8"), ("most_label", "<i8"), ("left", "<i8"), ("right", "<i8"), ("start", "<i8"), ("stop", "<i8")])


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num(np.sqrt(((x - y) ** 2).sum(1)), nan=np.inf)


def grow(x: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A ball tree over the rows of x: nodes, their centres, and the order of rows in which each node's stand together."""
    nodes, centres, order = [], [], []
    todo = [(np.arange(len(x)), -1, "left")]
    while todo:
        rows, parent, side = todo.pop()
        part, me = x[rows], len(nodes)
        with np.errstate(over="ignore", invalid="ignore"):
            centre = part.mean(0)
        far = _far(part, centre)
        # a margin for the rounding of distances, far below the unit of scores
        node = {"radius": far.max() * (1 + 1e-9) + 1e-6, "least_label": labels[rows].min(), "most_label": labels[rows].max(), "left": -1, "right": -1, "start": -1, "stop": -1}
        nodes.append(node)
        centres.append(centre)
        if parent >= 0:
            nodes[parent][side] = me
        if len(rows) <= LEAF_ROWS:
            node |= {"start": len(order), "stop": len(order) + len(rows)}
            order += rows.tolist()
            continue
        one = part[far.argmax()]
        other = part[_far(part, one).argmax()]
        with np.errstate(over="ignore", invalid="ignore"):
            by = np.argsort(np.nan_to_num(part @ (other - one)), kind="stable")
        half = len(rows) // 2
        todo += [(rows[by[half:]], me, "right"), (rows[by[:half]], me, "left")]
    return np.array([tuple(n[k] for k in _NODE.names) for n in nodes], _NODE), np.array(centres), np.array(order, np.int64)


def reach(q: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query with each ball: the least and the largest inner product that there can be, and the one with the centre."""
    with np.errstate(over="ignore", invalid="ignore"):
        middle, length = q @ centres.T, np.sqrt((q**2).sum(1))[:, None] * radius[None, :]
        slack = 1e-12 * (np.abs(q) @ np.abs(centres).T + length) + 1
        return middle - length - slack, middle + length + slack, np.nan_to_num(middle)


class Search:
    """Windows of scores asked of one block: each slot has a query, its lowest score so far, and the highest one allowed."""

    def __init__(self, nodes: np.ndarray, centres: np.ndarray, x: np.ndarray, labels: np.ndarray, ids: list[list[int]], queries: np.ndarray, query_labels: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool, scale: int) -> None:
        self.x, self.labels, self.q, self.of, self.high, self.scale = x, labels, queries, of, high, scale
        self.ids = np.array([i for row in ids for i in row], np.int64)
        self.n_ids = np.array([len(row) for row in ids], np.int64)
        self.first_id = np.cumsum(self.n_ids) - self.n_ids
        self.label, self.same = query_labels, same
        self.best = Best(len(of), k, ~low)  # costs: the scores' complements, as whole numbers of the reverse order
        least, most, middle = reach(floors(queries, scale), centres, nodes["radius"])
        if same:
            can = (nodes["least_label"] <= query_labels[:, None]) & (nodes["most_label"] >= query_labels[:, None])
        else:
            can = (nodes["least_label"] != query_labels[:, None]) | (nodes["most_label"] != query_labels[:, None])
        todo = [(0, np.arange(len(of)))]
        while todo:
            k_node, at = todo.pop()
            query = of[at]
            at = at[can[query, k_node] & ~(most[query, k_node] < ~self.best.limit[at]) & ~(least[query, k_node] > high[at])]
            if not len(at):
                continue
            node = nodes[k_node]
            if node["left"] < 0:
                self._leaf(int(node["start"]), int(node["stop"]), at)
                continue
            a, b = int(node["left"]), int(node["right"])
            sides = [(a, at), (b, at)]
            todo += sides[::-1] if (middle[of[at], a] > middle[of[at], b]).sum() * 2 >= len(at) else sides

    def _leaf(self, a: int, b: int, at: np.ndarray) -> None:
        asked, which = np.unique(self.of[at], return_inverse=True)
        got = scores(self.x[a:b], self.q[asked], self.scale).T[which]
        alike = self.labels[None, a:b] == self.label[self.of[at]][:, None]
        hit_s, hit_x = np.nonzero((got >= ~self.best.limit[at][:, None]) & (got <= self.high[at][:, None]) & (alike == self.same))
        n = self.n_ids[a + hit_x]
        pick = np.repeat(self.first_id[a + hit_x] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        self.best.add(np.repeat(at[hit_s], n), np.repeat(~got[hit_s, hit_x], n), self.ids[pick])


def hard_negatives(
    vectors: DataFrame,
    *,
    positives: int = 5,
    negatives: int = 3,
    anchor_every: int = 50,
    low_percent: int = 50,
    high_percent: int = 95,
    scale: int = SCALE,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by `anchor_every`; a row's score is its inner product with the anchor, of
    the whole numbers floor(scale x) (scale: a power of two). An anchor's positives are the first rows of its label by
    falling score, ties by smaller id; a positive's negatives the first rows of other labels whose scores lie from
    low_percent to high_percent of the positive's. Where there are fewer, all are given; a positive without a negative
    has no row.

    Rows without id or label and vectors that are null or empty or hold null or non-finite components take no part.
    Vectors of unequal length are compared as if zeros followed the shorter. Of the rows that repeat an id one stands,
    the one with the smallest vector by bytes, then the smallest label. Equal vectors of one label are one entry with as
    many of the smallest ids as an answer can hold. Scores beyond the range of a long become its ends. An empty table
    gives no rows; other columns aren't looked at.
    """
    spark = vectors.sparkSession
    given = vectors.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull())
    rows = one_row_an_id(materialize(whole_vectors(given, id_column, vector_column, label_column), "mine-rows"))
    whole = materialize(entries(rows, ["label", "v"], max(positives + 1, negatives)), "mine-entries")
    n, width = extent(whole)
    size, most = block_rows(width), max(1, SHARED_BYTES // (8 * width))
    labels = whole.agg(F.approx_count_distinct("label")).first()[0]
    groups = max(1, min(labels, n // GROUP_ROWS))
    blobs = drawn(whole, n, min(most, max(1, n // (size * groups))))[: 2 * most] or [bytes(8)]
    pivots = floors(matrix(blobs, width), scale)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            half = (pivots**2).sum(1) / 2
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096)
                x = floors(matrix(part.column(2).to_pylist(), width), scale)
                with np.errstate(all="ignore"):
                    cell = np.nan_to_num(half - x @ pivots.T, nan=np.inf).argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(_far(x, pivots[cell]))], names=["ids", "label", "v", "cell", "far"])

    def in_cells(df: DataFrame) -> DataFrame:
        found = df.select("ids", "label", "v").mapInArrow(assign, "ids array<long>, label long, v binary, cell int, far double")
        return found.withColumn("grp", F.pmod(F.xxhash64("label"), F.lit(groups)).cast("int"))

    placed = materialize(in_cells(whole), "mine-placed")
    sizes = materialize(placed.groupBy("grp", "cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks")), "mine-sizes")
    radius = np.full(len(pivots), -1.0)
    for r in placed.groupBy("cell").agg(F.max("far").alias("far")).collect():  # one row a pivot
        radius[r["cell"]] = r["far"] * (1 + 1e-9) + 1e-6

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        raw, of = matrix(table["v"].to_pylist(), width), table["label"].to_numpy()
        nodes, centres, order = grow(floors(raw, scale), of)
        ids = table["ids"].combine_chunks().take(pa.array(order))
        one = pa.array([0, len(order)], pa.int32())
        parts = [pa.array([z], pa.binary()) for z in (raw[order].tobytes(), nodes.tobytes(), centres.tobytes())]
        return pa.table([pa.array([z.as_py()], pa.int32()) for z in key] + [*parts, pa.ListArray.from_arrays(one, pa.array(of[order])), pa.ListArray.from_arrays(one, ids)], names=["grp", "cell", "block", "x", "nodes", "centres", "labels", "ids"])

    dealt = placed.drop("far").join(fits(sizes), ["grp", "cell"]).withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")).drop("blocks")
    index = materialize(dealt.groupBy("grp", "cell", "block").applyInArrow(build, "grp int, cell int, block int, x binary, nodes binary, centres binary, labels array<long>, ids array<array<long>>"), "mine-index")

    anchors = rows.where(F.pmod("vec_id", F.lit(anchor_every)) == 0).select(F.col("vec_id").alias("anchor_id"), "label", "v")
    asked = in_cells(anchors.dropDuplicates(["label", "v"]).withColumn("ids", F.array().cast("array<long>"))).withColumn("key", F.monotonically_increasing_id())
    asked = materialize(asked.select("key", "label", "v", "grp", "cell"), "mine-asked")

    def searched(wanted: DataFrame, k: int, same: bool, label: str) -> DataFrame:
        """key, about, vec_id, cost: of each window (about, low, high) of the queries the k first rows, in the blocks of their cells.

        Only rows of the query's label (of its group) count, or only those of others (of all groups).
        """

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for x, nodes, centres, of_rows, ids, queries in zip(*(b.column(c) for c in ("x", "nodes", "centres", "labels", "ids", "queries")), strict=True):
                    queries = queries.as_py()
                    slots = [(i, w) for i, e in enumerate(queries) for w in e["windows"]]
                    at = np.array([i for i, _ in slots], np.int64)
                    low, high, about = (np.array([w[c] for _, w in slots], np.int64) for c in ("low", "high", "about"))
                    q, of = matrix([e["v"] for e in queries], width), np.array([e["label"] for e in queries], np.int64)
                    tree = np.frombuffer(nodes.as_py(), _NODE), np.frombuffer(centres.as_py(), "<f8").reshape(-1, width)
                    data = np.frombuffer(x.as_py(), "<f8").reshape(-1, width), np.array(of_rows.as_py(), np.int64), ids.as_py()
                    slot, cost, vec = Search(*tree, *data, q, of, at, low, high, k, same, scale).best.rows()
                    keys = np.array([e["key"] for e in queries], np.int64)[at]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[slot]), pa.array(about[slot]), pa.array(vec), pa.array(cost)], names=["key", "about", "vec_id", "cost"])

        by = ["grp", "cell"] if same else ["cell"]
        wanted = materialize(wanted.select("key", "label", "v", "windows", *by), f"mine-{label}-wanted")
        packs = materialize(wanted.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / PACK_QUERIES).alias("packs")), f"mine-{label}-packs")
        packed = wanted.join(fits(packs), by).withColumn("pack", F.pmod(F.xxhash64("key"), F.col("packs")))
        packed = packed.groupBy(*by, "pack").agg(F.collect_list(F.struct("key", "label", "v", "windows")).alias("queries"))
        everywhere = packed.join(fits(sizes), by).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        with few_rows_a_batch(spark, 1):
            met = everywhere.join(index, ["grp", "cell", "block"]).select("x", "nodes", "centres", "labels", "ids", "queries")
            found = materialize(met.mapInArrow(solve, "key long, about long, vec_id long, cost long"), f"mine-{label}")
        nth = F.row_number().over(Window.partitionBy("key", "about").orderBy("cost", "vec_id"))
        return found.withColumn("nth", nth).where(F.col("nth") <= k)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                least, largest, _ = reach(floors(matrix(part.column(2).to_pylist(), width), scale), pivots, np.maximum(radius, 0))
                need = np.zeros(least.shape, bool)
                for i, windows in enumerate(part.column(3).to_pylist()):
                    for w in windows:
                        need[i] |= ~(largest[i] < w["low"]) & ~(least[i] > w["high"])
                need &= radius >= 0
                need[np.arange(len(need)), part.column(5).to_numpy()] = False
                at, to = np.nonzero(need)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in part.columns[:5]), pa.array(to.astype(np.int32))], names=list(part.schema.names))

    window = "array<struct<about: long, low: long, high: long>>"

    def first(wanted: DataFrame, k: int, same: bool, label: str) -> DataFrame:
        """The k first rows of each window over all cells: the own one, then those that can still matter."""
        own = searched(wanted, k, same, f"{label}-own")
        reached = own.where(F.col("nth") == k).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("about", F.bitwise_not("cost").alias("low")))).alias("reached"))
        raised = F.transform("windows", lambda w: F.struct(w["about"].alias("about"), F.coalesce(F.element_at("reached", w["about"]), w["low"]).alias("low"), w["high"].alias("high")))
        told = wanted.join(reached, "key", "left").select("key", "label", "v", raised.cast(window).alias("windows"), "grp", "cell")
        others = searched(told.mapInArrow(route, f"key long, label long, v binary, windows {window}, grp int, cell int"), k, same, f"{label}-others")
        nth = F.row_number().over(Window.partitionBy("key", "about").orderBy("cost", "vec_id"))
        return own.unionByName(others).withColumn("nth", nth).where(F.col("nth") <= k)

    anything = F.array(F.struct(F.lit(0).cast("long").alias("about"), F.lit(-_LONG - 1).alias("low"), F.lit(_LONG).alias("high")))
    alike = first(asked.withColumn("windows", anything), positives + 1, True, "positives")
    answers = alike.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("cost", "vec_id"))).alias("found"))
    not_own = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("anchor_id")), 1, positives)
    paired = anchors.join(asked.select("label", "v", "key"), ["label", "v"]).join(answers, "key").select("anchor_id", "key", F.explode(not_own).alias("one"))
    pairs = materialize(paired.select("anchor_id", "key", F.col("one.vec_id").alias("positive_id"), F.bitwise_not("one.cost").alias("positive_score")), "mine-pairs")

    score = F.col("positive_score").cast("decimal(20,0)")
    low, high = F.ceil(score * low_percent / 100), F.floor(score * high_percent / 100)
    windows = pairs.select("key", "positive_score").distinct().select("key", F.col("positive_score").alias("about"), low.cast("long").alias("low"), high.cast("long").alias("high"))
    windows = windows.where("low <= high").groupBy("key").agg(F.collect_list(F.struct("about", "low", "high")).alias("windows"))
    unlike = first(asked.join(windows, "key"), negatives, False, "negatives")
    mined = unlike.select("key", F.col("about").alias("positive_score"), F.col("nth").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.bitwise_not("cost").alias("negative_score"))
    return pairs.join(mined, ["key", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
