"""Nearest neighbours by vantage-point trees, one or more to a shard.

A vantage-point tree over a bounded sample deals all rows to shards: its leaves. A shard's rows go to blocks of bounded
size, and each block gets a tree of its own, so every row is indexed. A node keeps a vantage point and how near and how
far from it the rows on either side are. By the triangle inequality no row of a side is nearer to a query than the
query's own distance from the vantage point lies outside this range. A side is passed over if this bound, times a
factor, is beyond the k-th distance found so far. Factor one is exact search; a larger one looks at less, and what it
misses is never nearer than the k-th distance it returns divided by the factor.

Queries are solved in their own shard first. The shards that the bounds leave get a copy of the query with its k-th
distance so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.llm.common import few_rows_a_batch, like, materialize
from gleanspark.llm.vector_blocks import PACK_QUERIES, SAMPLE_BYTES, SHARED_BYTES, Best, block_rows, drawn, entries, extent, matrix, one_row_an_id, whole_vectors

#: What bounds are multiplied by before they are held against the k-th distance.
FACTOR = 2.0
LEAF_ROWS = 64
#: Candidates for a vantage point; the one from which distances differ most is taken.
TRIED = 5

_NODE = np.dtype([("vantage", "<i8"), ("near_low", "<f8"), ("near_high", "<f8"), ("far_low", "<f8"), ("far_high", "<f8"), ("near", "<i8"), ("far", "<i8"), ("start", "<i8"), ("stop", "<i8")])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, each sum taken from the first component to the last, so that equal vectors get equal distances."""
    with np.errstate(over="ignore"):
        return np.sqrt(np.cumsum((x - y) ** 2, axis=1)[:, -1])


def _vantage(x: np.ndarray) -> int:
    """A row from which the others' distances differ most, of a few evenly spread ones."""
    rows = np.unique(np.linspace(0, len(x) - 1, TRIED).astype(int))
    held = x[np.unique(np.linspace(0, len(x) - 1, 256).astype(int))]
    with np.errstate(invalid="ignore"):
        return int(max(rows.tolist(), key=lambda r: np.nan_to_num(distances(held, x[r]).std())))


def grow(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A tree over the rows of x: its nodes, and the order of rows in which each node's stand together."""
    nodes, order = [], []
    todo = [(np.arange(len(x)), -1, "near")]
    while todo:
        rows, parent, side = todo.pop()
        me = len(nodes)
        node = {"vantage": -1, "near_low": 0.0, "near_high": 0.0, "far_low": 0.0, "far_high": 0.0, "near": -1, "far": -1, "start": -1, "stop": -1}
        nodes.append(node)
        if parent >= 0:
            nodes[parent][side] = me
        if len(rows) <= LEAF_ROWS:
            node |= {"start": len(order), "stop": len(order) + len(rows)}
            order += rows.tolist()
            continue
        v = int(rows[_vantage(x[rows])])
        d = distances(x[rows], x[v])
        by = np.argsort(d, kind="stable")
        rows, d, half = rows[by], d[by], len(rows) // 2
        node |= {"vantage": v, "near_low": d[0], "near_high": d[half - 1], "far_low": d[half], "far_high": d[-1]}
        todo += [(rows[half:], me, "far"), (rows[:half], me, "near")]
    order = np.array(order, np.int64)
    place = np.argsort(order)
    for node in nodes:
        if node["vantage"] >= 0:
            node["vantage"] = int(place[node["vantage"]])
    return np.array([tuple(n[k] for k in _NODE.names) for n in nodes], _NODE), order


def _outside(d: np.ndarray, low: float, high: float) -> np.ndarray:
    """How far distances lie outside a range, less what rounding may add."""
    with np.errstate(invalid="ignore"):
        return np.nan_to_num(np.maximum(d - high, low - d) - 1e-12 * (d + high), nan=0.0)


class Search:
    """A pack of queries in one block: x in the order of the tree, ids by row."""

    def __init__(self, nodes: np.ndarray, x: np.ndarray, ids: list[list[int]], queries: np.ndarray, limits: np.ndarray, k: int, factor: float) -> None:
        self.nodes, self.x, self.q, self.factor = nodes, x, queries, factor
        self.ids = np.array([i for row in ids for i in row], np.int64)
        self.n_ids = np.array([len(row) for row in ids], np.int64)
        self.first_id = np.cumsum(self.n_ids) - self.n_ids
        with np.errstate(over="ignore"):
            self.xx, self.qq = (x**2).sum(1), (queries**2).sum(1)
        self.best = Best(len(queries), k, limits)
        self.home = np.full(len(queries), -1, np.int64)
        self._dive()
        self._pass()

    def _leaf(self, node: np.void, at: np.ndarray) -> None:
        """Hold these queries against a leaf: a matrix product with a margin tells what can count, its distances are taken one by one."""
        a, b = int(node["start"]), int(node["stop"])
        with np.errstate(over="ignore", invalid="ignore"):
            both = self.xx[None, a:b] + self.qq[at, None]
            near = both - 2 * (self.q[at] @ self.x[a:b].T)
            hit_q, hit_x = np.nonzero(~(near - 1e-14 * (self.x.shape[1] + 8) * both > (self.best.limit[at] ** 2 * (1 + 1e-14))[:, None]))
        if not len(hit_q):
            return
        d = distances(self.q[at[hit_q]], self.x[a + hit_x])
        n = self.n_ids[a + hit_x]
        pick = np.repeat(self.first_id[a + hit_x] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        self.best.add(np.repeat(at[hit_q], n), np.repeat(d, n), self.ids[pick])

    def _dive(self) -> None:
        """Each query in the leaf that the tree would put it in, for a first k-th distance."""
        todo = [(0, np.arange(len(self.q)))]
        while todo:
            k, at = todo.pop()
            node = self.nodes[k]
            if node["vantage"] < 0:
                self.home[at] = k
                self._leaf(node, at)
            elif len(at):
                inside = distances(self.q[at], self.x[node["vantage"]]) <= (node["near_high"] + node["far_low"]) / 2
                todo += [(int(node["near"]), at[inside]), (int(node["far"]), at[~inside])]

    def _pass(self) -> None:
        """All other leaves that the bounds leave, the side that is nearer to most queries first."""
        todo = [(0, np.arange(len(self.q)), np.zeros(len(self.q)))]
        while todo:
            k, at, bound = todo.pop()
            keep = ~(bound * self.factor > self.best.limit[at])
            at, bound, node = at[keep], bound[keep], self.nodes[k]
            if not len(at):
                continue
            if node["vantage"] < 0:
                at = at[self.home[at] != k]
                if len(at):
                    self._leaf(node, at)
                continue
            d = distances(self.q[at], self.x[node["vantage"]])
            near, far = _outside(d, node["near_low"], node["near_high"]), _outside(d, node["far_low"], node["far_high"])
            sides = [(int(node["far"]), at, np.maximum(bound, far)), (int(node["near"]), at, np.maximum(bound, near))]
            todo += sides if (near <= far).sum() * 2 >= len(at) else sides[::-1]


class Shards:
    """The tree that deals rows to shards."""

    def __init__(self, sample: np.ndarray, shards: int) -> None:
        self.vantage: list[np.ndarray] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []  # a node, or -1 - shard
        self.path: list[list[int]] = []  # of each shard
        todo = [(sample, shards, [], None)]
        while todo:
            x, n, path, link = todo.pop(0)
            cut = None
            if n > 1 and len(x) > 1:
                v = x[_vantage(x)]
                d = distances(x, v)
                # a share of the sample for each side by the shards it gets
                cut = np.sort(d)[min(len(d) - 2, max(0, len(d) * (n // 2) // n - 1))]
                cut = cut if (d > cut).any() and np.isfinite(cut) else None
            me = len(self.vantage) if cut is not None else -1 - len(self.path)
            if link is not None:
                self.children[link[0]][link[1]] = me
            if cut is None:
                self.path.append(path)
                continue
            self.vantage.append(v)
            self.radius.append(float(cut))
            self.children.append([0, 0])
            todo += [(x[d <= cut], n // 2, [*path, me], (me, 0)), (x[d > cut], n - n // 2, [*path, me], (me, 1))]
        self.depth = max(len(p) for p in self.path)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's shard, and its distances from the vantage points on the way."""
        shard, way = np.zeros(len(x), np.int32), np.zeros((len(x), self.depth))
        todo = [(0 if self.vantage else -1, np.arange(len(x)), 0)]
        while todo:
            k, at, level = todo.pop()
            if k < 0:
                shard[at] = -1 - k
                continue
            d = distances(x[at], self.vantage[k])
            way[at, level] = d
            inside = d <= self.radius[k]
            todo += [(self.children[k][0], at[inside], level + 1), (self.children[k][1], at[~inside], level + 1)]
        return shard, way

    def bounds(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each query and shard what no row of the shard is nearer than; low, high: by shard and level."""
        out = np.zeros((len(q), len(self.path)))
        if not self.vantage:
            return out
        v = np.array(self.vantage)
        with np.errstate(over="ignore", invalid="ignore"):
            both = (q**2).sum(1)[:, None] + (v**2).sum(1)[None, :]
            d = np.sqrt(np.maximum(0, both - 2 * (q @ v.T)))
            slack = 4 * np.sqrt(q.shape[1] * 2.3e-16 * both)
            for s, path in enumerate(self.path):
                for level, k in enumerate(path):
                    out[:, s] = np.maximum(out[:, s], np.nan_to_num(np.maximum(d[:, k] - high[s, level], low[s, level] - d[:, k]) - slack[:, k], nan=0.0))
        return out


def nearest(vectors: DataFrame, *, k: int = 10, query_every: int = 100, factor: float = FACTOR, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by `query_every`, its k nearest rows found.

    The score is the Euclidean distance of the two vectors in double precision, whatever the factor; with factor 1 the
    rows are the nearest ones. Ties go to the smaller id. Fewer than k candidates: all.

    Vectors that are null, empty or zero or hold null or non-finite components take no part, nor do rows without an id.
    Vectors of unequal length are compared as if zeros followed the shorter. Of the rows that repeat an id one stands,
    the one with the smallest vector by bytes. Equal vectors are one entry of the index with the k + 1 smallest ids, as
    an answer can hold no others. Distances beyond the range of doubles are infinite and tie. An empty table gives no
    rows; other columns aren't looked at.
    """
    rows = one_row_an_id(materialize(whole_vectors(vectors.where(F.col(id_column).isNotNull()), id_column, vector_column, no_zero=True), "near-rows"))
    whole = materialize(entries(rows, ["v"], k + 1), "near-entries")
    n, width = extent(whole)
    size = block_rows(width)
    most = max(1, SHARED_BYTES // (8 * width))
    blobs = drawn(whole, n, min(64 * most, max(1, SAMPLE_BYTES // (8 * width)))) or [bytes(8)]
    tree = Shards(matrix(blobs, width), min(most, max(1, n // size)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096)
                shard, way = tree.place(matrix(part.column(1).to_pylist(), width))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shard), pa.array(list(way), pa.list_(pa.float64()))], names=["ids", "v", "shard", "way"])

    placed = materialize(whole.select("ids", "v").mapInArrow(assign, "ids array<long>, v binary, shard int, way array<double>"), "near-placed")
    span = [f(F.col("way")[i]).alias(f"{name}{i}") for i in range(tree.depth) for name, f in (("low", F.min), ("high", F.max))]
    summary = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), *span).collect()
    low, high = (np.full((len(tree.path), tree.depth), e) for e in (np.inf, -np.inf))
    for r in summary:
        for i in range(tree.depth):
            low[r["shard"], i], high[r["shard"], i] = r[f"low{i}"], r[f"high{i}"]
    empty = np.isin(np.arange(len(tree.path)), [r["shard"] for r in summary], invert=True)
    blocks = like(vectors, [(r["shard"], -(-r["n"] // size)) for r in summary], "shard int, blocks int")

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x = matrix(table["v"].to_pylist(), width)
        nodes, order = grow(x)
        ids = table["ids"].combine_chunks().take(pa.array(order))
        whole_ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.table([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([x[order].tobytes()], pa.binary()), whole_ids, pa.array([nodes.tobytes()], pa.binary())], names=["shard", "block", "x", "ids", "nodes"])

    dealt = placed.drop("way").join(F.broadcast(blocks), "shard").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")).drop("blocks")
    index = materialize(dealt.groupBy("shard", "block").applyInArrow(build, "shard int, block int, x binary, ids array<array<long>>, nodes binary"), "near-index")

    asking = rows.where(F.pmod("vec_id", F.lit(query_every)) == 0).select(F.col("vec_id").alias("query_id"), "v")
    first = asking.select(F.array().cast("array<long>").alias("ids"), "v").dropDuplicates(["v"]).mapInArrow(assign, "ids array<long>, v binary, shard int, way array<double>")
    asked = materialize(first.select(F.monotonically_increasing_id().alias("key"), "v", "shard"), "near-asked")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, ids, nodes, queries in zip(*(b.column(c) for c in ("x", "ids", "nodes", "queries")), strict=True):
                queries = queries.as_py()
                q, limits = matrix([e["v"] for e in queries], width), np.array([e["limit"] for e in queries])
                found = Search(np.frombuffer(nodes.as_py(), _NODE), np.frombuffer(x.as_py(), "<f8").reshape(-1, width), ids.as_py(), q, limits, k + 1, factor)
                of, cost, vec = found.best.rows()
                keys = np.array([e["key"] for e in queries], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys[of]), pa.array(vec), pa.array(cost)], names=["key", "vec_id", "score"])

    def searched(wanted: DataFrame, label: str) -> DataFrame:
        """key, vec_id, score of the queries (key, v, limit, shard) in the blocks of their shards."""
        wanted = materialize(wanted, f"near-{label}-wanted")
        packs = wanted.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / PACK_QUERIES).alias("packs")).join(F.broadcast(blocks), "shard")
        of = wanted.join(F.broadcast(packs), "shard").withColumn("pack", F.pmod(F.xxhash64("key"), F.col("packs")))
        packed = of.groupBy("shard", "blocks", "pack").agg(F.collect_list(F.struct("key", "v", "limit")).alias("queries"))
        everywhere = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        with few_rows_a_batch(vectors.sparkSession, 1):
            return materialize(everywhere.join(index, ["shard", "block"]).select("x", "ids", "nodes", "queries").mapInArrow(solve, "key long, vec_id long, score double"), f"near-{label}")

    own = searched(asked.select("key", "v", F.lit(float("inf")).alias("limit"), "shard"), "own")
    order = Window.partitionBy("key").orderBy("score", "vec_id")
    reached = own.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1).where(F.col("nth") == k + 1).select("key", F.col("score").alias("limit"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                q, limit = matrix(part.column(1).to_pylist(), width), part.column(2).to_numpy(zero_copy_only=False)
                need = ~(tree.bounds(q, low, high) * factor > limit[:, None]) & ~empty
                need[np.arange(len(q)), part.column(3).to_numpy()] = False
                at, to = np.nonzero(need)
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), part.column(2).take(at), pa.array(to.astype(np.int32))], names=["key", "v", "limit", "shard"])

    bounded = asked.join(reached, "key", "left").select("key", "v", F.coalesce("limit", F.lit(float("inf"))).alias("limit"), "shard")
    others = searched(bounded.mapInArrow(route, "key long, v binary, limit double, shard int"), "others")
    # all places up to k + 1, of which one may be the query's own row
    best = own.unionByName(others).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    answers = best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("found"))
    answered = asking.join(asked.select("v", "key"), "v").join(answers, "key")
    not_own = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = answered.select("query_id", F.posexplode(not_own).alias("at", "one"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "one.vec_id", "one.score")
