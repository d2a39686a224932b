"""Exact top-k inner products by a Voronoi join.

Vectors become whole numbers, floor(1024 x). Pivots (a bounded sample) divide them into Voronoi cells; a cell's rows
are dealt into blocks of bounded size, so a vector that a third of the rows hold fills many blocks. A cell's summary
is its size and radius. Queries are grouped by cell too. First they are solved in their own cell, which gives each
query a k-th score; as q.x <= q.p + |q| radius for all x of a cell with pivot p, only cells that can still reach this
score get a copy of the query, and are searched locally.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.llm.common import few_rows_a_batch, like, materialize, prepared

SCALE = 1024
#: Pivots: half the square root of the rows, drawn by a hash of the ids; so many at most, as all tasks hold them.
MAX_PIVOTS = 16_384
BLOCK_ROWS = 1024
PACK_QUERIES = 256
#: Doubles hold all whole numbers below it; scores that may lie beyond are worked out as Python's integers.
_EXACT = float(1 << 53)
#: Scores beyond a long's range become its ends.
_LONG = (1 << 63) - 1


def _vectors(column: pa.Array) -> list[bytes | None]:
    """Each vector as doubles, None if it takes no part."""
    out: list[bytes | None] = []
    for x in column:
        v = x.as_py()
        if v is None or not len(v) or any(c is None for c in v):
            out.append(None)
            continue
        a = np.asarray(v, np.float64)
        out.append(a.astype("<f8").tobytes() if np.isfinite(a).all() else None)
    return out


def _matrix(blobs: list[bytes], width: int) -> np.ndarray:
    """The vectors as rows of doubles; shorter ones have zeros behind."""
    if all(len(b) == 8 * width for b in blobs):
        return np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), width)
    out = np.zeros((len(blobs), width))
    for row, b in zip(out, blobs, strict=True):
        v = np.frombuffer(b, "<f8")
        row[: len(v)] = v
    return out


def floors(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale x) as doubles: exact for a power of two, but for what overflows (then infinite)."""
    with np.errstate(over="ignore"):
        return np.floor(x * scale)


def exact(x: np.ndarray, scale: int = SCALE) -> list[list[int]]:
    """floor(scale x) as Python's integers."""
    return [[int(v) * scale if abs(v) >= _EXACT else int(math.floor(v * scale)) for v in row] for row in x.tolist()]


def scores(data: np.ndarray, queries: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Exact inner products of the whole numbers, data x queries; beyond a long's range its ends."""
    x, q = floors(data, scale), floors(queries, scale)
    with np.errstate(over="ignore", invalid="ignore"):
        most = np.abs(x).max(axis=1, initial=0)[:, None] * np.abs(q).max(axis=1, initial=0)[None, :] * x.shape[1]
        out = x @ q.T
    wide = ~(most < _EXACT)
    out[wide] = 0
    out = np.rint(out).astype(np.int64)
    if wide.any():
        a, b = exact(data[wide.any(axis=1)], scale), exact(queries[wide.any(axis=0)], scale)
        rows, cols = np.cumsum(wide.any(axis=1)) - 1, np.cumsum(wide.any(axis=0)) - 1
        for i, j in np.argwhere(wide).tolist():
            score = sum(u * v for u, v in zip(a[rows[i]], b[cols[j]], strict=True))
            out[i, j] = max(-_LONG - 1, min(_LONG, score))
    return out


def _best(ids: np.ndarray, scores: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores but the query's own row, ties to smaller ids; ids ascend."""
    keep = ids != own
    ids, scores = ids[keep], scores[keep]
    if len(ids) > k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > limit)
        at = np.concatenate([above, np.flatnonzero(scores == limit)[: k - len(above)]])
        ids, scores = ids[at], scores[at]
    return ids, scores


def top_k(vectors: DataFrame, *, k: int = 10, query_every: int = 100, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by `query_every`, the k rows with the highest scores.

    Vectors that are null or empty or hold null or non-finite components take no part, nor do rows without an id.
    Vectors of unequal length are compared as if zeros followed the shorter. Rows that repeat an id each are candidates (not for a query of that id)
    and one query. Ties go to the smaller id. Fewer than k candidates: all. An empty table gives no rows. Components may be
    as large as doubles are; scores beyond the range of a long become its largest or smallest value.
    """
    spark = prepared(vectors.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = pa.array(_vectors(b.column(1)), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), v], names=["vec_id", "v"]).filter(pa.compute.is_valid(v))

    rows = materialize(
        vectors.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column)).mapInArrow(decode, "vec_id long, v binary"),
        "topk-rows",
    )
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.octet_length("v"))).first()
    width = (width or 8) // 8
    n_pivots = max(1, min(MAX_PIVOTS, int(n**0.5) // 2))
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(4 * n_pivots).collect()
    blobs = list(dict.fromkeys(bytes(r["v"]) for r in drawn))[:n_pivots] or [bytes(8)]
    pivots = floors(_matrix(blobs, width))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            half = (pivots**2).sum(1) / 2
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096)
                x = floors(_matrix(part.column(1).to_pylist(), width))
                with np.errstate(all="ignore"):
                    cell = np.nan_to_num(half - x @ pivots.T, nan=np.inf).argmin(1)
                    far = np.nan_to_num(np.sqrt(((x - pivots[cell]) ** 2).sum(1)), nan=np.inf)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(far)], names=["vec_id", "v", "cell", "far"])

    placed = materialize(rows.mapInArrow(assign, "vec_id long, v binary, cell int, far double"), "topk-cells")
    is_query = F.pmod("vec_id", F.lit(query_every)) == 0
    summary = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"), F.count(F.when(is_query, 1)).alias("queries")).collect()
    n_blocks = {r["cell"]: -(-r["n"] // BLOCK_ROWS) for r in summary}
    # a margin for the rounding of distances, far below the unit of scores
    radius = np.full(len(blobs), -1.0)
    for r in summary:
        radius[r["cell"]] = r["radius"] * (1 + 1e-9) + 1e-6
    sizes = like(vectors, [(r["cell"], n_blocks[r["cell"]], max(1, -(-r["queries"] // PACK_QUERIES))) for r in summary], "cell int, blocks int, packs int")

    of_cell = placed.join(F.broadcast(sizes), "cell")
    blocks = materialize(
        of_cell.groupBy("cell", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block")).agg(F.collect_list(F.struct("vec_id", "v")).alias("data")),
        "topk-blocks",
    )
    asked = of_cell.where(is_query).dropDuplicates(["vec_id", "v"])
    packs = asked.groupBy("cell", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("packs")).cast("int").alias("pack"), "blocks").agg(F.collect_list(F.struct("vec_id", "v")).alias("queries"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, queries in zip(b.column(0), b.column(1), strict=True):
                data, queries = data.as_py(), queries.as_py()
                ids = np.array([x["vec_id"] for x in data], np.int64)
                order = np.argsort(ids, kind="stable")
                x = _matrix([d["v"] for d in data], width)[order]
                ids = ids[order]
                found = scores(x, _matrix([q["v"] for q in queries], width))
                got = [_best(ids, found[:, j], q["vec_id"], k) for j, q in enumerate(queries)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([q["vec_id"] for q in queries], [len(g[0]) for g in got]).astype(np.int64)), pa.array(np.concatenate([g[0] for g in got])), pa.array(np.concatenate([g[1] for g in got]))],
                    names=["query_id", "vec_id", "score"],
                )

    found_schema = "query_id long, vec_id long, score long"
    near = packs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    with few_rows_a_batch(spark, 16):
        own = materialize(near.join(blocks, ["cell", "block"]).select("data", "queries").mapInArrow(solve, found_schema), "topk-own")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    reached = own.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("reached"))
    bounded = asked.join(reached, "vec_id", "left")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = floors(_matrix(b.column(1).to_pylist(), width))
            cell = b.column(2).to_numpy()
            limit = np.array([-np.inf if r is None else r for r in b.column(3).to_pylist()], np.float64)
            with np.errstate(all="ignore"):
                own, length = q @ pivots.T, np.sqrt((q**2).sum(1))[:, None]
                # as scores may be exactly alike, a cell that can just reach the k-th score is needed for ties; what overflows is needed too
                slack = 1e-12 * (np.abs(q) @ np.abs(pivots).T + length * radius) + 1
                need = ~(own + length * radius + slack < np.minimum(limit[:, None], float(_LONG))) & (radius >= 0)
            need[np.arange(len(q)), cell] = False
            at, to = np.nonzero(need)
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(to.astype(np.int32))], names=["vec_id", "v", "cell"])

    routed = bounded.select("vec_id", "v", "cell", "reached").mapInArrow(route, "vec_id long, v binary, cell int")
    total = sum(r["queries"] for r in summary)
    far_packs = routed.groupBy("cell", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(max(1, -(-total // PACK_QUERIES)))).cast("int").alias("pack")).agg(F.collect_list(F.struct("vec_id", "v")).alias("queries"))
    far = far_packs.join(F.broadcast(sizes.select("cell", "blocks")), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    with few_rows_a_batch(spark, 16):
        others = materialize(far.join(blocks, ["cell", "block"]).select("data", "queries").mapInArrow(solve, found_schema), "topk-others")
    merged = own.unionByName(others).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return merged.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
