"""What the searches over vectors share: decoding, one row an id, equal vectors as one entry, bounded samples, best lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanspark.llm.common import BROADCAST_IDS, materialize, prepared

#: A block holds about so many bytes of vectors, within these numbers of rows; a pack so many queries.
BLOCK_BYTES = 4 << 20
LEAST_ROWS, MOST_ROWS = 64, 8192
PACK_QUERIES = 256
#: What is drawn to the driver, and what it hands to all tasks, in bytes of vectors.
SAMPLE_BYTES = 32 << 20
SHARED_BYTES = 8 << 20


def _decoded(column: pa.Array, no_zero: bool) -> pa.Array:
    """Each vector as little-endian doubles; null if it takes no part."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    flat = column.flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False).astype("<f8") + 0.0  # nulls become NaN, and -0.0 becomes 0.0
    starts = np.cumsum(lengths) - lengths
    out = np.full(len(column), None, object)
    for width in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == width)
        x = values[starts[at][:, None] + np.arange(width)]
        fit = np.isfinite(x).all(1)
        if no_zero:
            fit &= (x != 0).any(1)
        raw = x.tobytes()
        for k in np.flatnonzero(fit).tolist():
            out[at[k]] = raw[8 * width * k : 8 * width * (k + 1)]
    return pa.array(out, pa.binary())


def whole_vectors(df: DataFrame, id_column: str, vector_column: str, label_column: str | None = None, *, no_zero: bool = False) -> DataFrame:
    """vec_id, label (null without a column of labels), v: rows whose vectors are given, not empty, without null or non-finite components."""
    prepared(df.sparkSession)
    label = F.col(label_column).cast("long") if label_column else F.lit(None).cast("long")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _decoded(b.column(2), no_zero)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), v], names=["vec_id", "label", "v"]).filter(pc.is_valid(v))

    return df.select(F.col(id_column).cast("long").alias("vec_id"), label.alias("label"), F.col(vector_column).alias("v")).mapInArrow(decode, "vec_id long, label long, v binary")


def one_row_an_id(rows: DataFrame) -> DataFrame:
    """Of the rows that repeat an id the one with the smallest vector (by bytes, then label); others as they are."""
    again = materialize(rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id"), "vector-twice")
    if again.isEmpty():
        return rows
    one = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("x"))
    return rows.join(again, "vec_id", "left_anti").unionByName(one.select("vec_id", "x.label", "x.v"))


def entries(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys, ids: the rows with equal keys as one entry, with their k smallest ids, ascending: no answer of k rows can hold others.

    Ranks are limited within each task before the shuffle, so a vector that a third of all rows hold costs k rows a task.
    """
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= k).groupBy(*keys).agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def extent(table: DataFrame) -> tuple[int, int]:
    """The number of rows, and of components of the longest vector."""
    n, width = table.agg(F.count(F.lit(1)), F.max(F.octet_length("v"))).first()
    return n, max(1, (width or 0) // 8)


def block_rows(width: int) -> int:
    return min(MOST_ROWS, max(LEAST_ROWS, BLOCK_BYTES // (8 * width)))


def drawn(table: DataFrame, n: int, want: int) -> list[bytes]:
    """About `want` different vectors of a table with n rows, drawn by a hash; a bounded number comes to the driver."""
    part = F.pmod(F.xxhash64("v", F.lit(17)), F.lit(1 << 40)) < int((1 << 40) * min(1.0, want / max(1, n)))
    return [bytes(r["v"]) for r in table.where(part).select("v").distinct().orderBy(F.xxhash64("v"), "v").collect()]


def matrix(blobs: list[bytes], width: int) -> np.ndarray:
    """The vectors as rows of doubles; shorter ones have zeros behind."""
    if all(len(b) == 8 * width for b in blobs):
        return np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), width)
    out = np.zeros((len(blobs), width))
    for row, b in zip(out, blobs, strict=True):
        v = np.frombuffer(b, "<f8")
        row[: len(v)] = v
    return out


class Best:
    """For each of n slots its k entries of the least cost, ties by smaller id."""

    def __init__(self, n: int, k: int, limit: np.ndarray) -> None:
        self.k, self.limit = k, limit.copy()  # what costs more than its slot's limit can't be among the k
        self.costs: list[np.ndarray] = [limit[:0]] * n
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * n

    def add(self, slots: np.ndarray, costs: np.ndarray, ids: np.ndarray) -> None:
        if not len(slots):
            return
        order = np.argsort(slots, kind="stable")
        slots, costs, ids = slots[order], costs[order], ids[order]
        names, first = np.unique(slots, return_index=True)
        for s, a, b in zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(slots)], strict=True):
            c, i = np.concatenate([self.costs[s], costs[a:b]]), np.concatenate([self.ids[s], ids[a:b]])
            at = np.lexsort((i, c))[: self.k]
            self.costs[s], self.ids[s] = c[at], i[at]
            if len(at) == self.k:
                self.limit[s] = min(self.limit[s], c[at[-1]])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """slot, cost, id of all that is kept."""
        of = np.repeat(np.arange(len(self.ids)), [len(x) for x in self.ids])
        none = np.zeros(0, np.int64)
        return of, np.concatenate([self.limit[:0], *self.costs]), np.concatenate([none, *self.ids])


def fits(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df
