"""Product quantization in whole numbers: each part of a vector becomes the index of its nearest codebook entry.

A round's work is a matrix product in float32, |c|^2 / 2 - x.c for all parts x and entries c of a batch. Its rounding is
bounded: for parts of m components |fl(x.c) - x.c| <= g |x| |c| with g = k u / (1 - k u), u = 2^-24 and k = m + 2 (two
more for making x and c float32), whatever the order of sums. So each value stands for an interval; entries whose
interval lies wholly above the least upper end can't be the best. Where more than one is left, their distances are
worked out in int64, and ties go to the lower index. A task gives the sums and counts of its own parts by entry only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import materialize
from gleanspark.llm.vector_blocks import extent, fits, matrix, whole_vectors
from gleanspark.llm.vectors import exact, floors

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Parts held against a codebook at once, and components of the differences that are worked out again at once.
ROWS = 2048
AGAIN = 1 << 20
_UNIT = 2.0**-24
_LONG = (1 << 63) - 1
#: Sums travel as digits of so many bits, so that no number of rows makes them too large.
_DIGIT = 32


def _whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale x): int64 where squared distances fit into it, else Python's integers."""
    f = floors(x, scale)
    if x.size == 0 or np.abs(f).max() ** 2 * 4 * x.shape[1] < 2.0**62:
        return f.astype(np.int64)
    return np.array(exact(x, scale), object).reshape(x.shape)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of x the index of the nearest row of book, ties to the lower one; the squared distance; and how many rows needed int64 for the choice.

    x and book hold whole numbers: both int64, with squared distances within its range, or both Python's.
    """
    if x.dtype == object:
        near = np.ones((len(x), len(book)), bool)  # beyond int64, and maybe float32: nothing is screened
    else:
        a, c = x.astype(np.float64), book.astype(np.float64)
        half, length, of_entry = (c**2).sum(1) / 2, np.sqrt((a**2).sum(1)), np.sqrt((c**2).sum(1))
        value = half.astype(np.float32)[None, :] - a.astype(np.float32) @ c.astype(np.float32).T
        k = x.shape[1] + 6  # the product, both conversions, that of half, the difference
        margin = k * _UNIT / (1 - k * _UNIT) * 1.01 * (length[:, None] * of_entry[None, :] + half[None, :])
        near = value - margin <= (value + margin).min(1)[:, None]
    best = np.argmax(near, axis=1)
    again = np.flatnonzero(near.sum(1) > 1)
    step = max(1, AGAIN // max(1, book.size))
    for s in range(0, len(again), step):
        some = again[s : s + step]
        row, entry = np.nonzero(near[some])
        d = ((x[some[row]] - book[entry]) ** 2).sum(1)
        start = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(d, start)
        first = np.flatnonzero(d == np.repeat(least, np.diff(start, append=len(d))))  # entries ascend within a row
        best[some] = entry[first[np.unique(row[first], return_index=True)[1]]]
    return best, ((x - book[best]) ** 2).sum(1), len(again)


def _digits(n: int, many: int) -> list[int]:
    """n as `many` digits of _DIGIT bits, the last one with the sign."""
    return [(n >> (_DIGIT * i)) & ((1 << _DIGIT) - 1) if i < many - 1 else n >> (_DIGIT * i) for i in range(many)]


def codes(
    vectors: DataFrame,
    *,
    parts: int = PARTS,
    size: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> tuple[DataFrame, list[list[list[int]]]]:
    """vec_id, label, code (array of indexes by part), error (squared distance, all parts) of every row kept; and the codebooks.

    Each component x becomes floor(scale x) (scale: a power of two), and vectors are cut into equal consecutive parts. A
    part's codebook starts as that part of the `size` rows with the smallest ids (then the smaller vector by bytes;
    null ids last). In each round every part goes to its nearest entry, ties to the lower index, and entries become their
    parts' componentwise floor(sum / count); unused ones stay. Then parts are assigned once more.

    Vectors that are null or empty or hold null or non-finite components are dropped. Shorter vectors count as if zeros
    followed, up to the longest one's length or the next multiple of `parts`. Rows that repeat are coded each, null ids
    and labels too. Components may be as large as doubles are; errors beyond the range of a long become its end. An
    empty table gives no rows and empty codebooks. Other columns aren't looked at. To the driver come the codebooks and
    the sums by entry, whatever the number of rows.
    """
    rows = materialize(whole_vectors(vectors, id_column, vector_column, label_column), "code-rows")
    n, width = extent(rows)
    width = -(-width // parts) * parts
    m = width // parts
    largest = rows.select("v").mapInArrow(_largest, "x double").agg(F.max("x")).first()[0] or 0.0
    # of sums over all rows
    digits = 1 + (int(largest).bit_length() + scale.bit_length() + n.bit_length() + 1) // _DIGIT

    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(size).collect()
    start = matrix([bytes(r["v"]) for r in first], width)
    books = [np.array(exact(start[:, p * m : (p + 1) * m], scale), object).reshape(len(first), m) for p in range(parts)]

    def narrow(book: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both in int64 if distances fit, else both as Python's integers."""
        if x.dtype != object and max((abs(v) for row in book.tolist() for v in row), default=0) ** 2 * 4 * width < 1 << 62:
            return x, book.astype(np.int64)
        return x.astype(object), book

    def assigned(raw: list[bytes], now: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        x = _whole(matrix(raw, width), scale)
        for p in range(parts):
            a, c = narrow(now[p], x[:, p * m : (p + 1) * m]) if len(raw) else (x, now[p])
            best, error, _ = nearest(a, c)
            yield p, a, best, error

    sums_schema = "part int, entry int, n long, " + ", ".join(f"d{i} array<long>" for i in range(digits))

    def improved(now: list[np.ndarray]) -> list[np.ndarray]:
        """The codebooks after one round."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [np.zeros((len(now[0]), m), object) for _ in range(parts)]
            count = np.zeros((parts, len(now[0])), np.int64)
            for b in batches:
                for s in range(0, b.num_rows, ROWS):
                    for p, a, best, _ in assigned(b.column(0).slice(s, ROWS).to_pylist(), now):
                        count[p] += np.bincount(best, minlength=count.shape[1])
                        part = np.zeros(total[p].shape, a.dtype)
                        np.add.at(part, best, a)
                        total[p] += part.astype(object)
            of, entry = np.nonzero(count)
            split = [[_digits(int(v), digits) for v in total[p][e]] for p, e in zip(of.tolist(), entry.tolist(), strict=True)]
            columns = [pa.array([[d[i] for d in row] for row in split], pa.list_(pa.int64())) for i in range(digits)]
            yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[of, entry]), *columns], names=["part", "entry", "n", *(f"d{i}" for i in range(digits))])

        told = rows.select("v").mapInArrow(add, sums_schema)
        place = told.select("part", "entry", "n", *[F.col(f"d{i}")[j].alias(f"d{i}_{j}") for i in range(digits) for j in range(m)]) if m * digits <= 64 else None
        if place is not None:
            names = [c for c in place.columns if c not in ("part", "entry")]
            got = place.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names]).collect()
            sums = [(r["part"], r["entry"], r["n"], [[r[f"d{i}_{j}"] for j in range(m)] for i in range(digits)]) for r in got]
        else:
            by = told.select("part", "entry", "n", F.posexplode(F.arrays_zip(*[f"d{i}" for i in range(digits)])).alias("j", "d"))
            got = by.groupBy("part", "entry", "j").agg(F.sum("n").alias("n"), *[F.sum(f"d.d{i}").alias(f"d{i}") for i in range(digits)]).orderBy("part", "entry", "j").collect()
            sums = [(got[k]["part"], got[k]["entry"], got[k]["n"], [[r[f"d{i}"] for r in got[k : k + m]] for i in range(digits)]) for k in range(0, len(got), m)]
        after = [b.copy() for b in now]
        for p, e, count, d in sums:
            after[p][e] = [sum(d[i][j] << (_DIGIT * i) for i in range(digits)) // count for j in range(m)]
        return after

    for _ in range(rounds if first else 0):
        books = improved(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, ROWS):
                part = b.slice(s, ROWS)
                code, error = np.zeros((part.num_rows, parts), np.int32), np.zeros(part.num_rows, object)
                for p, _, best, d in assigned(part.column(2).to_pylist(), books):
                    code[:, p] = best
                    error += d.astype(object)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(code), pa.list_(pa.int32())), pa.array([min(e, _LONG) for e in error.tolist()], pa.int64())], names=["vec_id", "label", "code", "error"])

    coded = rows.select("vec_id", "label", "v").mapInArrow(encode, "vec_id long, label long, code array<int>, error long")
    return coded, [[[int(v) for v in row] for row in b.tolist()] for b in books]


def _largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The largest absolute component of each batch."""
    for b in batches:
        x = np.frombuffer(b"".join(b.column(0).to_pylist()), "<f8")
        yield pa.RecordBatch.from_arrays([pa.array([float(np.abs(x).max(initial=0))])], names=["x"])


def fingerprint(books: list[list[list[int]]]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(v) for book in books for row in book for v in row).encode()).hexdigest()


def compressed(vectors: DataFrame, **options: object) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (summed over equal labels, nulls together), codebooks_sha256; options as in codes().

    A label's sum beyond the range of a long becomes its end. Labels travel to the rows, broadcast if they are few.
    """
    coded, books = codes(vectors, **options)
    coded = materialize(coded, "code-coded")
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(_LONG).cast("decimal(20,0)")).cast("long")
    sums = materialize(coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "_label"), "code-labels")
    text = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    joined = coded.join(fits(sums), coded["label"].eqNullSafe(sums["_label"]))
    return joined.select("vec_id", text.alias("code"), "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))
