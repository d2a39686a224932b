"""What the operators of this folder share: intermediate tables, exact ranks over any number of rows, column care."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanspark.session import ship_package

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see; where it is unset, local sessions get one of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="gleanspark-work-")
    return _OWN[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: later steps start there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def few_rows_a_batch(spark: SparkSession, n: int) -> Iterator[None]:
    """Inside, Arrow batches to Python hold n rows at most: for rows that each hold many."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def released() -> None:
    """Give what a task's batches and objects took back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def prepared(spark: SparkSession) -> SparkSession:
    ship_package(spark)
    return spark


def like(df: DataFrame, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def chunk_count(n: int) -> int:
    """About the square root of n, so that a chunk and the table of chunks are both small."""
    return max(1, int(n**0.5))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, n: int, weight: str | None = None, spread: Sequence[str] | None = None) -> DataFrame:
    """Add `out`: the row's place from 0 among the rows of its keys, or the sum of `weight` over the rows before it.

    The order is by a hash chunk of the `spread` columns (those of `order` unless given) and then by `order`; it is total and repeatable if they are
    unique. Two levels of prefix sums (inside chunks of about sqrt(n) rows, then over the chunks) keep a key with any
    share of the rows from meeting in one task.
    """
    chunk, before, size_, local_, key_chunk = (f"_{out}_{x}" for x in ("chunk", "before", "size", "local", "key_chunk"))
    keys, order = list(keys), list(order)
    cut = df.withColumn(chunk, F.pmod(F.xxhash64(*(spread or order)), F.lit(chunk_count(n))).cast("int"))
    size = F.sum(F.col(weight).cast("long")) if weight else F.count(F.lit(1))
    per = cut.groupBy(*keys, chunk).agg(size.alias(size_))
    upto = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    # a null key is a key: joined by equality that knows nulls
    per = per.select(*[F.col(k).alias(f"_{out}_key_{k}") for k in keys], F.col(chunk).alias(key_chunk), F.coalesce(F.sum(size_).over(upto), F.lit(0)).alias(before))
    inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    if weight:
        local = F.coalesce(F.sum(F.col(weight).cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    else:
        local = F.row_number().over(inside) - 1
    cut = cut.withColumn(local_, local)
    on = [cut[k].eqNullSafe(per[f"_{out}_key_{k}"]) for k in keys] + [cut[chunk] == per[key_chunk]]
    joined = cut.join(per, on, "inner")
    return joined.withColumn(out, (F.col(before) + F.col(local_)).cast("long")).drop(chunk, before, local_, key_chunk, *[f"_{out}_key_{k}" for k in keys])


def range_ranked(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Add `out`: the row's place from 0 in the order of these columns, which is total if they are unique.

    Rows are dealt by ranges of the order and counted; counts of the ranges before, and the place within the range,
    give the place among all.
    """
    part, before = f"_{out}_part", f"_{out}_before"
    dealt = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()), "ranges")
    per = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    per = per.select(F.col(part), (F.sum("_n").over(Window.orderBy(part)) - F.col("_n")).alias(before))  # one row a range
    nth = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return dealt.withColumn("_nth", nth).join(F.broadcast(per), part).withColumn(out, (F.col(before) + F.col("_nth")).cast("long")).drop(part, before, "_nth")


def file_order(df: DataFrame, out: str) -> DataFrame:
    """Add `out`: where a row of a table read from Parquet stands, by the number in its file's name and its place in the file."""
    part = F.expr("coalesce(try_cast(regexp_extract(_metadata.file_name, 'part-([0-9]+)', 1) AS bigint), 0)")
    return df.withColumn(out, part * F.lit(1 << 36) + F.col("_metadata.row_index"))


def parcels(column: pa.Array, chars: int = 1_000_000) -> Iterator[list[str]]:
    """The column's texts in lists of about so many characters at most (one text at least)."""
    part, size = [], 0
    for x in column:
        t = x.as_py() or ""
        if part and size + len(t) > chars:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Ids up to this many may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The rows of docs whose id isn't among `ids` (one column). Rows without an id stay."""
    gone = materialize(ids.toDF("_gone").where("_gone is not null").distinct(), "ids")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs[id_column].cast("long") == F.col("_gone"), "left_anti")
