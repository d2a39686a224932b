"""Session helpers shared by every part of the engine."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}


def local_session(name: str = "gleanspark", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and small runs; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df to the folder in spark.checkpoint.dir and read it again: what is used twice is worked out once.

    Where the setting is unset, local sessions use a folder of their own; others must set it, as executors share no other.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="gleanspark-tables-")
        folder = _LOCAL[app]
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def few_rows_a_batch(spark: SparkSession, n: int) -> Iterator[None]:
    """Inside, Arrow batches to Python hold n rows at most, so that what a worker holds doesn't grow with its task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(n, int(before)) if int(before) > 0 else n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _plain(v: object, kind: T.DataType) -> object:
    """A value as Arrow takes it: structs as dicts, maps as pairs."""
    if v is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: _plain(x, f.dataType) for f, x in zip(kind.fields, v, strict=True)}
    if isinstance(kind, T.MapType):
        return [(k, _plain(x, kind.valueType)) for k, x in v.items()]
    return [_plain(x, kind.elementType) for x in v] if isinstance(kind, T.ArrayType) else v


def literal(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table of fixed rows, made on the driver: createDataFrame of a list has Python workers copy it on the executors."""
    kind = T.StructType.fromDDL(schema)
    return spark.createDataFrame(pa.Table.from_pylist([_plain(r, kind) for r in rows], to_arrow_schema(kind)), kind)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="gleanspark-"), "gleanspark_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
