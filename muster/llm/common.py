"""Helpers of this subpackage: intermediate tables, Arrow batches, small results."""

from __future__ import annotations

import os
import pathlib
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

import muster
from muster.session import scratch_path

WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def saved(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """The rows written below `spark.checkpoint.dir` and read back, so that no lost executor takes them along.

    Later steps see one fixed version of the rows, and read them without repeating what made them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared(df: DataFrame, value: object) -> Broadcast:
    """A value of bounded size sent to every task."""
    return df.sparkSession.sparkContext.broadcast(value)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a column; NULL is empty."""
    return [value.as_buffer().to_pybytes() if value.is_valid else b"" for value in column]


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in batches of at most `limit` bytes of a text column, or of one row that is longer."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start] - lengths[start]
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


# Applications that have this package.
SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give tasks this package, unless they find it where the driver does: Spark hands its archive to every executor."""
    root, context = pathlib.Path(muster.__file__).resolve().parents[1], spark.sparkContext
    known = str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if known or context.applicationId in SHIPPED or not root.is_dir():
        return
    archive = pathlib.Path(tempfile.mkdtemp(prefix="muster-")) / "muster.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((root / "muster").rglob("*.py")):
            out.write(path, path.relative_to(root))
    context.addPyFile(str(archive))
    SHIPPED.add(context.applicationId)


def map_arrow(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str | T.StructType) -> DataFrame:
    """`mapInArrow` for a function that yields dictionaries of columns. Column names may hold dots."""
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    ship(df.sparkSession)
    names, given = fields.names, df.columns
    if any("." in name for name in given):
        df = df.toDF(*[f"_{number}" for number in range(len(given))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in rows(pa.RecordBatch.from_arrays(batch.columns, given) for batch in batches):
            yield pa.RecordBatch.from_arrays([as_arrow(columns[name], fields[name].dataType) for name in names], names)

    return df.mapInArrow(run, fields)


def as_arrow(values: object, kind: T.DataType) -> pa.Array:
    from pyspark.sql.pandas.types import to_arrow_type

    if isinstance(values, pa.Array):
        return values
    target = to_arrow_type(kind)
    if isinstance(values, np.ndarray):
        return pa.array(values).cast(target)
    return pa.array(values, type=target)


def fresh(name: str, columns: list[str]) -> str:
    """A column name like `name` that is not among `columns`, whatever their case."""
    taken = {column.lower() for column in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(schema: T.StructType, names: list[str]) -> list[str]:
    """Column names of a schema except some."""
    return [field.name for field in schema.fields if field.name not in names]
