"""State kept as numbered versions, each in a folder of its own.

A version counts once Spark has marked its folder as finished. So a version that is being written is never read, a plan that
reads version n and writes version n + 1 never overwrites what it reads, and what a failed job left is replaced when the
version is written again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet table with a declared schema, empty if there is no such path."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def finished_folders(spark: SparkSession, pattern: str) -> list[str]:
    """The folders that match the pattern and hold Spark's mark of a finished write."""
    context = spark.sparkContext
    marks = context._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = marks.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(marks)
    return [status.getPath().getParent().toString() for status in found or []]


def version_of(folder: str) -> int:
    return int(folder.rsplit("version=", 1)[1])


def latest_version(spark: SparkSession, path: str) -> int | None:
    """The newest finished version, if there is one."""
    return max(map(version_of, finished_folders(spark, version_path(path, "*"))), default=None)


def version_path(path: str, version: int | str) -> str:
    return f"{path}/version={version}"


def free_version(spark: SparkSession, path: str, version: int) -> str:
    """Where a version is to be written; a finished one is an error."""
    folder = version_path(path, version)
    if finished_folders(spark, folder):
        raise FileExistsError(f"{folder} already exists")
    return folder


def write_version(df: DataFrame, path: str, version: int) -> None:
    """Write one version."""
    df.write.mode("overwrite").parquet(free_version(df.sparkSession, path, version))


def read_version(spark: SparkSession, path: str, version: int | None = None, schema: str | None = None) -> DataFrame:
    """One version, by default the newest. With a schema, a path without versions reads as an empty table."""
    number = latest_version(spark, path) if version is None else version
    if number is None:
        if schema is None:
            raise FileNotFoundError(f"no finished version below {path}")
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(version_path(path, number))


def write_package_state(state: DataFrame, path: str, version: int) -> None:
    """Write recorded packages in row form `(…, kind, package)`, partitioned by kind.

    Rows are clustered by kind inside each task only, so a kind that holds most rows is not sent to one task.
    """
    state.write.mode("overwrite").partitionBy("kind").parquet(free_version(state.sparkSession, path, version))


def read_package_versions(
    spark: SparkSession,
    path: str,
    version: int | None = None,
    columns: str = "installation_id STRING, package STRING",
) -> DataFrame:
    """Recorded packages in row form; a path without versions has none.

    `columns` declares what was written beside the kind: keys with their types, the package, a position if there is one.
    """
    return read_version(spark, path, version, f"{columns}, kind STRING")


__all__ = [
    "finished_folders",
    "latest_version",
    "read_if_there",
    "read_package_versions",
    "read_version",
    "version_path",
    "write_package_state",
    "write_version",
]
