"""Columnar text printed by host tools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.functions.text import kb_to_mb, nth_field

# Labels of the memory table, and the field of the disk table that holds the free megabytes.
MEMORY_LABELS = {"memory_total": "MemTotal", "memory_available": "MemAvailable"}
DISK_FREE_FIELD = 4


def read_host_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as `(file, pos, line)`, one row per line, `pos` counted from 0."""
    return (
        spark.read.text(path, wholetext=True).select(
            F.col("_metadata.file_path").alias("file"),
            F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("pos", "line"),
        )
    )


def parse_meminfo(lines: DataFrame, keys: Sequence[str], line: str = "line") -> DataFrame:
    """Total and available memory in whole megabytes per key, from lines like `MemTotal:  2048 kB`."""
    size = nth_field(F.col(line), 2).try_cast("bigint")
    return lines.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col(line).contains(label), kb_to_mb(size))).alias(name)
            for name, label in MEMORY_LABELS.items()
        ]
    )


def parse_df(lines: DataFrame, keys: Sequence[str], line: str = "line", pos: str = "pos") -> DataFrame:
    """Free megabytes per key: a field of the last line of a disk table."""
    last = lines.groupBy(*keys).agg(F.max_by(line, pos).alias("_last"))
    free = nth_field(F.col("_last"), DISK_FREE_FIELD).try_cast("bigint")
    return last.select(*keys, free.alias("disk_free"))
