"""Severity-tagged log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Groups: time, level, message. The printed format is not fixed anywhere, so every reader takes its own pattern.
LINE_PATTERN = r"^\[?(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})\]?\s+(\w+):?\s+(.*)$"


def parse_log_lines(lines: DataFrame, line: str = "value", pattern: str = LINE_PATTERN) -> DataFrame:
    """Replace `line` by `ts`, `level` in lower case and `message`.

    A line that does not match keeps its text as message.
    """
    others = [name for name in lines.columns if name != line]
    text = F.col(line)
    matches = text.rlike(pattern)
    return lines.select(
        *others,
        F.when(matches, F.regexp_extract(text, pattern, 1)).try_cast("timestamp").alias("ts"),
        F.when(matches, F.lower(F.regexp_extract(text, pattern, 2))).alias("level"),
        F.when(matches, F.regexp_extract(text, pattern, 3)).otherwise(text).alias("message"),
    )


def read_log_lines(
    spark: SparkSession, path: str, stream: bool = False, pattern: str = LINE_PATTERN, keys: str = ""
) -> DataFrame:
    """Log lines below `path`; directories like `installation_id=a` become columns.

    A stream needs the directory columns up front: `keys` declares them.
    """
    if stream:
        schema = f"value STRING, {keys}" if keys else "value STRING"
        return parse_log_lines(spark.readStream.schema(schema).text(path), pattern=pattern)
    return parse_log_lines(spark.read.text(path), pattern=pattern)
