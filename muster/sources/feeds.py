"""Landed API replies and entity states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.functions.text import blank_to
from muster.schemas import API_SNAPSHOT_SCHEMA, ENTITY_STATE_SCHEMA


def read_api_snapshots(spark: SparkSession, path: str, endpoint: str | None = None) -> DataFrame:
    """Replies as `(installation_id, observed_at, endpoint, method, payload)`; a missing method is GET.

    With `endpoint`, other replies are dropped before their payload is parsed, and with `endpoint=` directories they
    are not read at all.
    """
    replies = spark.read.schema(API_SNAPSHOT_SCHEMA).json(path)
    if endpoint is not None:
        replies = replies.filter(F.col("endpoint") == endpoint)
    return replies.withColumn("method", blank_to(F.col("method"), F.lit("GET")))


def stream_entity_states(
    spark: SparkSession, path: str, schema: str = ENTITY_STATE_SCHEMA, max_files: int | None = None
) -> DataFrame:
    """State messages as they land as JSON lines below `path`; `max_files` limits one micro-batch."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)
