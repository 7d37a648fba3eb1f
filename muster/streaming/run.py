"""Running a stream over the data that is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter


def stream_table(spark: SparkSession, folder: str, table: str, max_files: int | None = None) -> DataFrame:
    """A stored parquet table as a stream, be it a directory or a single file in `folder`.

    `max_files` limits one micro-batch. Files come in order of their modification; only limit a batch if that is also
    the order of event time, or rows of later files may be behind the watermark.
    """
    stored = spark.read.parquet(f"{folder}/{table}")
    reader = spark.readStream.schema(stored.schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if any(path.rstrip("/").endswith(f"/{table}") for path in stored.inputFiles()):
        return reader.option("pathGlobFilter", table).parquet(folder)
    return reader.parquet(f"{folder}/{table}")


def run_available(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Run a stream over everything available, wait for its end and return the finished query."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark and were dropped, in the micro-batches whose progress Spark still has."""
    return sum(state.numRowsDroppedByWatermark for progress in query.recentProgress for state in progress.stateOperators)


def run_to_table(stream: DataFrame, path: str) -> DataFrame:
    """Append a stream's results below `path` until its input is used up, and read them.

    Called again with the same stream and path after more input has landed, it goes on from there.
    """
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows")
    run_available(writer, f"{path}/progress")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
