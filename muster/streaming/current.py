"""The newest row and the last rows per key of a stream, kept in Spark's state.

Both come out as updates: after each micro-batch, what has changed. `updates_to` writes them as plain Parquet, a folder per
micro-batch that a repeated micro-batch replaces.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

from muster.operators.history import KEEP_ROWS, latest_per_key
from muster.session import share_package
from muster.sources.versions import read_if_there
from muster.streaming.buckets import BUCKET, alike, bucket_of, replace, values_of
from muster.streaming.ordered import place, plain_schema, plain_times, times_again

BatchWriter = Callable[[DataFrame, int], None]
BATCH = "_batch"
KEPT = "kept"


def columns_of(schema: T.StructType) -> str:
    return ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema.fields)


def current_states(stream: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`latest_per_key` of a stream, in update mode: after each micro-batch, the newest row of every key it has changed.

    The state is one row per key. Rows may arrive in any order.
    """
    return latest_per_key(stream, keys, order)


def updates_to(path: str) -> BatchWriter:
    """For `foreachBatch`: write the rows of a micro-batch to its own folder below `path`."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/updates/{BATCH}={number}")

    return write


def read_updates(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """All updates with the number of their micro-batch; none if nothing is written."""
    columns = schema if isinstance(schema, str) else columns_of(schema)
    return read_if_there(spark, f"{path}/updates", f"{columns}, {BATCH} BIGINT")


def read_current(
    spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], schema: str | T.StructType
) -> DataFrame:
    """The newest row per key, of written updates of `current_states`; empty if there are none."""
    return latest_per_key(read_updates(spark, path, schema).drop(BATCH), keys, order)


class LastRows(StatefulProcessor):
    """The last rows of the keys of a bucket in list state: of each key at most `n`, by their place in the order."""

    def __init__(self, row: T.StructType, keys: list[str], order: list[str], n: int) -> None:
        self.row, self.keys, self.order, self.n = row, keys, order, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.output = Row(*self.row.names, KEPT)
        self.kept = handle.getListState("kept", self.row)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        key_at, order = ([self.row.names.index(name) for name in names] for names in (self.keys, self.order))
        held: dict[tuple, dict[tuple, tuple]] = {}
        for values in self.kept.get():
            held.setdefault(alike([values[k] for k in key_at]), {})[place(values, order)] = values
        arrived: dict[tuple, dict[tuple, tuple]] = {}
        least: dict[tuple, list[tuple]] = {}
        for values in values_of(rows, self.row.names):
            known, at = alike([values[k] for k in key_at]), place(values, order)
            new, lowest = arrived.setdefault(known, {}), least.setdefault(known, [])
            if at in held.get(known, ()) or at in new or (len(new) == self.n and at < lowest[0]):
                continue
            new[at] = values
            if len(new) > self.n:
                del new[heapq.heappushpop(lowest, at)]
            else:
                heapq.heappush(lowest, at)
        changed = False
        for known, new in arrived.items():
            old = held.setdefault(known, {})
            stay = set(heapq.nlargest(self.n, [*old, *new]))
            for at in [at for at in old if at not in stay]:
                yield self.output(*old.pop(at), False)
            for at, values in new.items():
                if at in stay:
                    old[at] = values
                    changed = True
                    yield self.output(*values, True)
        if changed:
            replace(self.kept, [values for old in held.values() for values in old.values()])

    def close(self) -> None:
        pass


def retain_last_n_stream(stream: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = KEEP_ROWS) -> DataFrame:
    """`retain_last_n` of a stream, in update mode: rows that have come among the last `n` of their key (`kept`) and rows
    that have left them (not `kept`).

    `order` is unique within a key: of rows with an equal place the first to arrive counts. The state holds at most `n` rows
    per key, however long the stream, and rows may arrive in any order.
    """
    share_package(stream.sparkSession)
    schema = plain_schema(stream.schema)
    found = T.StructType([*schema.fields, T.StructField(KEPT, T.BooleanType())])
    processor = LastRows(schema, list(keys), list(order), n)
    dealt = plain_times(stream).withColumn(BUCKET, bucket_of(keys))
    updates = dealt.groupBy(BUCKET).transformWithState(processor, found, "Update", "None")
    return times_again(updates, stream.schema).select(*stream.columns, KEPT)


def read_retained(
    spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], schema: str | T.StructType
) -> DataFrame:
    """The rows that are kept by the written updates of `retain_last_n_stream`."""
    columns = schema if isinstance(schema, str) else columns_of(schema)
    updates = read_updates(spark, path, f"{columns}, {KEPT} BOOLEAN")
    return latest_per_key(updates, [*keys, *order], [BATCH]).filter(KEPT).drop(KEPT, BATCH)
