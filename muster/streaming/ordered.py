"""Rows of a stream in the order of their times, with a small memory per key.

Rows wait in Spark's list state until the watermark has passed them, so rows that arrive out of order by less than the
delay are put in order. A timer per bucket of keys then hands them, in order, to a step that knows what the key remembers
and says what comes out. Rows behind the watermark are dropped and counted by Spark; `late_rows` tells how many.

State changes, explicit sessions and states as of an event are such steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import timedelta
from itertools import batched

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from muster.functions.timeline import micros, span_text, whole_micros
from muster.schemas import ENDED, JOINING, REPLACING
from muster.session import share_package
from muster.streaming.buckets import BUCKET, CHUNK, Chunks, alike, bucket_of, replace, values_of

DELAY = timedelta(hours=1)
SESSION_KEYS = ("installation_id", "session_name")
TIMES = (T.TimestampType, T.TimestampNTZType)
AT = "_at"

Memory = tuple | None
# What a key remembers and a row of the stream; what it remembers then, and rows that come out.
Step = Callable[[Memory, Row], tuple[Memory, list[tuple]]]
# What a key remembered for too long without a further row; rows that come out.
Forget = Callable[[tuple], list[tuple]]


def plain_times(df: DataFrame) -> DataFrame:
    """Times as microseconds, so that the time zone of Python does not matter."""
    return df.withColumns({f.name: micros(F.col(f"`{f.name}`")) for f in df.schema.fields if isinstance(f.dataType, TIMES)})


def plain_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.LongType() if isinstance(f.dataType, TIMES) else f.dataType) for f in schema.fields])


def times_again(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns that are times in `schema` as times again."""
    return df.withColumns({f.name: F.timestamp_micros(f.name).cast(f.dataType) for f in schema.fields if isinstance(f.dataType, TIMES)})


def place(row: Sequence, order: Sequence[str | int]) -> tuple:
    """Sorts like Spark: NULL first."""
    return tuple((row[name] is not None, row[name]) for name in order)


class InOrder(StatefulProcessor):
    """Waiting rows and the memories of the keys of a bucket; see `in_order`."""

    def __init__(self, row: T.StructType, keys: list[str], memory: T.StructType, names: list[str], order: list[str], step: Step, forget: Forget, keep: int | None):
        self.row, self.keys, self.remembered, self.names, self.order = row, keys, memory, names, order
        self.step, self.forget, self.keep = step, forget, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.made, self.output = Row(*self.row.names), Row(*self.names)
        self.waiting = Chunks(handle, "waiting")
        # Per key that remembers something: the key, the time of its last row in microseconds, and its memory.
        held = [T.StructField(f"_key_{k}", self.row[key].dataType) for k, key in enumerate(self.keys)]
        held += [T.StructField("_last", T.LongType())]
        held += [T.StructField(f"_memory_{k}", field.dataType) for k, field in enumerate(self.remembered.fields)]
        self.memory = handle.getListState("memory", T.StructType(held))
        # The timer that is set, in milliseconds.
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        at, earliest = self.row.names.index(AT), None
        for some in batched(values_of(rows, self.row.names), CHUNK):
            self.waiting.append(some)
            first = min(row[at] for row in some)
            earliest = first if earliest is None else min(first, earliest)
        if earliest is not None:
            due, timer = -(-earliest // 1000), self.timer.get()
            if timer is None or due < timer[0]:
                if timer is not None:
                    self.handle.deleteTimer(timer[0])
                self.handle.registerTimer(due)
                self.timer.update((due,))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        watermark, keep, n = timerValues.getCurrentWatermarkInMs() * 1000, self.keep, len(self.keys)
        at, key_at = self.row.names.index(AT), [self.row.names.index(name) for name in self.keys]
        ready, rest = [], []
        for values in self.waiting.rows():
            (ready if values[at] <= watermark else rest).append(values)
        order = [self.row.names.index(name) for name in self.order]
        ready.sort(key=lambda values: place(values, order))
        memories = {alike(held[:n]): (held[:n], held[n], held[n + 1 :]) for held in self.memory.get()}
        changed = bool(ready)
        for values in ready:
            one = tuple([values[k] for k in key_at])
            known = alike(one)
            _, last, memory = memories.get(known, (one, None, None))
            if memory is not None and keep is not None and values[at] > last + keep:
                yield from self.rows(one, self.forget(memory))
                memory = None
            memory, found = self.step(memory, self.made(*values))
            if memory is None:
                memories.pop(known, None)
            else:
                memories[known] = one, values[at], memory
            yield from self.rows(one, found)
        if keep is not None:
            for known, (one, last, memory) in list(memories.items()):
                if last + keep < watermark:
                    yield from self.rows(one, self.forget(memory))
                    del memories[known]
                    changed = True
        if changed:
            replace(self.memory, [(*one, last, *memory) for one, last, memory in memories.values()])
        if ready:
            self.waiting.put(rest)
        times = [-(-min(values[at] for values in rest) // 1000)] if rest else []
        if memories and keep is not None:
            times.append((min(last for _, last, _ in memories.values()) + keep) // 1000 + 1)
        if times:
            self.handle.registerTimer(min(times))
            self.timer.update((min(times),))
        else:
            self.timer.clear()

    def rows(self, key: tuple, found: list[tuple]) -> Iterator[Row]:
        return (self.output(*key, *values) for values in found)

    def close(self) -> None:
        pass


def in_order(
    stream: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    memory: str,
    output: str,
    step: Step,
    delay: timedelta = DELAY,
    forget: Forget = lambda memory: [],
    keep: timedelta | None = None,
) -> DataFrame:
    """The keys and what `step` gives for each row of a key, in the order of `order`, which begins with the event time.

    Times are whole microseconds for `step`, in what it remembers and in what it gives. `memory` and `output` are schemas.
    A key that has no row for longer than `keep` loses its memory, after `forget` has seen it. Rows without a time are left
    out. The rows of a bucket of keys are put in order by one task.
    """
    share_package(stream.sparkSession)
    ts, *ties = order
    given = stream.filter(F.col(ts).isNotNull())
    schema = T.StructType([*plain_schema(given.schema).fields, T.StructField(AT, T.LongType())])
    timed = plain_times(given).withColumns({AT: F.col(ts), "_ts": F.timestamp_micros(ts), BUCKET: bucket_of(keys)})
    found = T.StructType([*[schema[key] for key in keys], *T.StructType.fromDDL(output).fields])
    processor = InOrder(
        schema, list(keys), T.StructType.fromDDL(memory), found.names, [AT, *ties], step, forget, None if keep is None else whole_micros(keep)
    )
    rows = timed.withWatermark("_ts", span_text(delay)).groupBy(BUCKET)
    return rows.transformWithState(processor, found, "Append", "EventTime")


def ddl(fields: Sequence[T.StructField]) -> str:
    return ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in fields)


def state_changes_stream(
    states: DataFrame, keys: Sequence[str], order: Sequence[str], state: str = "state", delay: timedelta = DELAY
) -> DataFrame:
    """`state_changes` of a stream: rows whose state differs from the one before, and the first of each key.

    A row appears once the watermark, `delay` behind the newest time, has passed it.
    """
    schema = plain_schema(states.schema)
    rest = [field for field in schema.fields if field.name not in keys]
    names, kind = [field.name for field in rest], schema[state].dataType.simpleString()

    def step(memory: Memory, row: Row) -> tuple[Memory, list[tuple]]:
        if memory is not None and memory[0] == row[state]:
            return memory, []
        return (row[state],), [(*[row[name] for name in names], memory and memory[0])]

    output = f"{ddl(rest)}, previous {kind}"
    found = in_order(states, keys, order, f"state {kind}", output, step, delay)
    both = T.StructType([*states.schema.fields, T.StructField("previous", states.schema[state].dataType)])
    return times_again(found, both).select(*states.columns, "previous")


def explicit_sessions_stream(
    events: DataFrame,
    keys: Sequence[str] = SESSION_KEYS,
    order: Sequence[str] = ("ts", "event_id"),
    action: str = "action",
    delay: timedelta = DELAY,
    keep: timedelta | None = None,
) -> DataFrame:
    """Sessions of a stream that are over: the ordering columns of their start, first and last time, `n_events`, `ended_by`.

    A key is live or not. A replacing action ends the live session (`replaced`) and starts the next, a joining one starts a
    session if none is live, an ending one ends it and still belongs to it (`ended`). All other actions of a live key belong
    to its session. A session without an event for longer than `keep` is over too (`expired`).
    """
    schema = plain_schema(events.schema)
    start = [schema[name] for name in order]
    n = len(start)

    def opened(row: Row) -> tuple:
        return (*[row[name] for name in order], row[AT], row[AT], 1)

    def step(memory: Memory, row: Row) -> tuple[Memory, list[tuple]]:
        what = row[action]
        if what in REPLACING:
            return opened(row), [] if memory is None else [(*memory, "replaced")]
        if memory is None:
            return (opened(row) if what == JOINING else None), []
        longer = (*memory[: n + 1], row[AT], memory[-1] + 1)
        return (None, [(*longer, "ended")]) if what == ENDED else (longer, [])

    def forget(memory: tuple) -> list[tuple]:
        return [(*memory, "expired")]

    remembered = ", ".join([f"_{k} {field.dataType.simpleString()}" for k, field in enumerate(start)] + ["_first long, _last long, _n long"])
    # Ordering columns are named apart from the session's own times.
    started = ", ".join(f"`start_{field.name}` {field.dataType.simpleString()}" for field in start)
    output = f"{started}, first_ts long, last_ts long, n_events long, ended_by string"
    found = in_order(events, keys, order, remembered, output, step, delay, forget, keep)
    kinds = {f"start_{name}": events.schema[name].dataType for name in order} | dict.fromkeys(("first_ts", "last_ts"), events.schema[order[0]].dataType)
    return times_again(found, T.StructType([T.StructField(name, kind) for name, kind in kinds.items()]))


def asof_guard_stream(
    events: DataFrame,
    states: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: Sequence[str],
    tie: Sequence[str] = (),
    max_age: timedelta | None = None,
    delay: timedelta = DELAY,
    name: str = "state",
) -> DataFrame:
    """`asof_guard` of two streams: each event with the newest state at or before it, NULL if none.

    Both streams share a watermark, which follows the newest time of both together, and a key remembers its newest state
    only: a join of the streams by a range of time would make every pair within that range first. An event appears once
    the watermark has passed it. With `max_age`, a key without rows for so long forgets its state.
    """
    values = [f"_seen_{k}" for k in range(len(value))]
    seen = states.select(*keys, ts, *tie, *[F.col(one).alias(to) for one, to in zip(value, values)], F.lit(0).alias("_side"))
    both = events.withColumn("_side", F.lit(1)).unionByName(seen, allowMissingColumns=True)
    schema = plain_schema(both.schema)
    held = T.StructType([schema[one] for one in values] + [T.StructField("_seen_at", T.LongType())])
    rest = [schema[one] for one in events.columns if one not in keys]
    limit = None if max_age is None else whole_micros(max_age)

    def step(memory: Memory, row: Row) -> tuple[Memory, list[tuple]]:
        if row["_side"] == 0:
            return (*[row[one] for one in values], row[AT]), []
        known = memory is not None and (limit is None or row[AT] - memory[-1] <= limit)
        return memory, [(*[row[field.name] for field in rest], *(memory if known else [None] * len(held)))]

    output = f"{ddl(rest)}, {ddl(held.fields)}"
    found = in_order(both, keys, [ts, "_side", *tie], ddl(held.fields), output, step, delay, keep=max_age)
    kinds = {field.name: field.dataType for field in both.schema.fields if field.name in found.columns}
    found = times_again(found, T.StructType([T.StructField(one, kind) for one, kind in kinds.items()]))
    at = F.timestamp_micros("_seen_at").cast(events.schema[ts].dataType)
    state = F.struct(*[F.col(to).alias(one) for one, to in zip(value, values)], at.alias(ts))
    return found.select(*events.columns, F.when(F.col("_seen_at").isNotNull(), state).alias(name))
