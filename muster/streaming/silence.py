"""Keys of a stream that fall silent, told the moment the watermark has passed, and told again when they come back."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from muster.functions.timeline import micros, span_text, whole_micros
from muster.session import share_package
from muster.streaming.buckets import BUCKET, Chunks, alike, bucket_of, replace, values_of

DELAY = timedelta(hours=1)
AT = "_at"


class Silences(StatefulProcessor):
    """Per key of a bucket its last time, and what came after it that is not yet in order.

    Two events in one slot as wide as the timeout are never apart, so of a slot only its first and last time are kept: the
    state of a key does not grow with its events. Times up to the watermark are final.
    """

    def __init__(self, keys: T.StructType, names: list[str], timeout: int) -> None:
        self.keys, self.names, self.timeout = keys, names, timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.output = handle, Row(*self.names)
        # Per key and slot: the key, the slot, its first and its last time.
        self.slots = Chunks(handle, "slots")
        held = [T.StructField(f"_key_{k}", field.dataType) for k, field in enumerate(self.keys.fields)]
        told = [T.StructField("_at", T.LongType()), T.StructField("_told", T.BooleanType())]
        self.last = handle.getListState("last", T.StructType([*held, *told]))
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        spans = {(alike(one), slot): (one, slot, first, last) for one, slot, first, last in self.slots.rows()}
        earliest = None
        for *one, at in values_of(rows, [*self.keys.names, AT]):
            earliest = at if earliest is None else min(at, earliest)
            slot = at // self.timeout
            place = alike(one), slot
            one, _, low, high = spans.get(place, (tuple(one), slot, at, at))
            spans[place] = one, slot, min(low, at), max(high, at)
        if earliest is not None:
            self.slots.put(spans.values())
            self.wake(earliest)
        return iter(())

    def wake(self, at: int) -> None:
        """Set the timer for a time in microseconds, unless it is set for an earlier one."""
        wanted, known = -(-at // 1000), self.timer.get()
        if known is None or known[0] > wanted:
            if known is not None:
                self.handle.deleteTimer(known[0])
            self.handle.registerTimer(wanted)
            self.timer.update((wanted,))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        watermark, n = timerValues.getCurrentWatermarkInMs() * 1000, len(self.keys)
        lasts = {alike(held[:n]): held for held in self.last.get()}
        spans: dict[tuple, list[tuple]] = {}
        for row in self.slots.rows():
            spans.setdefault(alike(row[0]), []).append(row)
        self.timer.clear()
        stay, waits = [], []
        for known in {**lasts, **spans}:
            *one, at, told = lasts.get(known) or (*spans[known][0][0], None, False)
            rest, wait, at, told, found = self.judged(sorted(row[1:] for row in spans.get(known, [])), at, told, watermark)
            yield from (self.output(*one, *silence) for silence in found)
            stay += [(tuple(one), *span) for span in rest]
            if at is not None:
                lasts[known] = *one, at, told
            if wait is not None:
                waits.append(wait)
        self.slots.put(stay)
        replace(self.last, list(lasts.values()))
        if waits:
            self.wake(max(min(waits), watermark + 1))

    def judged(self, spans: list[tuple], at: int | None, told: bool, watermark: int) -> tuple:
        """Of one key: the spans that stay, when to look again, its last time and whether its silence is told, silences to tell."""
        timeout, stay, found = self.timeout, [], []
        wait = None
        for number, (slot, first, last) in enumerate(spans):
            if first > watermark:
                wait = first
                stay += spans[number:]
                break
            # A first time up to the watermark is final. A last time beyond it may still grow, and is counted again then.
            if at is not None and first > at + timeout:
                if not told:
                    found.append((at, at + timeout, None))
                found.append((at, at + timeout, first))
                at = None
            reached = last if last <= watermark else first
            at, told = reached if at is None else max(at, reached), False
            if last > watermark:
                wait = last
                stay += spans[number:]
                break
            if (slot + 1) * timeout > watermark + 1:
                stay.append((slot, first, last))
        # Nothing between the last time and the watermark: silent if that is long enough, whatever comes later.
        if at is not None and not told and at + timeout <= watermark:
            found.append((at, at + timeout, None))
            told = True
        if at is not None and not told:
            wait = at + timeout if wait is None else min(wait, at + timeout)
        return stay, wait, at, told, found

    def close(self) -> None:
        pass


def silent_keys_stream(
    events: DataFrame, keys: Sequence[str], ts: str, timeout: timedelta, delay: timedelta = DELAY
) -> DataFrame:
    """Silences of a stream's keys: `last_ts`, `silent_from` = `last_ts` + timeout, and `back_ts`.

    A silence appears once the watermark, `delay` behind the newest time of all keys, has passed `silent_from`, with a NULL
    `back_ts`; and again when the key has come back, with the time of that. An event exactly at `silent_from` keeps the key
    from being silent. Rows without a time do not count. A key stays in the state until it comes back.
    """
    share_package(events.sparkSession)
    at = micros(F.col(ts))
    rows = events.filter(F.col(ts).isNotNull()).select(*keys, at.alias(AT))
    rows = rows.withColumns({"_ts": F.timestamp_micros(AT), BUCKET: bucket_of(keys)})
    found = T.StructType(
        [*[events.schema[key] for key in keys], *[T.StructField(name, T.LongType()) for name in ("last_ts", "silent_from", "back_ts")]]
    )
    processor = Silences(T.StructType([events.schema[key] for key in keys]), found.names, whole_micros(timeout))
    silences = rows.withWatermark("_ts", span_text(delay)).groupBy(BUCKET).transformWithState(processor, found, "Append", "EventTime")
    kind = events.schema[ts].dataType
    return silences.withColumns({name: F.timestamp_micros(name).cast(kind) for name in ("last_ts", "silent_from", "back_ts")})
