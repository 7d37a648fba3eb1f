"""The streaming operators, run over the events table until all of it is used up.

Results are compared with SQL over the closed windows: the stream leaves out those that end less than the allowed delay,
one hour, before the newest event.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindings.registry import Tables, query
from bindings.sessions import ACTIONS_SQL, GAP_SQL, session_events
from muster.operators import average_states, gap_sessions, severity_counts_stream, silent_keys
from muster.session import scratch_path
from muster.sources import stream_entity_states
from muster.streaming import (
    asof_guard_stream,
    current_states,
    dedupe_events,
    explicit_sessions_stream,
    read_current,
    read_retained,
    retain_last_n_stream,
    run_available,
    run_to_table,
    state_changes_stream,
    stream_table,
    updates_to,
)

USER = ["user_id"]
ORDER = ["ts", "event_id"]
CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"
# How much later than others rows of `arriving` land, and up to when everything has come: watermarks are whole milliseconds.
LATENESS = timedelta(days=1)
SETTLED = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM events)"


def zoneless(df: DataFrame) -> DataFrame:
    times = [name for name, kind in df.dtypes if kind == "timestamp"]
    return df.withColumns({name: F.col(name).cast("timestamp_ntz") for name in times})


def events_stream(t: Tables) -> DataFrame:
    return stream_table(t.spark, t.folder, "events.parquet")


ARRIVALS = 3


def arriving(
    t: Tables, name: str, events: DataFrame | None = None, late_every: int = 0, closing: bool = False
) -> Iterator[tuple[DataFrame, str]]:
    """Events that land in `ARRIVALS` steps in order of time; yields their stream and a path after each step.

    With `late_every`, every so many of the events of the last `LATENESS` before a step land with the next step. With
    `closing`, events without a time come after all others, and one more step lands a row that is of no key and so late that
    the watermark passes every event, but not that row.
    """
    path = scratch_path(t.spark, name)
    events = t("events").select("user_id", "event_id", "ts", "event_type") if events is None else events
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    width = (last - first) / ARRIVALS + timedelta(seconds=1)
    if closing:
        kind = events.schema["ts"].dataType
        behind = F.timestamp_micros(F.lit(micros(last) + 1)).cast(kind)
        end = F.timestamp_micros(F.lit(micros(last + LATENESS + timedelta(milliseconds=2)))).cast(kind)
        events = events.withColumn("ts", F.coalesce("ts", behind))
    since = F.unix_micros(F.col("ts").cast("timestamp")) - micros(first)
    step = F.floor(since / (width / timedelta(microseconds=1)))
    if late_every:
        later = F.floor((since + LATENESS / timedelta(microseconds=1)) / (width / timedelta(microseconds=1)))
        step = F.least(F.when(F.col("event_id") % late_every == 0, later).otherwise(step), F.lit(ARRIVALS - 1))
    for number in range(ARRIVALS):
        events.filter(step == number).write.mode("append").parquet(f"{path}/landed")
        yield t.spark.readStream.schema(events.schema).parquet(f"{path}/landed"), path
    if closing:
        row = [end.alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields]
        t.spark.range(1).select(*row).write.mode("append").parquet(f"{path}/landed")
        yield t.spark.readStream.schema(events.schema).parquet(f"{path}/landed"), path


def micros(time: datetime) -> int:
    return (time.replace(tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


@query(f"SELECT * FROM ({GAP_SQL}) WHERE session_end <= {CLOSED}")
def stream_gap_sessions(t: Tables) -> DataFrame:
    for events, path in arriving(t, "gap-sessions"):
        found = run_to_table(gap_sessions(events, USER, "ts", timedelta(hours=6)), path)
    return zoneless(found)


@query(f"""
    SELECT user_id, ts AS last_ts, ts + INTERVAL 6 HOUR AS silent_from, CASE WHEN back <= {SETTLED} THEN back END AS back_ts
    FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS back FROM events)
    WHERE (back IS NULL OR back > ts + INTERVAL 6 HOUR) AND ts + INTERVAL 6 HOUR <= {SETTLED}
""")
def stream_silent_keys(t: Tables) -> DataFrame:
    """Each silence is told when it begins and, where the key has come back, once more."""
    for events, path in arriving(t, "silent-keys", late_every=7):
        told = run_to_table(silent_keys(events, USER, "ts", timedelta(hours=6), delay=LATENESS), path)
    return told.groupBy("user_id", "last_ts", "silent_from").agg(F.max("back_ts").alias("back_ts"))


@query(f"""
    SELECT window_start, event_type, count(*) AS n_lines FROM (SELECT *, date_trunc('minute', ts) AS window_start FROM events)
    WHERE window_start + INTERVAL 1 MINUTE <= {CLOSED} GROUP BY window_start, event_type
""")
def stream_severity_counts(t: Tables) -> DataFrame:
    counts = severity_counts_stream(events_stream(t), timedelta(minutes=1), level="event_type")
    return zoneless(run_to_table(counts, scratch_path(t.spark, "severity")))


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedupe(t: Tables) -> DataFrame:
    """Every event delivered twice, in several steps."""
    for events, path in arriving(t, "dedupe"):
        found = run_to_table(dedupe_events(events.unionByName(events), "event_id"), path)
    return found.select("event_id", "user_id", "event_type")


@query("""
    SELECT user_id, event_id, ts, event_type FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
""")
def stream_current_state(t: Tables) -> DataFrame:
    for events, path in arriving(t, "current", late_every=7):
        updates = current_states(events, USER, ORDER).writeStream.outputMode("update").foreachBatch(updates_to(path))
        run_available(updates, f"{path}/progress")
    return read_current(t.spark, path, USER, ORDER, events.schema)


@query("""
    SELECT event_id, user_id, event_type, previous FROM (
        SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
    WHERE previous IS DISTINCT FROM event_type
""")
def stream_state_changes(t: Tables) -> DataFrame:
    """Events that land in steps, some of them a step too late, until all are told."""
    for events, path in arriving(t, "changes", late_every=7, closing=True):
        changes = run_to_table(state_changes_stream(events, USER, ORDER, "event_type", LATENESS), path)
    return changes.select("event_id", "user_id", "event_type", "previous")


@query(f"""
    WITH actions AS (SELECT event_id, user_id, ts, {ACTIONS_SQL} AS action FROM events),
    decided AS (SELECT *, lag(CASE WHEN action IN ('new', 'attach_or_create', 'ended') THEN action END IGNORE NULLS)
        OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM actions),
    starts AS (SELECT *, action = 'new' OR (action = 'attach_or_create' AND coalesce(before, 'ended') = 'ended') AS is_start
        FROM decided),
    numbered AS (SELECT *, count(CASE WHEN is_start THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id
        ROWS UNBOUNDED PRECEDING) AS number FROM starts WHERE is_start OR coalesce(before, 'ended') <> 'ended'),
    sessions AS (SELECT user_id, number, arg_min(event_id, ts) AS started_by, min(ts) AS first_ts, max(ts) AS last_ts,
        count(*) AS n_events, max(CASE WHEN action = 'ended' THEN ts END) AS ended FROM numbered GROUP BY user_id, number),
    followed AS (SELECT *, lead(first_ts) OVER (PARTITION BY user_id ORDER BY number) AS next FROM sessions)
    SELECT user_id, started_by, first_ts, last_ts, n_events, CASE WHEN ended IS NULL THEN 'replaced' ELSE 'ended' END AS ended_by
    FROM followed WHERE coalesce(ended, next) <= {SETTLED}
""")
def stream_explicit_sessions(t: Tables) -> DataFrame:
    """Sessions that were ended or replaced."""
    for events, path in arriving(t, "explicit", session_events(t), late_every=7):
        sessions = run_to_table(explicit_sessions_stream(events, USER, ORDER, delay=LATENESS), path)
    return sessions.select("user_id", F.col("start_event_id").alias("started_by"), "first_ts", "last_ts", "n_events", "ended_by")


@query("""
    SELECT user_id, event_id, event_type FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20
""")
def stream_last_events(t: Tables) -> DataFrame:
    """The last twenty events of every user, after all updates."""
    for events, path in arriving(t, "last-events", late_every=7):
        updates = retain_last_n_stream(events, USER, ORDER, 20).writeStream.outputMode("update").foreachBatch(updates_to(path))
        run_available(updates, f"{path}/progress")
    return read_retained(t.spark, path, USER, ORDER, events.schema).select("user_id", "event_id", "event_type")


@query(f"""
    SELECT p.event_id, p.user_id, v.value AS seen_value, v.ts AS seen_ts
    FROM (SELECT * FROM events WHERE event_type = 'purchase' AND ts <= {SETTLED}) p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts
""")
def stream_asof_view(t: Tables) -> DataFrame:
    """Two streams of the same feed: purchases, and the views they look back at."""
    rows = t("events").select("user_id", "event_id", "ts", "event_type", "value")
    for events, path in arriving(t, "asof", rows, late_every=7):
        purchases = events.filter(F.col("event_type") == "purchase").drop("value")
        views = events.filter(F.col("event_type") == "view")
        found = run_to_table(asof_guard_stream(purchases, views, USER, "ts", ["value"], ["event_id"], delay=LATENESS), path)
    return found.select("event_id", "user_id", F.col("state.value").alias("seen_value"), F.col("state.ts").alias("seen_ts"))


@query(f"""
    SELECT window_start, CAST(user_id AS VARCHAR) AS installation_id, avg(CAST(round(value * 100) AS DOUBLE)) AS average,
        count(*) AS n_states FROM (SELECT *, date_trunc('day', ts) AS window_start FROM events)
    WHERE window_start + INTERVAL 1 DAY <= {CLOSED} GROUP BY window_start, user_id
""")
def stream_entity_averages(t: Tables) -> DataFrame:
    """Entity states landed as JSON lines first. Whole hundredths, so that sums do not depend on their order."""
    path = scratch_path(t.spark, "entities")
    landed = t("events").select(
        F.col("user_id").cast("string").alias("installation_id"),
        F.col("ts").cast("timestamp"),
        F.col("event_type").alias("entity_id"),
        F.round(F.col("value") * 100).cast("bigint").cast("string").alias("state"),
    )
    landed.write.json(f"{path}/landed")
    averages = average_states(stream_entity_states(t.spark, f"{path}/landed"), ["installation_id"], timedelta(days=1))
    return zoneless(run_to_table(averages, path))
