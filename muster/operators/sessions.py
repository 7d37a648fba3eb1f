"""Terminal sessions: launch mode, menu answers, explicit sessions and sessions by gap.

`slices` says how the rows of a key are divided among tasks; see `muster.plans.slots`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.functions.text import blank_to, strip_all_space
from muster.functions.timeline import micros, slot_of, span_text, whole_micros
from muster.plans.slots import AUTO, SLOT, Slices, fill_forward
from muster.plans.hot import lookup
from muster.plans.small import join_rules
from muster.schemas import ENDED, JOINING, MENU_CODES, MENU_CODES_SCHEMA, REPLACING

SESSION_KEYS = ("installation_id", "session_name")
DELAY = timedelta(hours=1)


# Launch mode and menu answers


def resolve_launch_mode(options: DataFrame, has_picker: Column, option: str = "auto_launch") -> DataFrame:
    """Add `launch_mode`: `auto`, `picker`, or `auto_fallback` where the picker is wanted but not installed."""
    automatic = F.coalesce(F.col(option).cast("string"), F.lit("true")) == "true"
    mode = F.when(automatic, "auto").when(F.coalesce(has_picker, F.lit(False)), "picker").otherwise("auto_fallback")
    return options.withColumn("launch_mode", mode)


def default_answer(has_session: Column) -> Column:
    """The answer a blank input stands for: reconnect to a live session, else a new one."""
    return F.when(has_session, "0").otherwise("1")


def normalize_answer(answer: Column, default: Column) -> Column:
    """The answer without any whitespace, also inside; a blank one is the default."""
    return blank_to(strip_all_space(answer), default)


def validate_domain(df: DataFrame, col: str, allowed: Sequence[str]) -> DataFrame:
    """Add `valid`; rejected rows stay, with a `reason`."""
    valid = F.coalesce(F.col(col).isin(*allowed), F.lit(False))
    return df.withColumn("valid", valid).withColumn("reason", F.when(~valid, "invalid choice"))


def resolve_code(
    df: DataFrame, col: str = "answer", codes: DataFrame | Sequence[tuple] = MENU_CODES
) -> DataFrame:
    """Add the `action` a code stands for, NULL for an unknown code."""
    return join_rules(df, codes, MENU_CODES_SCHEMA, {"answer": col}, col)


def resolve_answers(df: DataFrame, answer: str = "answer", has_session: str = "has_session") -> DataFrame:
    """Answers from input to action: normalised, checked and looked up; reconnecting needs a live session."""
    live = F.coalesce(F.col(has_session), F.lit(False))
    chosen = df.withColumn(answer, normalize_answer(F.col(answer), default_answer(live)))
    checked = validate_domain(chosen, answer, [code for code, _ in MENU_CODES])
    missing = F.col("valid") & (F.col(answer) == "0") & ~live
    reason = F.when(missing, "no existing session").otherwise(F.col("reason"))
    checked = checked.withColumns({"valid": F.col("valid") & ~missing, "reason": reason})
    action = F.when(F.col("valid"), F.col("action"))
    return resolve_code(checked, answer).withColumn("action", action)


# Live sessions


def effective(action: Column) -> Column:
    """The action if it decides whether a session is live, else NULL."""
    return F.when(action.isin(*REPLACING, JOINING, ENDED), action)


def live_sessions(
    events: DataFrame,
    keys: Sequence[str] = SESSION_KEYS,
    order: Sequence[str] = ("ts", "event_id"),
    action: str = "action",
) -> DataFrame:
    """Keys whose newest deciding action leaves a session, merged before the shuffle."""
    deciding = events.withColumn(action, effective(F.col(action))).filter(F.col(action).isNotNull())
    newest = deciding.groupBy(*keys).agg(F.max_by(action, F.struct(*order)).alias("_newest"))
    return newest.filter(F.col("_newest") != ENDED).select(*keys)


def has_live_session(requests: DataFrame, sessions: DataFrame, keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    """Requests with `has_session`, given the live sessions."""
    marked = sessions.select(*keys).dropDuplicates().withColumn("_live", F.lit(True))
    return (
        lookup(requests, marked, keys)
        .withColumn("has_session", F.col("_live").isNotNull())
        .drop("_live")
    )


# Explicit sessions


def session_starts(
    events: DataFrame,
    keys: Sequence[str] = SESSION_KEYS,
    order: Sequence[str] = ("ts", "event_id"),
    action: str = "action",
    slices: Slices = AUTO,
) -> DataFrame:
    """Add `is_start`: the event replaces a session, or joins when none is live."""
    before = fill_forward(events, keys, order, effective(F.col(action)), "_before", inclusive=False, slices=slices)
    free = F.col("_before").isNull() | (F.col("_before") == ENDED)
    is_start = F.col(action).isin(*REPLACING) | ((F.col(action) == JOINING) & free)
    return before.withColumn("is_start", F.coalesce(is_start, F.lit(False))).drop("_before")


def explicit_sessions(
    events: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    is_start: Column,
    is_end: Column | None = None,
    slices: Slices = AUTO,
    name: str = "session_start",
) -> DataFrame:
    """Add `name`: the ordering columns of the event that started the event's session, NULL outside a session.

    The start identifies the session within its key. An event marked by `is_end` still belongs to the session it ends.
    """
    position = F.struct(*order)
    if is_end is None:
        return fill_forward(events, keys, order, F.when(is_start, position), name, slices=slices)
    starts = F.struct(F.when(is_start, position).alias("start"))
    marker = F.when(is_start | is_end, starts)
    held = fill_forward(events, keys, order, marker, "_held", inclusive=False, slices=slices)
    own = F.when(is_start, position).otherwise(F.col("_held.start"))
    return held.withColumn(name, own).drop("_held")


def summarize_sessions(
    events: DataFrame, keys: Sequence[str], ts: str = "ts", name: str = "session_start"
) -> DataFrame:
    """One row per session with its first and last time and number of events; events outside sessions are left out."""
    return (
        events.filter(F.col(name).isNotNull())
        .groupBy(*keys, name)
        .agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n_events"))
    )


# Sessions by gap


def activity(events: DataFrame, keys: Sequence[str], ts: str, gap: timedelta, totals: Mapping[str, str]) -> DataFrame:
    """First and last time, event count and sums per key and slot as wide as the gap.

    Two events in one slot are less than a gap apart, so a slot never spans two sessions and the events themselves need
    neither sorting nor a task of their own per key.
    """
    return (
        events.filter(F.col(ts).isNotNull())
        .groupBy(*keys, slot_of(F.col(ts), gap).alias(SLOT))
        .agg(
            F.min(ts).alias("first_ts"),
            F.max(ts).alias("last_ts"),
            F.count("*").alias("n_events"),
            *[F.sum(column).alias(name) for name, column in totals.items()],
        )
    )


def gap_sessions(
    events: DataFrame,
    keys: Sequence[str],
    ts: str,
    gap: timedelta,
    totals: Mapping[str, str] | None = None,
    delay: timedelta = DELAY,
) -> DataFrame:
    """Sessions that end when a key has had no event for longer than `gap`.

    One row per session: first and last event time, `session_end` (last event plus gap), `n_events`, and the sum of a
    column per entry of `totals`. On a stream, a session appears once the watermark, `delay` behind the newest event,
    has passed its end.
    """
    totals = totals or {}
    if events.isStreaming:
        session = F.session_window("_ts", span_text(gap))
        return (
            events.withColumn("_ts", F.col(ts).cast("timestamp"))
            .withWatermark("_ts", span_text(delay))
            .groupBy(*keys, session.alias("_session"))
            .agg(
                F.min("_ts").alias("first_ts"),
                F.max("_ts").alias("last_ts"),
                F.count("*").alias("n_events"),
                *[F.sum(column).alias(name) for name, column in totals.items()],
            )
            .withColumn("session_end", F.col("_session.end"))
            .select(*keys, "first_ts", "last_ts", "session_end", "n_events", *totals)
        )
    ordered = Window.partitionBy(*keys).orderBy(SLOT)
    apart = micros(F.col("first_ts")) - micros(F.lag("last_ts").over(ordered)) > whole_micros(gap)
    number = F.count_if(F.coalesce(F.col("_apart"), F.lit(True))).over(
        ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        activity(events, keys, ts, gap, totals)
        .withColumn("_apart", apart)
        .withColumn("_number", number)
        .groupBy(*keys, "_number")
        .agg(
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
            F.sum("n_events").alias("n_events"),
            *[F.sum(name).alias(name) for name in totals],
        )
        .withColumn("session_end", F.col("last_ts") + F.lit(gap))
        .select(*keys, "first_ts", "last_ts", "session_end", "n_events", *totals)
    )


def silent_keys(
    events: DataFrame,
    keys: Sequence[str],
    ts: str,
    timeout: timedelta,
    as_of: Column | None = None,
    delay: timedelta = DELAY,
) -> DataFrame:
    """Silences of a key: `last_ts` before it, `silent_from` = `last_ts` + timeout, and `back_ts`, NULL if still silent.

    A silence that is still going on is listed if it began by `as_of`, or always without it. On a stream, see
    `muster.streaming.silent_keys_stream`: `delay` is that of its watermark.
    """
    if events.isStreaming:
        from muster.streaming.silence import silent_keys_stream

        return silent_keys_stream(events, keys, ts, timeout, delay)
    ordered = Window.partitionBy(*keys).orderBy(SLOT)
    silences = (
        activity(events, keys, ts, timeout, {})
        .withColumn("back_ts", F.lead("first_ts").over(ordered))
        .withColumn("silent_from", F.col("last_ts") + F.lit(timeout))
    )
    ongoing = F.lit(True) if as_of is None else F.col("silent_from") <= as_of
    silent = F.when(F.col("back_ts").isNull(), ongoing).otherwise(F.col("back_ts") > F.col("silent_from"))
    return silences.filter(silent).select(*keys, "last_ts", "silent_from", "back_ts")
