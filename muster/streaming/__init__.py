"""Structured Streaming: rows in order of time, states and last rows kept per key, silences, duplicates, running a stream.

Sessions by gap, windowed averages and line counts are the batch operators themselves; they accept a stream.
"""

from muster.streaming.current import (
    current_states,
    read_current,
    read_retained,
    read_updates,
    retain_last_n_stream,
    updates_to,
)
from muster.streaming.dedupe import dedupe_events
from muster.streaming.ordered import asof_guard_stream, explicit_sessions_stream, in_order, state_changes_stream
from muster.streaming.run import late_rows, run_available, run_to_table, stream_table
from muster.streaming.silence import silent_keys_stream

__all__ = [
    "asof_guard_stream",
    "current_states",
    "dedupe_events",
    "explicit_sessions_stream",
    "in_order",
    "late_rows",
    "read_current",
    "read_retained",
    "read_updates",
    "retain_last_n_stream",
    "run_available",
    "run_to_table",
    "silent_keys_stream",
    "state_changes_stream",
    "stream_table",
    "updates_to",
]
