"""Sessions on the events table: the user stands for the installation."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindings.registry import Tables, query
from muster.operators import (
    explicit_sessions,
    gap_sessions,
    has_live_session,
    live_sessions,
    resolve_answers,
    resolve_code,
    session_starts,
    silent_keys,
    summarize_sessions,
)
from muster.plans.slots import choose_slices

USER = ["user_id"]
ORDER = ["ts", "event_id"]

# Fixed values of this binding: the action each event type stands for.
ACTIONS = {"signup": "new", "view": "attach_or_create", "purchase": "ended", "click": "reconnect", "error": "shell"}
ACTIONS_SQL = """CASE event_type WHEN 'signup' THEN 'new' WHEN 'view' THEN 'attach_or_create' WHEN 'purchase' THEN 'ended'
    WHEN 'click' THEN 'reconnect' ELSE 'shell' END"""


def session_events(t: Tables) -> DataFrame:
    action = F.lit(None)
    for event_type, name in ACTIONS.items():
        action = F.when(F.col("event_type") == event_type, name).otherwise(action)
    return t("events").select("event_id", "ts", "user_id", action.alias("action"))


@query("""
    SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events FROM (
        SELECT *, count(CASE WHEN event_type = 'signup' THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id
            ROWS UNBOUNDED PRECEDING) AS number FROM events)
    WHERE number > 0 GROUP BY user_id, number
""")
def explicit_session_list(t: Tables) -> DataFrame:
    events = t("events").select("event_id", "ts", "user_id", "event_type")
    sessions = explicit_sessions(events, USER, ORDER, F.col("event_type") == "signup")
    return summarize_sessions(sessions, USER).select("user_id", "first_ts", "last_ts", "n_events")


STARTS_SQL = f"""
    WITH actions AS (SELECT event_id, user_id, ts, {ACTIONS_SQL} AS action FROM events),
    decided AS (SELECT *, lag(CASE WHEN action IN ('new', 'attach_or_create', 'ended') THEN action END IGNORE NULLS)
        OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM actions),
    starts AS (SELECT *, action = 'new' OR (action = 'attach_or_create' AND coalesce(before, 'ended') = 'ended') AS is_start
        FROM decided)
"""


@query(f"{STARTS_SQL} SELECT event_id, action, is_start FROM starts")
def session_start_flags(t: Tables) -> DataFrame:
    return session_starts(session_events(t), USER, ORDER).select("event_id", "action", "is_start")


@query(f"""
    {STARTS_SQL}
    SELECT event_id, CASE WHEN is_start THEN event_id WHEN coalesce(before, 'ended') <> 'ended' THEN opened END AS started_by
    FROM (SELECT *, last_value(CASE WHEN is_start THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
        ROWS UNBOUNDED PRECEDING) AS opened FROM starts)
""")
def session_of_event(t: Tables) -> DataFrame:
    events = session_events(t)
    slices = choose_slices(events, USER, ORDER)
    starts = session_starts(events, USER, ORDER, slices=slices)
    sessions = explicit_sessions(starts, USER, ORDER, F.col("is_start"), F.col("action") == "ended", slices)
    return sessions.select("event_id", F.col("session_start.event_id").alias("started_by"))


LIVE_SQL = f"""
    SELECT user_id, arg_max(action, event_id) <> 'ended' AS live FROM (SELECT user_id, event_id, {ACTIONS_SQL} AS action FROM events)
    WHERE action IN ('new', 'attach_or_create', 'ended') GROUP BY user_id
"""


@query(f"""
    SELECT c_custkey AS user_id, coalesce(live, false) AS has_session FROM customer LEFT JOIN ({LIVE_SQL}) ON c_custkey = user_id
""")
def live_session_lookup(t: Tables) -> DataFrame:
    requests = t("customer").select(F.col("c_custkey").alias("user_id"))
    return has_live_session(requests, live_sessions(session_events(t), USER, ORDER), USER)


@query(f"""
    WITH live AS ({LIVE_SQL}),
    answers AS (SELECT event_id, coalesce(live, false) AS has_session, CASE WHEN value < 15 THEN '' WHEN value < 30 THEN ' 0'
        WHEN value < 45 THEN '1 2' WHEN value < 60 THEN ' 3 ' WHEN value < 80 THEN 'x' WHEN value < 100 THEN NULL ELSE '7' END AS raw
        FROM events LEFT JOIN live USING (user_id)),
    bare AS (SELECT event_id, has_session, coalesce(nullif(replace(raw, ' ', ''), ''), CASE WHEN has_session THEN '0' ELSE '1' END)
        AS answer FROM answers)
    SELECT event_id, answer, CASE WHEN answer = '0' AND has_session THEN 'reconnect' WHEN answer = '1' THEN 'new'
        WHEN answer = '3' THEN 'resume' WHEN answer = '7' THEN 'exit' END AS action,
        answer IN ('1', '3', '7') OR (answer = '0' AND has_session) AS valid,
        CASE WHEN answer IN ('1', '3', '7') THEN NULL WHEN answer <> '0' THEN 'invalid choice'
        WHEN NOT has_session THEN 'no existing session' END AS reason
    FROM bare
""")
def menu_answers(t: Tables) -> DataFrame:
    value = F.col("value")
    raw = (
        F.when(value < 15, "").when(value < 30, " 0").when(value < 45, "1 2").when(value < 60, " 3 ").when(value < 80, "x")
        .when(value >= 100, "7")
    )
    answers = t("events").select("event_id", "user_id", raw.alias("answer"))
    asked = has_live_session(answers, live_sessions(session_events(t), USER, ORDER), USER)
    return resolve_answers(asked).select("event_id", "answer", "action", "valid", "reason")


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber WHEN 1 THEN 'new' WHEN 2 THEN 'continue' WHEN 3 THEN 'resume'
        WHEN 4 THEN 'custom' WHEN 5 THEN 'auth_helper' WHEN 6 THEN 'shell' WHEN 7 THEN 'exit' END AS action FROM lineitem
""")
def code_lookup(t: Tables) -> DataFrame:
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_linenumber").cast("string").alias("answer"))
    return resolve_code(lines).drop("answer")


GAP_SQL = """
    SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n_events FROM (
        SELECT *, count(CASE WHEN apart THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS number
        FROM (SELECT *, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR, true) AS apart FROM events))
    GROUP BY user_id, number
"""


@query(GAP_SQL)
def gap_session_list(t: Tables) -> DataFrame:
    return gap_sessions(t("events"), USER, "ts", timedelta(hours=6))


@query("""
    SELECT user_id, ts AS last_ts, ts + INTERVAL 6 HOUR AS silent_from, back AS back_ts
    FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS back FROM events)
    WHERE back IS NULL OR back > ts + INTERVAL 6 HOUR
""")
def silent_key_list(t: Tables) -> DataFrame:
    return silent_keys(t("events"), USER, "ts", timedelta(hours=6))
