"""Ordered histories on events and conversations."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindings.registry import Tables, query
from muster.operators import (
    asof_guard,
    conversation_list,
    latest_per_key,
    overlay_layers,
    retain_last_n,
    state_changes,
    top_n,
)

ORDER = ["ts", "event_id"]


@query("""
    SELECT user_id, path, layer, event_id FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, path ORDER BY layer DESC, event_id DESC) AS n FROM (
            SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN '.error' ELSE event_type END AS path,
                CASE WHEN value < 5 THEN 0 WHEN value < 20 THEN 1 WHEN value < 60 THEN 2 ELSE 3 END AS layer FROM events)
        WHERE layer = 0 OR path NOT LIKE '.%')
    WHERE n = 1
""")
def overlay(t: Tables) -> DataFrame:
    value = F.col("value")
    files = t("events").select(
        "user_id",
        F.when(F.col("event_type") == "error", ".error").otherwise(F.col("event_type")).alias("path"),
        F.when(value < 5, 0).when(value < 20, 1).when(value < 60, 2).otherwise(3).alias("layer"),
        "event_id",
    )
    return overlay_layers(files, ["user_id", "path"], tie=["event_id"])


@query("""
    SELECT conv_id, turn, role, text FROM conversations
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1
""")
def latest_turn(t: Tables) -> DataFrame:
    return latest_per_key(t("conversations"), ["conv_id"], ["turn"])


@query("""
    SELECT conv_id, count(*) AS n_turns, min(turn) AS first_turn, max(turn) AS last_turn, arg_min(text, turn) AS opening,
        arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id
""")
def conversations_listed(t: Tables) -> DataFrame:
    return conversation_list(t("conversations"))


@query("""
    SELECT conv_id, turn, role, text FROM conversations
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3
""")
def last_turns(t: Tables) -> DataFrame:
    return retain_last_n(t("conversations"), ["conv_id"], ["turn"], n=3)


@query("""
    SELECT event_type, event_id, ts FROM events
    QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 1000
""")
def last_events(t: Tables) -> DataFrame:
    """Few keys with very many rows each."""
    events = t("events").select("event_type", "event_id", "ts")
    return retain_last_n(events, ["event_type"], ORDER, n=1000)


@query("""
    SELECT event_id, user_id, event_type, previous FROM (
        SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
    WHERE previous IS DISTINCT FROM event_type
""")
def state_change_list(t: Tables) -> DataFrame:
    events = t("events").select("event_id", "user_id", "ts", "event_type")
    changes = state_changes(events, ["user_id"], ORDER, "event_type")
    return changes.select("event_id", "user_id", "event_type", "previous")


@query("""
    SELECT p.event_id, p.user_id, v.value AS seen_value, v.ts AS seen_ts
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts
""")
def asof_view(t: Tables) -> DataFrame:
    events = t("events").select("event_id", "user_id", "ts", "event_type", "value")
    purchases = events.filter(F.col("event_type") == "purchase").drop("value")
    views = events.filter(F.col("event_type") == "view")
    found = asof_guard(purchases, views, ["user_id"], "ts", ["value"], ["event_id"])
    return found.select("event_id", "user_id", F.col("state.value").alias("seen_value"), F.col("state.ts").alias("seen_ts"))


@query("""
    SELECT p.event_id, CASE WHEN v.ts >= p.ts - INTERVAL 1 DAY THEN v.value END AS seen_value
    FROM events p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') v ON p.user_id = v.user_id AND p.ts >= v.ts
""")
def asof_recent_error(t: Tables) -> DataFrame:
    events = t("events").select("event_id", "user_id", "ts", "event_type", "value")
    errors = events.filter(F.col("event_type") == "error")
    found = asof_guard(events.select("event_id", "user_id", "ts"), errors, ["user_id"], "ts", ["value"], ["event_id"], timedelta(days=1))
    return found.select("event_id", F.col("state.value").alias("seen_value"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_orders(t: Tables) -> DataFrame:
    orders = t("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return top_n(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], 20)
