import random
from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from muster.operators import (
    asof_guard,
    conversation_list,
    explicit_sessions,
    gap_sessions,
    has_live_session,
    latest_per_key,
    live_sessions,
    overlay_layers,
    package_prevalence,
    resolve_answers,
    resolve_launch_mode,
    retain_last_n,
    session_starts,
    severity_counts,
    silent_keys,
    state_changes,
    summarize_sessions,
    top_n,
)
from muster.plans import hot
from muster.plans.slots import AUTO, WHOLE, Slicing, choose_slices, with_slot

START = datetime(2024, 1, 1)
EVENTS = "k string, id bigint, ts timestamp, v string"


def at(minutes):
    return START + timedelta(minutes=minutes)


# Events of two keys, one of them with most rows; minutes before and after the start of the epoch's slots included.
EVENT_LISTS = st.lists(
    st.tuples(st.sampled_from("aab"), st.integers(-200, 200), st.sampled_from(["x", "y", "z", None])),
    max_size=60,
)
# Undivided keys, ranges, and slots in minutes or numbers.
SLICES = st.sampled_from([WHOLE, None, 1, 7, 1000])


def sliced(slices, timed=True):
    if slices == WHOLE:
        return WHOLE
    return Slicing(timedelta(minutes=slices) if timed and slices else slices)


CHECK = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def numbered(events):
    return [(key, number, at(minute), value) for number, (key, minute, value) in enumerate(events)]


def by_key(events):
    ordered = {}
    for row in sorted(events, key=lambda row: (row[2], row[1])):
        ordered.setdefault(row[0], []).append(row)
    return ordered


@CHECK
@given(events=EVENT_LISTS, slices=SLICES)
def test_state_changes(spark, events, slices):
    events = numbered(events)
    expected = []
    for group in by_key(events).values():
        previous = None
        for row in group:
            if previous is None or previous[3] != row[3]:
                expected.append((row[1], previous[3] if previous else None))
            previous = row
    df = spark.createDataFrame(events, EVENTS)
    found = state_changes(df, ["k"], ["ts", "id"], "v", sliced(slices)).select("id", "previous").collect()
    assert sorted(map(tuple, found)) == sorted(expected)


@CHECK
@given(events=EVENT_LISTS, slices=SLICES, n=st.sampled_from([1, 3, 20]))
def test_retain_last_n(spark, events, slices, n):
    events = numbered(events)
    expected = [row[1] for group in by_key(events).values() for row in group[-n:]]
    df = spark.createDataFrame(events, EVENTS)
    found = retain_last_n(df, ["k"], ["ts", "id"], n, sliced(slices)).select("id").collect()
    assert sorted(row.id for row in found) == sorted(expected)
    whole = retain_last_n(df, ["k"], ["id"], n, sliced(slices, False)).select("id").collect()
    kept = [row[1] for key in "ab" for row in [row for row in events if row[0] == key][-n:]]
    assert sorted(row.id for row in whole) == sorted(kept)


@CHECK
@given(events=EVENT_LISTS, gap=st.sampled_from([1, 5, 60]))
def test_gap_sessions(spark, events, gap):
    events = numbered(events)
    span = timedelta(minutes=gap)
    expected = []
    for key, group in by_key(events).items():
        session = []
        for row in group:
            if session and row[2] - session[-1] > span:
                expected.append((key, session[0], session[-1], session[-1] + span, len(session)))
                session = []
            session.append(row[2])
        expected.append((key, session[0], session[-1], session[-1] + span, len(session)))
    df = spark.createDataFrame(events, EVENTS)
    found = [tuple(row) for row in gap_sessions(df, ["k"], "ts", span).collect()]
    assert sorted(found) == sorted(expected)
    window = F.session_window("ts", f"{gap} minutes")
    builtin = df.groupBy("k", window).agg(F.min("ts"), F.max("ts"), F.col("session_window.end"), F.count("*"))
    assert sorted(tuple(row) for row in builtin.drop("session_window").collect()) == sorted(found)
    silent = silent_keys(df, ["k"], "ts", span)
    assert sorted((row.k, row.last_ts) for row in silent.collect()) == sorted((row[0], row[2]) for row in expected)


def test_silence(spark, rows):
    df = spark.createDataFrame([("a", 1, at(0), ""), ("a", 2, at(10), ""), ("a", 3, at(21), ""), ("b", 4, at(25), "")], EVENTS)
    as_of = F.lit(at(32)).cast("timestamp")
    assert rows(silent_keys(df, ["k"], "ts", timedelta(minutes=10), as_of)) == [
        ("a", at(10), at(20), at(21)),
        ("a", at(21), at(31), None),
    ]


def test_gap_totals(spark, rows):
    df = spark.createDataFrame([("a", 1, at(0)), ("a", 2, at(1)), ("a", 4, at(50))], "k string, n bigint, ts timestamp")
    sessions = gap_sessions(df, ["k"], "ts", timedelta(minutes=5), {"total": "n"})
    assert rows(sessions, "n_events", "total") == [(1, 4), (2, 3)]


ACTIONS = ["attach_or_create", "reconnect", "new", "continue", "ended", "shell"]


@CHECK
@given(
    events=st.lists(st.tuples(st.sampled_from("aab"), st.integers(0, 300), st.sampled_from(ACTIONS)), max_size=50),
    slices=SLICES,
)
def test_explicit_sessions(spark, events, slices):
    events = numbered(events)
    expected, live = {}, {}
    for key, group in by_key(events).items():
        current = None
        for row in group:
            action = row[3]
            if action in ("new", "continue") or (action == "attach_or_create" and current is None):
                current = row[1]
            expected[row[1]] = current
            if action == "ended":
                current = None
        live[key] = current is not None
    df = spark.createDataFrame(events, EVENTS).withColumnRenamed("v", "action")
    divided = sliced(slices)
    starts = session_starts(df, ["k"], ["ts", "id"], slices=divided)
    sessions = explicit_sessions(
        starts, ["k"], ["ts", "id"], F.col("is_start"), F.col("action") == "ended", slices=divided
    )
    found = {row.id: row.session_start.id if row.session_start else None for row in sessions.collect()}
    assert found == expected
    counts = [row.n_events for row in summarize_sessions(sessions, ["k"]).collect()]
    held = [start for start in expected.values() if start is not None]
    assert sorted(counts) == sorted(held.count(start) for start in set(held))
    assert sorted(row.k for row in live_sessions(df, ["k"], ["ts", "id"]).collect()) == sorted(key for key in live if live[key])


def test_sessions_without_end(spark, rows):
    df = spark.createDataFrame([("a", n, at(30 * n), v) for n, v in enumerate("xsxxs")], EVENTS)
    sessions = explicit_sessions(df, ["k"], ["ts", "id"], F.col("v") == "s")
    assert rows(sessions.select("id", "session_start.id").toDF("id", "start")) == [(0, None), (1, 1), (2, 1), (3, 1), (4, 4)]


@CHECK
@given(events=EVENT_LISTS, states=EVENT_LISTS, age=st.sampled_from([None, 3]))
def test_asof_guard(spark, events, states, age):
    events, states = numbered(events), numbered(states)
    limit = timedelta(minutes=age) if age else timedelta.max
    expected = []
    for key, number, ts, _ in events:
        earlier = [row for row in states if row[0] == key and row[2] <= ts]
        newest = max(earlier, key=lambda row: row[2], default=None)
        newest = newest if newest and ts - newest[2] <= limit else None
        expected.append((number, newest[2] if newest else None))
    found = asof_guard(
        spark.createDataFrame(events, EVENTS),
        spark.createDataFrame(states, EVENTS),
        ["k"],
        "ts",
        ["v"],
        max_age=limit if age else None,
    )
    assert sorted((row.id, row.state.ts if row.state else None) for row in found.collect()) == sorted(expected)


def test_asof_value(spark, rows):
    states = spark.createDataFrame([("a", 1, at(0), "dark"), ("a", 2, at(9), "light")], EVENTS)
    events = spark.createDataFrame([("a", 3, at(9), "m"), ("a", 4, at(8), "m"), ("b", 5, at(9), "m")], EVENTS)
    found = asof_guard(events, states, ["k"], "ts", ["v"]).select("id", "v", "state.v")
    assert rows(found.toDF("id", "v", "seen")) == [(3, "m", "light"), (4, "m", "dark"), (5, "m", None)]


def test_null_keys_keep_their_history(spark, rows):
    df = spark.createDataFrame([(None, n, at(30 * n), v) for n, v in enumerate("xxy")], EVENTS)
    assert rows(state_changes(df, ["k"], ["ts", "id"], "v"), "id", "previous") == [(0, None), (2, "x")]


def test_overlay(spark, rows):
    files = [
        ("a", 0, "p", "p0"), ("a", 1, "p", "p1"), ("a", 3, "p", "p3"),
        ("a", 0, "q", "q0"),
        ("a", 2, ".hidden", "h2"), ("a", 2, "dir/.kept", "k2"),
        ("a", 0, ".own", "o0"), ("a", 4, ".own", "o4"),
        ("b", 4, "p", "b4"),
    ]
    df = spark.createDataFrame(files, "installation_id string, layer int, path string, content_hash string")
    assert rows(overlay_layers(df), "installation_id", "path", "content_hash") == [
        ("a", ".own", "o0"), ("a", "dir/.kept", "k2"), ("a", "p", "p3"), ("a", "q", "q0"), ("b", "p", "b4"),
    ]
    single = df.filter("layer = 0")
    assert rows(overlay_layers(single)) == rows(single)


def test_latest_and_list(spark, rows):
    turns = [(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", None), (2, 5, "user", "x")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    assert rows(latest_per_key(df, ["conv_id"], ["turn"])) == [(1, 1, "bot", "yo"), (2, 5, "user", "x")]
    assert rows(conversation_list(df)) == [(1, 2, 0, 1, "hi", "bot"), (2, 2, 0, 5, None, "user")]
    assert rows(top_n(df, [F.desc("turn"), F.asc("conv_id")], 2)) == [(1, 1, "bot", "yo"), (2, 5, "user", "x")]


def test_answers(spark, rows):
    answers = ["", "0", "1", " 3 ", "1 2", "8", "x", None]
    df = spark.createDataFrame([(a, s) for a in answers for s in (True, False)], "answer string, has_session boolean")
    found = rows(resolve_answers(df), "has_session", "answer", "valid", "action", "reason")
    expected = []
    for answer in answers:
        for live in (True, False):
            bare = "".join((answer or "").split()) or ("0" if live else "1")
            action = {"0": "reconnect" if live else None, "1": "new", "3": "resume"}.get(bare)
            reason = None if action else "no existing session" if bare == "0" else "invalid choice"
            expected.append((live, bare, action is not None, action, reason))
    assert found == sorted(expected, key=repr)


def test_live_lookup(spark, rows):
    sessions = spark.createDataFrame([("a", "s")], "installation_id string, session_name string")
    requests = spark.createDataFrame([("a", "s"), ("a", "t"), ("b", "s")], "installation_id string, session_name string")
    assert rows(has_live_session(requests, sessions)) == [("a", "s", True), ("a", "t", False), ("b", "s", False)]


def test_launch_mode(spark, rows):
    df = spark.createDataFrame(
        [("true", None), (None, False), ("false", True), ("yes", False), ("false", None)], "auto_launch string, picker boolean"
    )
    modes = resolve_launch_mode(df, F.col("picker"))
    assert rows(modes, "auto_launch", "launch_mode") == [
        ("false", "auto_fallback"), ("false", "picker"), ("true", "auto"), ("yes", "auto_fallback"), (None, "auto"),
    ]


def test_prevalence(spark, rows):
    packages = [("a", "arm", "apk", "vim"), ("a", "arm", "apk", "vim"), ("b", "arm", "apk", "vim"), ("c", "x86", "pip", "vim")]
    df = spark.createDataFrame(packages, "installation_id string, arch string, kind string, package string")
    found = rows(package_prevalence(df))
    assert (None, None, None, 3, 7) in found and ("arm", "apk", "vim", 2, 0) in found and ("arm", None, None, 2, 3) in found
    assert len(found) == 7
    assert rows(package_prevalence(df, approx=True)) == found
    assert len(rows(package_prevalence(df, cube=True))) > 7


def test_severity_counts(spark, rows):
    logs = spark.createDataFrame([("a", "info"), ("a", "info"), ("a", "error"), ("b", "debug")], "k string, level string")
    assert rows(severity_counts(logs, ["k"])) == [("a", 2, 0, 1, 0), ("b", 0, 0, 0, 1)]


def one_hot_key(spark, minutes):
    """One key with nearly all rows."""
    random.seed(1)
    events = [("hot", n, at(random.randrange(minutes)), random.choice("xy")) for n in range(3000)]
    return spark.createDataFrame([*events, ("cold", 3000, at(0), "x")], EVENTS)


def shuffled_by_key_alone(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "hashpartitioning(k#" in line and "_slot" not in line]


def test_plain_window_without_hot_keys(spark):
    df = one_hot_key(spark, 100_000)
    assert choose_slices(df, ["k"], ["ts", "id"]) == WHOLE
    assert len(shuffled_by_key_alone(state_changes(df, ["k"], ["ts", "id"], "v"))) == 1


def both_ways(df, rows):
    changes = state_changes(df, ["k"], ["ts", "id"], "v")
    last = retain_last_n(df, ["k"], ["ts", "id"], 100)
    return rows(changes), rows(last), df.count()


def fullest_slot(df):
    slots_of = with_slot(df, ["k"], ["ts", "id"], choose_slices(df, ["k"], ["ts", "id"]))
    return slots_of.groupBy("k", "_slot").count().agg(F.max("count")).first()[0]


def test_hot_key_is_divided(spark, rows, monkeypatch):
    df = one_hot_key(spark, 100_000)
    whole = both_ways(df, rows)
    monkeypatch.setattr(hot, "ROWS_PER_TASK", 500)
    slicing = choose_slices(df, ["k"], ["ts", "id"])
    assert slicing.width is None and slicing.hot.rows == 3000 and slicing.hot.table.count() == 1
    assert fullest_slot(df) < 1000
    assert both_ways(df, rows) == whole


def test_hot_null_key_is_divided(spark, rows, monkeypatch):
    df = one_hot_key(spark, 100_000).withColumn("k", F.nullif("k", F.lit("hot")))
    whole = both_ways(df, rows)
    monkeypatch.setattr(hot, "ROWS_PER_TASK", 500)
    assert fullest_slot(df) < 1000
    assert both_ways(df, rows) == whole


def test_hot_slot_is_cut_into_ranges(spark, rows, monkeypatch):
    """All rows of the key at one time: they are cut by the second ordering column."""
    df = one_hot_key(spark, 1)
    whole = both_ways(df, rows)
    monkeypatch.setattr(hot, "ROWS_PER_TASK", 500)
    assert choose_slices(df, ["k"], ["ts", "id"], AUTO).width is None
    assert fullest_slot(df) < 1000
    assert both_ways(df, rows) == whole
