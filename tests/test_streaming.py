import json
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from muster.operators import (
    asof_guard,
    average_states,
    explicit_sessions,
    gap_sessions,
    latest_per_key,
    retain_last_n,
    session_starts,
    severity_counts_stream,
    silent_keys,
    state_changes,
    summarize_sessions,
)
from muster.session import scratch_path, scratch_root
from muster.sources import read_log_lines, stream_entity_states
from muster.streaming import (
    asof_guard_stream,
    current_states,
    dedupe_events,
    explicit_sessions_stream,
    late_rows,
    read_current,
    read_retained,
    read_updates,
    retain_last_n_stream,
    run_available,
    run_to_table,
    silent_keys_stream,
    state_changes_stream,
    stream_table,
    updates_to,
)

START = datetime(2024, 1, 1)
SCHEMA = "k string, id bigint, ts timestamp, v string"
HOUR = timedelta(hours=1)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Every micro-batch starts a task per partition; the rows of these tests are few."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def at(minutes):
    return START + timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """Events of three keys, in four files that arrive in order of time."""
    folder = tmp_path_factory.mktemp("landed")
    events = [("abc"[n % 7 % 3], n, at(13 * n), "xyz"[n * n % 3]) for n in range(200)]
    for part in range(4):
        df = spark.createDataFrame(events[50 * part : 50 * part + 50], SCHEMA)
        df.coalesce(1).write.parquet(f"{folder}/{part}.parquet")
    return str(folder)


@pytest.fixture
def table(spark, landed):
    return spark.read.parquet(f"{landed}/*.parquet")


@pytest.fixture
def stream(spark, landed):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{landed}/*.parquet")


def closed(df, table, end):
    newest = table.agg(F.max("ts")).first()[0]
    return df.filter(F.col(end) <= F.lit(newest - HOUR).cast("timestamp"))


def test_gap_sessions(spark, stream, table, rows):
    found = run_to_table(gap_sessions(stream, ["k"], "ts", timedelta(minutes=30)), scratch_path(spark, "gap"))
    whole = gap_sessions(table, ["k"], "ts", timedelta(minutes=30))
    assert rows(found) == rows(closed(whole, table, "session_end"))
    assert 0 < found.count() < whole.count()


class Feed:
    """A stream whose rows land step by step; `run` goes on with it after each step."""

    def __init__(self, spark, name, schema=SCHEMA):
        self.spark, self.schema, self.path = spark, schema, scratch_path(spark, name)

    def land(self, *rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/landed")

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(f"{self.path}/landed")

    def run(self, made):
        return run_to_table(made(self.stream()), self.path)

    def update(self, made):
        writer = made(self.stream()).writeStream.outputMode("update").foreachBatch(updates_to(self.path))
        return run_available(writer, f"{self.path}/progress")


def tick(minutes):
    """A row that only moves the watermark."""
    return ("clock", -1, at(minutes), "t")


def test_silent_keys_are_told_when_they_begin_and_when_they_end(spark, rows):
    feed = Feed(spark, "silent")

    def told():
        return rows(feed.run(lambda s: silent_keys_stream(s, ["k"], "ts", timedelta(minutes=30), timedelta(minutes=5))).filter("k <> 'clock'"))

    feed.land(("a", 1, at(0), "x"), ("a", 2, at(20), "x"), ("b", 3, at(10), "x"))
    assert told() == []
    feed.land(tick(46))
    assert told() == [("b", at(10), at(40), None)]
    # An event at the very end of the time keeps the key; one behind the watermark comes too late.
    feed.land(("a", 4, at(50), "x"), ("b", 5, at(30), "x"), ("b", 6, at(70), "x"), tick(76))
    assert told() == [("b", at(10), at(40), None), ("b", at(10), at(40), at(70))]
    feed.land(tick(100))
    assert told() == [("a", at(50), at(80), None), ("b", at(10), at(40), None), ("b", at(10), at(40), at(70))]
    feed.land(("a", 7, at(200), "x"), ("a", 8, at(300), "x"), tick(500))
    assert sorted((row for row in told() if row[0] == "a"), key=lambda row: (row[1], row[3] or START)) == [
        ("a", at(50), at(80), None),
        ("a", at(50), at(80), at(200)),
        ("a", at(200), at(230), None),
        ("a", at(200), at(230), at(300)),
        ("a", at(300), at(330), None),
    ]


def test_silent_keys(spark, stream, table, rows):
    found = run_to_table(silent_keys(stream, ["k"], "ts", timedelta(minutes=30)), scratch_path(spark, "silent"))
    found = found.groupBy("k", "last_ts", "silent_from").agg(F.max("back_ts").alias("back_ts"))
    newest = F.lit(table.agg(F.max("ts")).first()[0] - HOUR).cast("timestamp")
    whole = closed(silent_keys(table, ["k"], "ts", timedelta(minutes=30)), table, "silent_from")
    whole = whole.withColumn("back_ts", F.when(F.col("back_ts") <= newest, F.col("back_ts")))
    assert rows(found) == rows(whole)
    assert found.filter("back_ts IS NOT NULL").count() > 3


@pytest.mark.parametrize("seed", range(3))
def test_silences_against_the_table(spark, rows, seed):
    """Rows out of order by less than the delay, in steps of any size."""
    import random

    rng = random.Random(seed)
    times = sorted(rng.sample(range(2000), 120))
    events = [("abc"[rng.randrange(3)], n, at(t) + timedelta(microseconds=rng.randrange(10**6)), "x") for n, t in enumerate(times)]
    events.sort(key=lambda e: e[2] + timedelta(minutes=rng.randrange(60)))
    feed, cut = Feed(spark, "silences"), sorted(rng.sample(range(1, 120), 3))
    for low, high in zip([0, *cut], [*cut, 120]):
        feed.land(*events[low:high])
        feed.run(lambda s: silent_keys_stream(s, ["k"], "ts", timedelta(minutes=25), HOUR))
    feed.land(tick(9000))
    found = feed.run(lambda s: silent_keys_stream(s, ["k"], "ts", timedelta(minutes=25), HOUR)).filter("k <> 'clock'")
    whole = spark.createDataFrame(events, SCHEMA)
    expected = rows(silent_keys(whole, ["k"], "ts", timedelta(minutes=25)))
    ended = [row for row in expected if row[-1] is not None]
    assert rows(found) == sorted([(*row[:-1], None) for row in expected] + ended, key=repr)


def test_window_operators(spark, stream, table, rows):
    def averages(df):
        numbered = df.withColumn("v", F.when(F.col("v") == "x", "no number").otherwise(F.col("id").cast("string")))
        return average_states(numbered, ["k"], HOUR, state="v")

    found = run_to_table(averages(stream), scratch_path(spark, "average"))
    whole = averages(table).withColumn("end", F.col("window_start") + F.lit(HOUR))
    assert rows(found) == rows(closed(whole, table, "end").drop("end"))

    found = run_to_table(severity_counts_stream(stream, HOUR, ["k"], level="v"), scratch_path(spark, "severity"))
    whole = severity_counts_stream(table, HOUR, ["k"], level="v").withColumn("end", F.col("window_start") + F.lit(HOUR))
    assert rows(found) == rows(closed(whole, table, "end").drop("end"))


@pytest.mark.parametrize("salts", [1, 8])
def test_dedupe(spark, stream, table, rows, salts):
    def twice(df):
        return df.unionByName(df).unionByName(df)

    found = run_to_table(dedupe_events(twice(stream), "id", salts=salts), scratch_path(spark, "dedupe"))
    assert rows(found) == rows(table) == rows(dedupe_events(twice(table), "id"))


def test_sliding_windows(spark, stream, table, rows):
    def averages(df):
        return average_states(df.withColumn("v", F.col("id").cast("string")), ["k"], 3 * HOUR, timedelta(minutes=90), state="v")

    found = run_to_table(averages(stream), scratch_path(spark, "sliding"))
    whole = averages(table).withColumn("end", F.col("window_start") + F.lit(3 * HOUR))
    assert rows(found) == rows(closed(whole, table, "end").drop("end"))
    assert found.count() > 9


def test_current_state(spark, rows):
    """Rows in any order, a repeated micro-batch and a restart."""
    feed, order = Feed(spark, "current"), ["ts", "id"]
    assert read_current(spark, feed.path, ["k"], order, SCHEMA).count() == 0
    events = [("abc"[n % 7 % 3], n, at(13 * (n * 37 % 200)), "xyz"[n * n % 3]) for n in range(200)]
    for part in range(4):
        feed.land(*events[50 * part : 50 * part + 50])
        feed.update(lambda s: current_states(s, ["k"], order))
        so_far = spark.createDataFrame(events[: 50 * part + 50], SCHEMA)
        expected = rows(latest_per_key(so_far, ["k"], order))
        assert rows(read_current(spark, feed.path, ["k"], order, SCHEMA)) == expected
    writes = read_updates(spark, feed.path, SCHEMA).groupBy("_batch").count().collect()
    assert len(writes) == 4 and all(row["count"] <= 3 for row in writes)


def test_a_repeated_batch_replaces_its_folder(spark, rows):
    path, batch = scratch_path(spark, "repeated"), spark.createDataFrame([("a", 1, at(0), "x")], SCHEMA)
    for _ in range(2):
        updates_to(path)(batch, 0)
    assert rows(read_updates(spark, path, SCHEMA)) == [("a", 1, at(0), "x", 0)]


def test_last_rows(spark, rows):
    """Rows in any order; what is kept and what has left add up to the last rows; the state holds no more than those."""
    feed, order = Feed(spark, "last"), ["ts", "id"]
    events = [("abc"[n % 7 % 3], n, at(13 * (n * 37 % 200)), "xyz"[n * n % 3]) for n in range(200)]
    for part in range(4):
        some = events[50 * part : 50 * part + 50]
        feed.land(*some, *some[:5])
        feed.update(lambda s: retain_last_n_stream(s, ["k"], order, 7))
        so_far = spark.createDataFrame(events[: 50 * part + 50], SCHEMA)
        assert rows(read_retained(spark, feed.path, ["k"], order, SCHEMA)) == rows(retain_last_n(so_far, ["k"], order, 7))
    state = spark.read.format("statestore").option("stateVarName", "kept").load(f"{feed.path}/progress")
    counts = state.groupBy("key").count().collect()
    assert len(counts) == 3 and all(row["count"] == 7 for row in counts)


CHANGED = ["k", "id", "v", "previous"]


@pytest.mark.parametrize("late", [False, True])
def test_changes(spark, rows, late):
    """Two hundred events in steps whose times interleave: put in order if they wait long enough, else dropped and counted."""
    events = [("abc"[n % 3], n, at(n), None if n % 11 == 0 else "xyz"[n * n % 7 % 3]) for n in range(200)]
    feed = Feed(spark, "interleaved")

    def changes(s):
        return state_changes_stream(s, ["k"], ["ts", "id"], "v", timedelta(minutes=5) if late else timedelta(days=1))

    dropped = 0
    for number in range(4):
        feed.land(*[e for e in events if e[1] % 4 == number], ("a", 900 + number, None, "z"))
        writer = changes(feed.stream()).writeStream.format("parquet").option("path", f"{feed.path}/rows")
        dropped += late_rows(run_available(writer, f"{feed.path}/progress"))
    feed.land(tick(9000))
    found = feed.run(changes).filter("k <> 'clock'")
    if late:
        assert dropped > 100 and found.count() < 60
        return
    assert dropped == 0
    whole = spark.createDataFrame(events, SCHEMA)
    assert rows(found, *CHANGED) == rows(state_changes(whole, ["k"], ["ts", "id"], "v"), *CHANGED)
    assert found.schema["ts"].dataType.simpleString() == "timestamp"


def test_changes_of_the_landed_stream(spark, stream, table, rows):
    found = run_to_table(state_changes_stream(stream, ["k"], ["ts", "id"], "v"), scratch_path(spark, "changes"))
    whole = closed(state_changes(table, ["k"], ["ts", "id"], "v"), table, "ts")
    assert rows(found, *CHANGED) == rows(whole, *CHANGED) and found.count() > 20


ACTIONS = ["new", "attach_or_create", "ended", "reconnect", "shell", "resume"]


def test_explicit_sessions(spark, rows):
    events = [("ab"[n * n % 5 % 2], n, at(n), ACTIONS[n * 7 % 13 % 6]) for n in range(150)]
    feed = Feed(spark, "explicit")

    def sessions(s):
        return explicit_sessions_stream(s, ["k"], ["ts", "id"], "v", HOUR)

    for number in range(3):
        feed.land(*[e for e in events if (e[1] + 20 * (e[1] % 2)) // 60 == number])
        feed.run(sessions)
    feed.land(tick(9000))
    found = feed.run(sessions)
    whole = spark.createDataFrame(events, SCHEMA)
    starts = session_starts(whole, ["k"], ["ts", "id"], "v")
    marked = explicit_sessions(starts, ["k"], ["ts", "id"], F.col("is_start"), F.col("v") == "ended")
    listed = summarize_sessions(marked, ["k"]).select("k", "session_start.id", "first_ts", "last_ts", "n_events")
    over = rows(found.select("k", "start_id", "first_ts", "last_ts", "n_events"))
    expected = rows(listed)
    # Of each key the last session may still live.
    assert set(over) <= set(expected) and len(expected) - 2 <= len(over) and len(over) > 20
    ends = {row.start_id: row.ended_by for row in found.collect()}
    last = {row.k + str(row.last_ts): row.v for row in marked.withColumnRenamed("ts", "last_ts").collect()}
    for row in found.collect():
        assert ends[row.start_id] == ("ended" if last[row.k + str(row.last_ts)] == "ended" else "replaced")
        assert row.start_ts == row.first_ts


def test_sessions_expire(spark, rows):
    feed = Feed(spark, "expire")

    def sessions(s):
        return explicit_sessions_stream(s, ["k"], ["ts", "id"], "v", timedelta(0), keep=HOUR)

    feed.land(("a", 1, at(0), "new"), ("a", 2, at(60), "shell"), ("b", 3, at(5), "new"), ("b", 4, at(66), "shell"), ("b", 5, at(70), "attach_or_create"))
    feed.land(tick(100))
    assert rows(feed.run(sessions), "k", "start_id", "n_events", "ended_by") == [("b", 3, 1, "expired")]
    feed.land(tick(121))
    assert rows(feed.run(sessions), "k", "start_id", "n_events", "ended_by") == [("a", 1, 2, "expired"), ("b", 3, 1, "expired")]


@pytest.mark.parametrize("max_age", [None, timedelta(minutes=20)])
def test_state_as_of_an_event(spark, rows, max_age):
    """Events and states land out of order; each event meets the newest state at or before it."""
    schema = "k string, id bigint, ts timestamp, v string"
    events = [("abc"[n % 3], n, at(3 * n), "e") for n in range(60)]
    states = [("abc"[n * n % 7 % 3], 1000 + n, at(2 * n if n % 3 else 3 * n), f"s{n}") for n in range(70)]
    one, two = Feed(spark, "events", schema), Feed(spark, "states", schema)

    def found(left, right):
        return asof_guard_stream(left, right, ["k"], "ts", ["v"], ["id"], max_age, HOUR)

    for number in range(3):
        one.land(*[e for e in events if (e[1] + 7 * (e[1] % 2)) // 25 == number])
        two.land(*[s for s in states if (s[1] - 1000 + 7 * (s[1] % 2)) // 30 == number])
        run_to_table(found(one.stream(), two.stream()), one.path)
    one.land(tick(9000))
    result = run_to_table(found(one.stream(), two.stream()), one.path).filter("k <> 'clock'")
    whole = asof_guard(spark.createDataFrame(events, schema), spark.createDataFrame(states, schema), ["k"], "ts", ["v"], ["id"], max_age)
    assert rows(result) == rows(whole) and result.filter("state IS NULL").count() >= 1


def test_feeds(spark, tmp_path, rows):
    states = tmp_path / "states"
    states.mkdir()
    lines = [{"installation_id": "a", "ts": f"2024-01-01T00:00:0{n}Z", "entity_id": "light", "state": s} for n, s in enumerate("xy")]
    (states / "0.json").write_text("\n".join(map(json.dumps, lines)))
    found = run_to_table(stream_entity_states(spark, str(states), max_files=1), scratch_path(spark, "states"))
    assert rows(found, "entity_id", "state") == [("light", "x"), ("light", "y")]
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "0.log").write_text("2024-01-01 00:00:01 WARNING slow\n")
    found = run_to_table(read_log_lines(spark, str(logs), stream=True), scratch_path(spark, "logs"))
    assert rows(found, "level", "message") == [("warning", "slow")]
    (logs / "installation_id=a").mkdir()
    (logs / "0.log").rename(logs / "installation_id=a" / "0.log")
    followed = read_log_lines(spark, str(logs), stream=True, keys="installation_id STRING")
    assert rows(run_to_table(followed, scratch_path(spark, "logs")), "installation_id", "level") == [("a", "warning")]


def test_stream_table(spark, landed, tmp_path):
    found = run_to_table(stream_table(spark, landed, "0.parquet"), scratch_path(spark, "table"))
    assert found.count() == 50
    part = next(iter(__import__("pathlib").Path(landed, "1.parquet").glob("part-*")))
    (tmp_path / "single.parquet").write_bytes(part.read_bytes())
    (tmp_path / "other.parquet").write_bytes(part.read_bytes())
    found = run_to_table(stream_table(spark, str(tmp_path), "single.parquet"), scratch_path(spark, "single"))
    assert found.count() == 50


def test_scratch(spark):
    assert scratch_path(spark, "x").startswith(scratch_root(spark))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_scratch_without_setting():
    settings = {"spark.sql.warehouse.dir": "file:/shared/warehouse"}
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: settings.get(key, default)))
    assert scratch_root(session) == "file:/shared/warehouse/scratch"


def test_the_query_of_changes_tells_all_of_them(spark, tmp_path, rows):
    """Those of the newest day, and those without a time, which come last."""
    from bindings import QUERIES

    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
    events = [(n, START + timedelta(hours=n * 3), [1, 2, None][n % 3], "xyz"[n * n % 7 % 3], 0.0) for n in range(60)]
    events += [(100, None, 1, "w", 0.0), (101, None, 1, "w", 0.0), (105, None, 2, "v", 0.0)]
    spark.createDataFrame(events, schema).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    expected, before = [], {}
    for event, _, user, kind, _ in sorted(events, key=lambda e: (e[1] or datetime.max, e[0])):
        if before.get(user) != kind:
            expected.append((event, user, kind, before.get(user)))
        before[user] = kind
    found = QUERIES["stream_state_changes"](spark, str(tmp_path))
    assert rows(found) == sorted(expected, key=repr) and {59, 100, 105} <= {row.event_id for row in found.collect()}


class CountedState:
    """A list or value state of one bucket that counts its calls."""

    def __init__(self):
        self.calls, self.value = 0, None

    def __getattr__(self, name):
        def call(*given):
            self.calls += 1
            if name == "get":
                return iter(self.value or []) if isinstance(self.value, list) or self.value is None else self.value
            if name == "appendList":
                self.value = [*(self.value or []), *given[0]]
            elif name in ("put", "update"):
                self.value = given[0]
            elif name == "clear":
                self.value = None

        return call


class CountedHandle:
    """Stands for Spark: list states, a timer's value state, timers."""

    def __init__(self):
        self.states, self.timers = [], 0

    def getListState(self, name, schema):
        self.states.append(CountedState())
        return self.states[-1]

    def getValueState(self, name, schema):
        state = CountedState()
        self.states.append(state)
        return SimpleNamespace(get=lambda: state.get() if state.value else None, update=state.update, clear=state.clear)

    def registerTimer(self, at):
        self.timers += 1

    deleteTimer = registerTimer

    def calls(self):
        return self.timers + sum(state.calls for state in self.states)


@pytest.mark.parametrize("which", ["changes", "silences", "last"])
def test_state_calls_do_not_grow_with_keys(which):
    """A call goes through a socket: keys of one bucket share theirs."""
    from pyspark.sql import Row
    from pyspark.sql import types as T

    from muster.streaming.current import LastRows
    from muster.streaming.ordered import AT, InOrder
    from muster.streaming.silence import Silences

    def fields(*names):
        return T.StructType([T.StructField(name, T.LongType()) for name in names])

    def made():
        if which == "changes":
            return InOrder(fields("k", "id", AT), ["k"], fields("v"), ["k", "id"], [AT, "id"], step, lambda memory: [], None)
        return Silences(fields("k"), ["k", "a", "b", "c"], 10) if which == "silences" else LastRows(fields("k", "id", AT), ["k"], ["id"], 2)

    def step(memory, row):
        return (row["id"],), [(row["id"],)]

    calls, found = {}, {}
    for n in (2, 500):
        processor, handle = made(), CountedHandle()
        processor.init(handle)
        rows = [Row(k=k, id=j, **{AT: 1000 * (j + 1) + k}, _bucket=0) for k in range(n) for j in range(3)]
        out = list(processor.handleInputRows((0,), iter(rows), None))
        if which != "last":
            passed = SimpleNamespace(getCurrentWatermarkInMs=lambda: 100)
            out = list(processor.handleExpiredTimer((0,), passed, None))
        calls[n], found[n] = handle.calls(), len(out)
    assert calls[500] == calls[2] and found[500] == 250 * found[2] > 0
