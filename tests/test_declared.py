import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from muster.operators import (
    apply_requests,
    declared,
    declared_packages,
    distinct_packages,
    empty_groups,
    list_packages,
    package_line,
    package_rows,
    recorded_rows,
    remove_packages,
    replay_commands,
    request_outcome,
    requests_missing,
    valid_requests,
    validate_requests,
)
from muster.plans.flows import run_command, startup_packages
from muster.schemas import CORRUPT, OPTION_KEYS, STATE_KEYS
from muster.sources import corrupt_documents, parse_options, parse_package_state

STATE = "installation_id string, kind string, package string"
REQUESTS = "installation_id string, request_seq bigint, pos int, op string, kind string, package string, install_ok boolean"

OPTION_DOCUMENTS = [
    ("defaults", '{"launch": true, "persistent_apk_packages": [], "persistent_pip_packages": []}'),
    ("picker", '{"launch": false}'),
    ("auto", '{"launch": true}'),
    ("example", '{"launch": true, "persistent_apk_packages": ["vim", "htop", "rsync"], '
                '"persistent_pip_packages": ["requests", "pandas", "numpy"]}'),
    ("malformed", "launch: false"),
    ("wrong type", '{"launch": "yes", "persistent_apk_packages": ["vim"]}'),
    ("text null", '{"persistent_apk_packages": ["null"]}'),
    ("blanks", '{"persistent_apk_packages": ["git  curl", "", "git"]}'),
]
STATE_DOCUMENTS = [
    ("defaults", '{"apk_packages": [], "pip_packages": []}'),
    ("example", '{"apk_packages": ["vim", "jq"], "pip_packages": ["Requests"]}'),
    ("auto", '{"apk_packages": ["vim"]}'),
    ("malformed", "not json"),
    ("local only", '{"apk_packages": ["b", "a", "B", "b"], "pip_packages": []}'),
]


@pytest.fixture
def options(spark):
    return parse_options(spark.createDataFrame(OPTION_DOCUMENTS, "installation_id string, raw string"), "launch")


@pytest.fixture
def state_documents(spark):
    return parse_package_state(spark.createDataFrame(STATE_DOCUMENTS, "installation_id string, raw string"))


def test_options(options):
    parsed = {row.installation_id: row for row in options.collect()}
    assert parsed["defaults"].auto_launch and parsed["auto"].auto_launch and parsed["text null"].auto_launch
    assert not parsed["picker"].auto_launch and not parsed["wrong type"].auto_launch
    assert parsed["picker"].persistent_apk_packages == []
    assert parsed["malformed"].auto_launch and parsed["malformed"][CORRUPT] == "launch: false"
    assert parsed["wrong type"].persistent_apk_packages == ["vim"]
    assert [row.installation_id for row in corrupt_documents(options).collect()] == ["malformed"]


def test_package_state(state_documents):
    parsed = {row.installation_id: row for row in state_documents.collect()}
    assert parsed["auto"].pip_packages == [] and parsed["auto"].apk_packages == ["vim"]
    assert parsed["malformed"].apk_packages == [] and parsed["malformed"][CORRUPT] == "not json"


def test_startup_packages(options, state_documents, rows):
    assert rows(startup_packages(options, state_documents)) == [
        ("auto", "apk", "vim"),
        ("blanks", "apk", "curl git"),
        ("example", "apk", "htop jq rsync vim"),
        ("example", "pip", "Requests numpy pandas requests"),
        ("local only", "apk", "B a b"),
        ("wrong type", "apk", "vim"),
    ]


def test_origin(options, state_documents, rows):
    both = declared_packages(package_rows(options, OPTION_KEYS), package_rows(state_documents, STATE_KEYS))
    origin = {row[:3]: row[3] for row in rows(both)}
    assert origin["example", "apk", "vim"] == ["config", "local"]
    assert origin["example", "apk", "htop"] == ["config"]
    assert origin["auto", "apk", "vim"] == ["local"]


def test_empty_groups(spark, options, state_documents, rows):
    both = declared_packages(package_rows(options, OPTION_KEYS), package_rows(state_documents, STATE_KEYS))
    empty = empty_groups(options.select("installation_id"), both).filter("is_empty")
    assert rows(empty, "installation_id") == [("defaults",), ("malformed",), ("picker",), ("text null",)]


def test_list_packages(state_documents, rows):
    listed = rows(list_packages(state_documents).filter("installation_id in ('defaults', 'local only')"))
    assert listed == [
        ("defaults", "apk", None, "(none)"),
        ("defaults", "pip", None, "(none)"),
        ("local only", "apk", 0, "b"),
        ("local only", "apk", 1, "a"),
        ("local only", "apk", 2, "B"),
        ("local only", "apk", 3, "b"),
        ("local only", "pip", None, "(none)"),
    ]


def test_distinct_is_order_free(spark, rows):
    names = [("a", "apk", name) for name in ["x", "Y", "x", "", "z", "Y"]]
    expected = [("a", "apk", "Y x z")]
    for seed in range(3):
        random.Random(seed).shuffle(names)
        df = spark.createDataFrame(names, STATE)
        assert rows(package_line(df)) == expected
        assert distinct_packages(df).count() == 3


def test_validate(spark, rows):
    requests = spark.createDataFrame(
        [
            ("a", 1, 0, "add", "apk", "vim", True),
            ("a", 2, 0, "add", "apk", None, True),
            ("a", 3, 0, "add", "pip", "", True),
            ("a", 4, 0, "add", "npm", "x", True),
            ("a", 5, 0, "remove", "pip", None, None),
            ("a", 6, 0, "remove", None, "x", None),
            ("a", 7, 0, "remove", "npm", "x", None),
            ("a", 8, 0, "remove", "apk", "x", None),
            ("a", 9, 0, None, None, None, None),
            ("a", 10, 0, "upgrade", "apk", "x", None),
            ("a", 11, 0, "add", "pip", "y", False),
            ("a", 12, 0, "--help", None, None, None),
            ("a", 13, 0, "-h", None, None, None),
        ],
        REQUESTS,
    )
    reasons = {row.request_seq: row.reason for row in validate_requests(requests).collect()}
    assert reasons == {
        1: None,
        2: "no packages specified",
        3: "no packages specified",
        4: "unknown command",
        5: "missing arguments",
        6: "missing arguments",
        7: "unknown package type",
        8: None,
        9: None,
        10: "unknown command",
        11: None,
        12: None,
        13: None,
    }
    assert rows(valid_requests(requests), "request_seq") == [(1,), (8,)]


def test_requests(spark, rows):
    state = spark.createDataFrame([("a", "pip", "Requests"), ("a", "apk", "Vim")], STATE)
    requests = spark.createDataFrame(
        [
            ("a", 1, 0, "add", "apk", "vim", True),
            ("a", 1, 1, "add", "apk", "htop", True),
            ("a", 2, 0, "add", "apk", "vim", True),
            ("a", 3, 0, "add", "pip", "requests", True),
            ("a", 3, 1, "add", "pip", "Numpy", True),
            ("a", 4, 0, "add", "pip", "NUMPY", True),
            ("b", 1, 0, "add", "pip", "requests", True),
        ],
        REQUESTS,
    )
    outcome = request_outcome(requests, state)
    assert rows(outcome, "installation_id", "request_seq", "pos", "outcome") == [
        ("a", 1, 0, "added"),
        ("a", 1, 1, "added"),
        ("a", 2, 0, "present"),
        ("a", 3, 0, "present"),
        ("a", 3, 1, "added"),
        ("a", 4, 0, "present"),
        ("b", 1, 0, "added"),
    ]
    assert requests_missing(requests, state).count() == 6
    assert requests_missing(requests, state, folded=("pip", "apk")).count() == 4
    after = apply_requests(state, requests)
    assert rows(after) == [
        ("a", "apk", "Vim"),
        ("a", "apk", "htop"),
        ("a", "apk", "vim"),
        ("a", "pip", "Numpy"),
        ("a", "pip", "Requests"),
        ("b", "pip", "requests"),
    ]
    assert rows(apply_requests(after, requests)) == rows(after)
    assert rows(remove_packages(after, spark.createDataFrame([("a", "pip", "requests"), ("a", "apk", "vim")], STATE))) == [
        ("a", "apk", "Vim"),
        ("a", "apk", "htop"),
        ("a", "pip", "Numpy"),
        ("a", "pip", "Requests"),
        ("b", "pip", "requests"),
    ]


def test_run_command(spark, rows):
    state = spark.createDataFrame([("a", "apk", "vim")], STATE)
    requests = spark.createDataFrame(
        [
            ("a", 1, 0, "add", "apk", "htop", True),
            ("a", 2, 0, "add", "pip", "numpy", False),
            ("a", 3, 0, "remove", "apk", "vim", None),
            ("a", 4, 0, "remove", "npm", "vim", None),
        ],
        REQUESTS,
    )
    after, report = run_command(state, requests)
    assert rows(after) == [("a", "apk", "htop")]
    assert rows(report, "request_seq", "reason", "outcome") == [
        (1, None, "added"),
        (2, None, None),
        (3, None, None),
        (4, "unknown package type", None),
    ]


def replay_by_hand(state, commands):
    recorded = {}
    for installation, kind, package in state:
        recorded.setdefault((installation, kind), []).append(package)
    for installation, _, _, op, kind, package, _ in sorted(commands, key=lambda row: (row[1], row[2])):
        names = recorded.setdefault((installation, kind), [])
        if op == "remove":
            names[:] = [name for name in names if name != package]
        elif kind == "pip" and package.lower() not in [name.lower() for name in names]:
            names.append(package)
        elif kind == "apk" and package not in names:
            names.append(package)
    return sorted((i, k, name) for (i, k), names in recorded.items() for name in set(names))


NAMES = st.sampled_from(["ab", "Ab", "aB", "AB", "c", "C"])
KINDS = st.sampled_from(["apk", "pip"])


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    state=st.lists(st.tuples(st.sampled_from(["i", "j"]), KINDS, NAMES), max_size=5, unique=True),
    steps=st.lists(
        st.tuples(st.sampled_from(["i", "j"]), st.sampled_from(["add", "remove", "add"]), KINDS, NAMES), max_size=40
    ),
    chunk=st.sampled_from([2, 3, 10_000]),
)
def test_replay_matches_one_by_one(spark, state, steps, chunk):

    commands = [(i, 2 * seq, seq % 2, op, kind, name, True) for seq, (i, op, kind, name) in enumerate(steps)]
    sizes = declared.CHUNK, declared.WIDER
    declared.CHUNK, declared.WIDER = chunk, min(chunk, declared.WIDER)
    try:
        result = replay_commands(spark.createDataFrame(state, STATE), spark.createDataFrame(commands, REQUESTS))
        found = sorted(tuple(row) for row in result.collect())
    finally:
        declared.CHUNK, declared.WIDER = sizes
    assert found == replay_by_hand(state, commands)


def test_recorded_rows_keep_blanks(state_documents, rows):
    assert ("local only", "apk", 2, "B") in rows(recorded_rows(state_documents))


def test_remove_undoes_append(spark, rows):
    state = spark.createDataFrame([("a", "apk", "vim"), ("a", "pip", "Numpy")], STATE)
    requests = spark.createDataFrame([("a", 1, 0, "add", "pip", "x", True), ("b", 1, 0, "add", "apk", "y", True)], REQUESTS)
    assert rows(remove_packages(apply_requests(state, requests), requests)) == rows(state)


def test_request_copies(spark, rows):
    """Many copies of one request and of one recorded name."""
    state = spark.createDataFrame([("a", "apk", "vim")] * 50, STATE)
    requests = spark.createDataFrame(
        [("a", n, 0, "add", "apk", name, True) for n in range(50) for name in ("vim", "htop")], REQUESTS
    )
    assert requests_missing(requests, state).count() == 50
    assert request_outcome(requests, state).filter("outcome = 'added'").count() == 1
    assert apply_requests(state, requests).count() == 51
    assert remove_packages(state, requests).count() == 0


def test_replay_keeps_rows_without_installation(spark, rows):
    commands = [(None, 1, 0, "add", "pip", "x", True), (None, 2, 0, "add", "apk", "y", True)]
    empty = spark.createDataFrame([], STATE)
    after = replay_commands(empty, spark.createDataFrame(commands, REQUESTS))
    assert rows(after) == [(None, "apk", "y"), (None, "pip", "x")]


def test_many_commands_under_one_number(spark, rows):
    """Chunks are cut by rows, so positions under one number are divided too."""
    n = 50_000
    added = F.col("id") % 2 == 0
    commands = spark.range(n).select(
        F.lit("a").alias("installation_id"),
        F.lit(1).cast("bigint").alias("request_seq"),
        F.col("id").cast("int").alias("pos"),
        F.when(added, "add").otherwise("remove").alias("op"),
        F.lit("pip").alias("kind"),
        F.when(F.col("id") == n - 2, "TOOL").otherwise("Tool").alias("package"),
    )
    cut, chunks = declared.chunked(commands.withColumn("_commands", F.lit(n)), ["installation_id", "kind"], ["request_seq", "pos"])
    sizes = [row["count"] for row in cut.groupBy("_chunk").count().collect()]
    assert chunks == 5 and len(sizes) == 5 and max(sizes) < 2 * declared.CHUNK
    state = spark.createDataFrame([], STATE)
    # The last removal does not name the spelling that the last addition recorded.
    assert rows(replay_commands(state, commands)) == [("a", "pip", "TOOL")]
    assert rows(replay_commands(state, commands.filter(F.col("pos") < n - 2))) == []


def test_replay_reads_the_log_once(spark, tmp_path, rows):
    path = str(tmp_path / "log")
    spark.createDataFrame([("a", 1, 0, "add", "pip", "x", True), ("a", 2, 0, "remove", "apk", "y", True)], REQUESTS).write.parquet(path)
    result = replay_commands(spark.createDataFrame([("a", "apk", "y")], STATE), spark.read.parquet(path))
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    assert path not in plan and rows(result) == [("a", "pip", "x")]


def test_new_packages_follow_recorded_ones(spark, rows):
    state = spark.createDataFrame([("a", "apk", "vim", 0), ("a", "apk", "jq", 4)], "installation_id string, kind string, package string, pos int")
    requests = spark.createDataFrame(
        [("a", 2, 0, "add", "apk", "b", True), ("a", 1, 1, "add", "apk", "z", True), ("a", 1, 0, "add", "apk", "vim", True), ("b", 1, 0, "add", "pip", "x", True)],
        REQUESTS,
    )
    grown = declared.apply_requests(state, requests, position="pos")
    assert rows(grown, "installation_id", "pos", "package") == [("a", 0, "vim"), ("a", 4, "jq"), ("a", 5, "z"), ("a", 6, "b"), ("b", 0, "x")]
    documents = rows(declared.package_documents(remove_packages(grown, state.filter("package = 'jq'"))))
    assert documents == [
        ("a", '{"apk_packages":["vim","z","b"],"pip_packages":[]}'),
        ("b", '{"apk_packages":[],"pip_packages":["x"]}'),
    ]
