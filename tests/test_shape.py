import json

import pytest
from pyspark.sql import functions as F

from muster.functions import (
    append_absent,
    ascii_lower,
    blank_to,
    date_label,
    has_value,
    joined,
    kb_to_mb,
    nth_field,
    remove_every,
    squeeze,
    strip_all_space,
    words_of,
)
from muster.operators import explode_records, first_record, match_any, passthrough, project_fields
from muster.plans.flows import api_report
from muster.sources import read_api_snapshots

REPLIES = [
    ("a", "addons/self/info", None, {"data": {"name": "n", "version": "1.0", "state": "started", "extra": 1}}),
    ("b", "addons/self/info", "GET", {"result": "ok"}),
    ("c", "addons/self/info", "", "not json"),
    ("a", "core/info", "GET", {"data": {"version": "2024.1", "machine": "m", "operating_system": "os"}}),
    ("a", "addons", "GET", {"data": {"addons": [{"name": "x", "slug": "sx", "version": "1", "state": "started"},
                                               {"name": "y", "version": "2", "state": "stopped"}]}}),
    ("b", "addons", "GET", {"data": {"addons": []}}),
    ("a", "network/info", "GET", {"data": {"interfaces": [{"interface": "eth0", "ipv4": {"address": ["10.0.0.1/24"]}},
                                                         {"interface": "wlan0"}]}}),
    ("b", "network/info", "GET", {"data": {"interfaces": []}}),
    ("c", "network/info", "GET", {"data": {"interfaces": [{"interface": "eth0", "ipv4": {"address": "10.0.0.2"}}]}}),
    ("a", "system_health/info", "POST", {"b": [1, {"c": None}], "a": "x"}),
]


@pytest.fixture(scope="module")
def snapshots(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("replies")
    lines = [
        json.dumps(
            {
                "installation_id": installation,
                "observed_at": "2024-01-01T00:00:00Z",
                "endpoint": endpoint,
                "method": method,
                "payload": payload if isinstance(payload, str) else json.dumps(payload),
            }
        )
        for installation, endpoint, method, payload in REPLIES
    ]
    (folder / "replies.json").write_text("\n".join(lines))
    return read_api_snapshots(spark, str(folder))


def test_method_default(snapshots):
    methods = {(row.installation_id, row.endpoint): row.method for row in snapshots.collect()}
    assert methods["a", "addons/self/info"] == methods["c", "addons/self/info"] == "GET"
    assert methods["a", "system_health/info"] == "POST"


def test_views(snapshots, rows):
    views = api_report(snapshots)
    assert rows(views["self"].drop("observed_at")) == [
        ("a", "n", "1.0", "started"),
        ("b", None, None, None),
        ("c", None, None, None),
    ]
    assert rows(views["host"].drop("observed_at")) == [("a", "2024.1", "m", "os")]
    assert rows(views["addons"].drop("observed_at")) == [("a", "x", "sx", "1", "started"), ("a", "y", None, "2", "stopped")]
    network = views["network"].withColumn("ip_address", F.to_json("ip_address")).drop("observed_at")
    assert rows(network) == [("a", "eth0", '["10.0.0.1/24"]'), ("b", None, None), ("c", "eth0", '"10.0.0.2"')]


def test_outer_keeps_parent(snapshots, rows):
    records = explode_records(snapshots, "addons", "data.addons", ["slug"], keys=["installation_id"], outer=True)
    assert rows(records) == [("a", "sx"), ("a", None), ("b", None)]


def test_custom_schema(snapshots, rows):
    view = project_fields(snapshots, "system_health/info", {"letter": "a"}, ["installation_id"], schema="a STRING")
    assert rows(view) == [("a", "x")]
    first = first_record(snapshots, "system_health/info", "b", {"item": "c"}, ["installation_id"], schema="b ARRAY<STRUCT<c: STRING>>")
    assert first.count() == 1


def test_passthrough(snapshots):
    health = passthrough(snapshots.filter("endpoint = 'system_health/info' or installation_id = 'c'"))
    assert health.select("payload").exceptAll(snapshots.select("payload")).isEmpty()
    texts = {row.endpoint: row.text for row in health.select("endpoint", F.to_json("document").alias("text")).collect()}
    assert json.loads(texts["system_health/info"]) == {"a": "x", "b": [1, {"c": None}]}
    assert texts["addons/self/info"] is None


def test_match_any(spark, rows):
    names = spark.createDataFrame(
        [("a_token.json",), ("TOKEN.txt",), ("notes.md",), ("a_token.bak",), ("100%",), (None,)], "name string"
    )
    assert rows(match_any(names, "name", ["*token*"])) == [("a_token.bak",), ("a_token.json",)]
    assert rows(match_any(names, "name", ["*token*", "*.md"], ["*.bak"], ignore_case=True)) == [
        ("TOKEN.txt",),
        ("a_token.json",),
        ("notes.md",),
    ]
    assert rows(match_any(names, "name", ["a?token*"])) == [("a_token.bak",), ("a_token.json",)]
    assert rows(match_any(names, "name", ["*%"])) == [("100%",)]


def test_scalars(spark):
    df = spark.createDataFrame([(" a\t b  c ", "ÄBc", 2047, ["x", "Y"], "2024-01-15 09:30:00")], "t string, u string, n int, w array<string>, d string")
    null_words = F.lit(None).cast("array<string>")
    row = df.select(
        strip_all_space(F.col("t")).alias("bare"),
        squeeze(F.col("t")).alias("squeezed"),
        words_of(F.col("t")).alias("words"),
        ascii_lower(F.col("u")).alias("lower"),
        kb_to_mb(F.col("n")).alias("mb"),
        kb_to_mb(F.lit(-2047)).alias("negative"),
        append_absent(F.col("w"), F.lit("x")).alias("same"),
        append_absent(F.col("w"), F.lit("y")).alias("appended"),
        append_absent(F.col("w"), F.lit("y"), fold=True).alias("folded"),
        append_absent(null_words, F.lit("y")).alias("first"),
        append_absent(F.col("w"), F.lit(None).cast("string")).alias("nothing"),
        remove_every(F.col("w"), F.lit("x")).alias("removed"),
        remove_every(F.col("w"), F.lit(None).cast("string")).alias("kept"),
        joined(F.col("w")).alias("line"),
        joined(null_words).alias("empty"),
        blank_to(F.lit(""), F.lit("d")).alias("default"),
        F.array(*[nth_field(F.col("t"), n) for n in range(1, 5)]).alias("fields"),
        date_label(F.col("d").cast("timestamp")).alias("label"),
        F.array(*[has_value(F.lit(v).cast("string")) for v in [None, "", "null", "x"]]).alias("has"),
    ).first()
    assert row.bare == "abc" and row.squeezed == "a b c" and row.words == ["", "a", "b", "c", ""]
    assert row.lower == "Äbc" and row.mb == 1 and row.negative == -1
    assert row.same == ["x", "Y"] and row.appended == ["x", "Y", "y"] and row.folded == ["x", "Y"]
    assert row["first"] == ["y"] and row.nothing == ["x", "Y"] and row.removed == ["Y"] and row.kept == ["x", "Y"]
    assert row.line == "x Y" and row.empty == "" and row.default == "d"
    assert row.fields == ["a", "b", "c", None]
    assert row.label == "Mon 01-15 09:30" and row.has == [False, False, False, True]
