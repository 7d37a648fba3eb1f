import pytest
from pyspark.sql import functions as F

from muster.operators import (
    has_live_session,
    remove_packages,
    replay_commands,
    request_outcome,
    requests_missing,
    resolve_code,
    threshold_flags,
)
from muster.plans import hot

STATE = "installation_id string, kind string, package string"
REQUESTS = "installation_id string, request_seq bigint, pos int, op string, kind string, package string, install_ok boolean"


@pytest.fixture
def few_rows_per_task(monkeypatch):
    monkeypatch.setattr(hot, "ROWS_PER_TASK", 100)


def test_hot_keys(spark, few_rows_per_task):
    key = F.when(F.col("id") % 3 != 0, F.lit(-1)).otherwise(F.col("id"))
    df = spark.range(3000).select(key.alias("a"), F.lit(None).cast("string").alias("b"))
    found = hot.hot_keys(df, ["a", "b"])
    assert [row.a for row in found.table.collect()] == [-1] and (found.rows, found.limit, found.parts()) == (2000, 100, 20)
    assert hot.flagged(df, ["a", "b"], found).filter("_rows IS NOT NULL").select("a").distinct().collect()[0].a == -1
    assert hot.hot_keys(df.limit(0), ["a"]) is None
    assert hot.hot_keys(spark.range(1000), ["id"]) is None
    assert hot.hot_keys(df.limit(100), ["a"]) is None


def test_limit_follows_the_table(spark, few_rows_per_task, monkeypatch):
    monkeypatch.setattr(hot, "MAX_HOT", 10)
    df = spark.range(4000).select((F.col("id") % 20).alias("k"))
    assert hot.hot_keys(df, ["k"]) is None
    more = df.unionByName(spark.range(600).select(F.lit(3).cast("bigint").alias("k")))
    found = hot.hot_keys(more, ["k"])
    assert (found.limit, found.rows, found.table.count()) == (460, 800, 1)


def test_many_rows_in_few_bytes(spark):
    """One key, twenty million rows, next to nothing on disk: no task gets them all."""
    left = spark.range(20_000_000).select(F.lit(1).alias("k"))
    right = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    found = hot.lookup(left, right.hint("shuffle_merge"), ["k"])
    tasks = found.groupBy(F.spark_partition_id()).count().collect()
    assert sum(row["count"] for row in tasks) == 20_000_000
    assert max(row["count"] for row in tasks) <= 12_000_000


@pytest.mark.parametrize("how", ["left", "left_anti", "left_semi", "inner"])
def test_lookup_is_the_join(spark, rows, few_rows_per_task, how):
    key = F.when(F.col("id") % 4 == 0, F.lit("hot")).when(F.col("id") % 4 == 1, None).otherwise(F.col("id").cast("string"))
    left = spark.range(2000).select("id", key.alias("k"))
    right = spark.range(0, 4000, 2).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v"))
    for table in (right, right.unionByName(spark.createDataFrame([("hot", 2), (None, 3)], "k string, v int"))):
        assert hot.hot_keys(left, ["k"]).table.count() == 2
        assert rows(hot.lookup(left, table, ["k"], how)) == rows(left.join(table, ["k"], how))


def test_lookup_with_other_types(spark, rows, few_rows_per_task):
    left = spark.range(500).select(F.lit(7).alias("k"), "id")
    right = spark.createDataFrame([(7, "x")], "k bigint, v string")
    assert hot.lookup(left, right, ["k"]).filter("v = 'x'").count() == 500


def operators(spark):
    names = ["Hot", "hot", "hot", "cold", "Cold"]
    requests = spark.createDataFrame(
        [
            ("a", n, 0, "remove" if n % 7 == 0 else "add", "pip" if n % 2 else "apk", names[n % 5 if n > 900 else n % 3], True)
            for n in range(1000)
        ],
        REQUESTS,
    )
    state = spark.createDataFrame([("a", "pip", "HOT"), ("a", "apk", "cold"), ("b", "apk", "hot")], STATE)
    additions = requests.filter("op = 'add'")
    codes = spark.createDataFrame([("add", "x"), ("other", "y")], "answer string, action string")
    limits = spark.createDataFrame([("add", 500.0, "error")], "metric string, lower_limit double, severity string")
    return [
        requests_missing(additions, state),
        request_outcome(additions, state),
        remove_packages(additions, state),
        replay_commands(state, requests),
        has_live_session(requests, state.select("installation_id"), ["installation_id"]),
        resolve_code(requests, "op", codes),
        threshold_flags(requests, limits, "op", "request_seq"),
    ]


def test_operators_with_hot_keys(spark, rows, monkeypatch):
    plain = [rows(df, *sorted(df.columns)) for df in operators(spark)]
    monkeypatch.setattr(hot, "ROWS_PER_TASK", 100)
    assert [rows(df, *sorted(df.columns)) for df in operators(spark)] == plain
