import pytest
from pyspark.sql import functions as F

from muster.operators import (
    apply_requests,
    remove_packages,
    remove_stored,
    request_outcome,
    requests_missing,
    store_packages,
    stored_packages,
)

STATE = "installation_id string, kind string, package string"
REQUESTS = "installation_id string, kind string, package string, request_seq bigint, pos int"
PACKAGES = [("a", "pip", "Requests"), ("a", "pip", "requests"), ("a", "apk", "vim"), ("b", "pip", "x"), ("b", "apk", "vim")]
WANTED = [("a", "pip", "REQUESTS", 1, 0), ("a", "apk", "VIM", 2, 0), ("b", "pip", "y", 3, 0), ("b", "pip", "Y", 4, 0), (None, "apk", "z", 5, 0)]


@pytest.fixture
def path(spark, tmp_path):
    state = spark.createDataFrame(PACKAGES, STATE)
    store_packages(state, str(tmp_path / "state"), 1)
    return str(tmp_path / "state")


def test_versions(spark, path, rows):
    assert rows(stored_packages(spark, path).drop("_match")) == sorted(PACKAGES)
    store_packages(stored_packages(spark, path).filter("kind = 'apk'"), path, 2, buckets=16)
    assert stored_packages(spark, path).count() == 2 and stored_packages(spark, path, 1).count() == 5
    with pytest.raises(FileExistsError):
        store_packages(stored_packages(spark, path), path, 2)
    with pytest.raises(FileNotFoundError):
        stored_packages(spark, path, 7)
    none = stored_packages(spark, path + "-nowhere", schema=STATE)
    assert none.count() == 0 and none.columns[-1] == "_match"


def test_what_a_failed_write_left_is_replaced(spark, path, tmp_path, rows):
    (tmp_path / "state" / "buckets=8" / "version=1" / "_SUCCESS").unlink()
    store_packages(spark.createDataFrame(PACKAGES[:1], STATE), path, 1)
    assert rows(stored_packages(spark, path).drop("_match")) == PACKAGES[:1]


def test_requests_on_stored_packages(spark, path, rows):
    stored, plain = stored_packages(spark, path), spark.createDataFrame(PACKAGES, STATE)
    requests = spark.createDataFrame(WANTED, REQUESTS)
    assert rows(requests_missing(requests, stored)) == rows(requests_missing(requests, plain))
    assert rows(request_outcome(requests, stored)) == rows(request_outcome(requests, plain))
    columns = ["installation_id", "kind", "package"]
    assert rows(apply_requests(stored, requests), *columns) == rows(apply_requests(plain, requests), *columns)
    removals = spark.createDataFrame([("a", "pip", "requests"), ("a", "pip", "REQUESTS"), ("b", "apk", "vim"), ("c", "apk", "vim")], STATE)
    assert rows(remove_stored(stored, removals), *columns) == rows(remove_packages(plain, removals), *columns)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("operation", ["missing", "outcome", "applied", "removed"])
def test_stored_packages_are_not_shuffled(spark, path, operation):
    """Only what comes to the state has an exchange; the state is scanned by buckets."""
    stored, requests = stored_packages(spark, path), spark.createDataFrame(WANTED, REQUESTS)
    # Large enough not to be sent to every task.
    requests = requests.crossJoin(spark.range(5)).drop("id").withColumn("package", F.concat("package", F.rand().cast("string")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = {
            "missing": lambda: requests_missing(requests, stored),
            "outcome": lambda: request_outcome(requests, stored),
            "applied": lambda: apply_requests(stored, requests),
            "removed": lambda: remove_stored(stored, requests.drop("request_seq", "pos")),
        }[operation]()
        lines = plan_of(made).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scans = [k for k, line in enumerate(lines) if "FileScan parquet" in line]
    joined = [k for k in scans if "Bucketed: true" in lines[k]]
    assert joined
    for at in joined:
        depth = len(lines[at]) - len(lines[at].lstrip(" +-:"))
        above = depth
        for line in reversed(lines[:at]):
            here = len(line) - len(line.lstrip(" +-:"))
            if here < above:
                above = here
                assert "Exchange" not in line, line
