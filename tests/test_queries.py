"""Every query on the given tables against its SQL."""

import os
import pathlib

import pytest

import __spark_entry__ as contract
from bindings import QUERIES, SQL

duckdb = pytest.importorskip("duckdb")

FOLDER = os.environ.get("MUSTER_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for path in pathlib.Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, oracle, name):
    result = QUERIES[name](spark, FOLDER)
    found = [tuple(row) for row in result.collect()]
    assert found
    sql = SQL.get(name)
    if sql is None:
        return
    cursor = oracle.execute(sql)
    names = [column[0] for column in cursor.description]
    assert sorted(names) == sorted(result.columns)
    assert plain(found, result.columns) == plain(cursor.fetchall(), names)


def test_entry(spark):
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())
    assert contract.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
