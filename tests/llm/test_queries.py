"""Every registered query on the given tables: against its SQL, or against brute force."""

import hashlib
import os
import pathlib
import subprocess
import sys
import zlib

import __spark_entry__ as contract
import corpus_pipeline
import pytest
from llm.test_hnsw import brute as brute_neighbours
from llm.test_hnsw import recall
from llm.test_pii import brute as brute_spans
from llm.test_simhash import brute_print, brute_roots
from llm.test_suffix_dedup import brute as brute_repeats
from muster.llm import pii
from muster.llm.queries import QUERIES, SQL

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in ("documents", "pages", "embeddings", "labels", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return connection


@pytest.fixture(scope="module")
def texts(tables):
    return tables.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def result(spark, name):
    return contract.queries()[name](spark, FOLDER)


def test_registered():
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())
    assert contract.queries()["pipeline"] is corpus_pipeline.run
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_copies", "decontamination", "packing"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, tables, name):
    df, cursor = result(spark, name), tables.execute(SQL[name])
    names = [column[0] for column in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(cursor.fetchall())


def test_pages(spark, tables):
    df = result(spark, "op1_html_extraction")
    assert dict(df.dtypes) == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}
    assert df.count() == tables.execute("SELECT count(*) FROM pages").fetchone()[0]


def test_toxicity(spark, texts):
    df = result(spark, "op4_toxicity")
    assert dict(df.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = {row.doc_id: row for row in df.collect()}
    assert sorted(rows) == [doc_id for doc_id, _ in texts]
    assert all(row.held_out == (zlib.crc32(str(doc_id).encode()) % 5 == 0) for doc_id, row in rows.items())
    assert all(row.predicted == (row.score >= 0.5) and 0 <= row.score <= 1 for row in rows.values())


def test_toxicity_of_held_out_documents(spark):
    """Labels that nothing was learned from: most toxic documents are caught, nearly no other is."""
    folder = "/root/testdata/sf0.01"
    scored = contract.queries()["op4_toxicity"](spark, folder).filter("held_out")
    rows = scored.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("toxic IS NOT NULL").collect()
    toxic, clean = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert len(toxic) >= 3 and len(clean) >= 50
    assert sum(score >= 0.5 for score in toxic) >= 0.8 * len(toxic)
    assert sum(score >= 0.5 for score in clean) <= 0.02 * len(clean)


def test_personal_data(spark, texts):
    rows = {row.doc_id: row for row in result(spark, "op5_pii_boosting").collect()}
    for doc_id, text in texts:
        base, row = brute_spans(text), rows[doc_id]
        spans = [f"{pii.KINDS[kind]}:{a}:{b}" for kind, a, b in base]
        assert row.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [row[f"n_{name}"] for name in pii.KINDS] == [sum(k == n for k, _, _ in base) for n in range(4)]
        assert set(spans) <= set(filter(None, row.spans.split(",")))


def test_neighbours(spark, tables):
    df = result(spark, "op6_hnsw")
    assert dict(df.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    rows = tables.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    assert recall(df, brute_neighbours(rows)) > 0.95


def test_near_duplicates(spark, texts):
    ids, prints = [doc_id for doc_id, _ in texts], [brute_print(text) for _, text in texts]
    expected = sorted(zip(ids, (f"{p:016x}" for p in prints), brute_roots(prints, ids, 4)))
    df = result(spark, "op7_simhash_bk").select("doc_id", "fingerprint", "component_id")
    assert sorted(map(tuple, df.collect())) == expected


def test_benchmark_items(spark, tables, texts):
    found = {(row.doc_id, row.item_id) for row in result(spark, "op8_decontamination").collect()}
    items = tables.execute("SELECT item_id, text FROM benchmark").fetchall()
    assert {(doc, item) for doc, text in texts for item, words in items if words in text} <= found


def test_packing(spark, texts):
    rows = result(spark, "op9_best_fit_packing").collect()
    assert {row.doc_id for row in rows} == {doc_id for doc_id, _ in texts}
    used = {}
    for row in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert row.offset == used.get(row.sequence_id, 0)
        used[row.sequence_id] = row.offset + row.length
    assert max(used.values()) <= 1024 and len(used) <= 1.03 * sum(used.values()) / 1024 + 1


def test_repeats(spark, texts):
    ids = [doc_id for doc_id, _ in texts]
    expected = [
        (doc_id, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())
        for doc_id, (n, spans, kept) in zip(ids, brute_repeats([text for _, text in texts], ids))
    ]
    df = result(spark, "op10_suffix_array").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, df.collect())) == expected


def test_pipeline(spark, texts):
    rows = result(spark, "pipeline").collect()
    assert {row.doc_id for row in rows} <= {doc_id for doc_id, _ in texts} and rows


def test_tasks_find_the_package_from_another_folder(tmp_path):
    """A session that somebody else built, in a folder from which this package cannot be imported."""
    root = pathlib.Path(contract.__file__).resolve().parent
    program = f"""
import sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__
print("ROWS", __spark_entry__.queries()["op1_html_extraction"](spark, {FOLDER!r}).count())
"""
    env = {name: value for name, value in os.environ.items() if name != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", program], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 50" in done.stdout, done.stderr[-2000:]
