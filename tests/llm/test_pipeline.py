import random

import corpus_pipeline
import public_tokenizers
import pytest
from llm.conftest import documents
from llm.test_line_dedup import brute as brute_lines
from llm.test_near_copies import brute as brute_copies
from tokenizers import Tokenizer

INSULTS = ["gribble", "snorfak", "blatt"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with planted copies, shared lines, benchmark items and toxic documents."""
    path = tmp_path_factory.mktemp("tables")
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("aeinorstl", k=rng.randint(3, 8))) for _ in range(3000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=30))) for k in range(10)]
    texts, kinds = [], []
    for k in range(400):
        words, kind = rng.choices(vocabulary, k=rng.randint(60, 200)), "clean"
        if k % 7 == 3:
            kind = "toxic"
            words[9:9] = rng.choices(INSULTS, k=4)
        elif k % 11 == 5:
            kind = "leak"
            words[20:20] = rng.choice(items)[1].split()
        text = " ".join(words)
        if k % 13 == 7:
            kind, text = "copy", texts[0] + " tail"
        if k % 4 == 0:
            text += "\nall rights belong to somebody"
        texts.append(text)
        kinds.append(kind)
    documents(spark, texts).drop("key", "print").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(k, 1, int(kind == "toxic")) for k, kind in enumerate(kinds) if k % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), texts, kinds


def test_stages(spark, folder):
    path, texts, kinds = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {row.doc_id: row.text for row in docs.collect()}
        docs = stage(spark, docs, path)
        assert docs.columns == columns
        after = {row.doc_id: row.text for row in docs.collect()}
        ids = sorted(before)
        if name == "toxicity":
            assert set(before) - set(after) == {k for k in before if kinds[k] == "toxic"}
        elif name == "line_dedup":
            kept = brute_lines([before[i] for i in ids], 10)
            assert after == {i: row[0] for i, row in zip(ids, kept)}
            assert all(row.n_chars == len(row.text) for row in docs.collect())
        elif name == "near_copies":
            assert sorted(after) == [ids[k] for k in brute_copies([before[i] for i in ids], ids)]
        elif name == "decontamination":
            assert set(before) - set(after) == {k for k in before if kinds[k] == "leak"}
        docs = spark.createDataFrame(docs.collect(), docs.schema)


def test_run(spark, folder):
    path, texts, kinds = folder
    rows = corpus_pipeline.run(spark, path).collect()
    clean = [k for k, kind in enumerate(kinds) if kind == "clean"]
    assert sorted({row.doc_id for row in rows}) == clean
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mild = [k for k, kind in enumerate(kinds) if kind != "toxic"]
    kept = dict(zip(mild, brute_lines([texts[k] for k in mild], 10)))
    total = {k: len(coder.encode(kept[k][0], add_special_tokens=False).ids) + 1 for k in clean}
    assert sum(row.length for row in rows) == sum(total.values())


@pytest.mark.parametrize("rows", [0, 1])
def test_small_tables(spark, tmp_path, rows):
    documents(spark, ["a text"] * rows).drop("key", "print").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == rows


def test_clashing_columns_keep_their_values(spark, tmp_path):
    extra = "_score score _n_lines n_lines n_dropped _items items _row row _id _first node print _digest _drop title.x".split()
    rng = random.Random(5)
    texts = [" ".join(rng.choices("one two three four five six seven eight nine".split(), k=60)) for _ in range(12)]
    docs = documents(spark, texts).drop("key", "print").selectExpr("*", *[f"concat('{name}', doc_id) AS `{name}`" for name in extra])
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    expected = sorted(map(tuple, docs.collect()))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns
        assert [row[:3] + row[5:] for row in sorted(map(tuple, kept.collect()))] == [row[:3] + row[5:] for row in expected]
    assert corpus_pipeline.pack(spark, docs, str(tmp_path)).count() == 12


def test_odd_rows(spark, odd_texts, tmp_path):
    ids = [None if k % 9 == 0 else k // 2 for k in range(len(odd_texts))]
    documents(spark, odd_texts, ids).drop("print").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, "x"), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
