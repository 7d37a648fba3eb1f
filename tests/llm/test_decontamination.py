import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import documents
from muster.llm import decontamination as d


def item_table(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def brute(texts, items):
    """Every item against every passage of as many words as its class has, at every place."""
    out = []
    for text in texts:
        words, found = d.words_of(text or ""), []
        for item in map(lambda row: d.Item(*row), sorted(items)):
            if item.words:
                width = 2 * len(item.words)
                places = range(max(1, len(words) - width + 1))
                if any(d.holds(item.overlaps(words[k : k + width])) for k in places) and words:
                    found.append(item.item_id)
        out.append(found)
    return out


def made(seed=1):
    rng = random.Random(seed)
    common = ["the", "of", "and", "to", "in"]

    def words(n):
        return [rng.choice(common) if rng.random() < 0.5 else "".join(rng.choices("abcdeost", k=rng.randint(2, 6))) for _ in range(n)]

    items = [(k, " ".join(words(rng.randint(12, 60))).capitalize() + ". " + " ".join(words(6)) + ".") for k in range(60)]
    items += [(100, "What is the colour of the sky at noon? Blue, they say.")]
    texts = []
    for k in range(80):
        body = words(rng.randint(0, 400))
        if k % 2:
            copy = rng.choice(items)[1]
            if k % 4 == 3:
                copy = copy.upper().replace(".", " !")
            at = rng.randint(0, len(body))
            body[at:at] = copy.split()
        texts.append(" ".join(body))
    return items, texts


def test_against_brute_force(spark, odd_texts):
    items, texts = made()
    texts += odd_texts + ["What is the COLOUR of the sky, at noon? ... blue they say", "what is the colour of the sky"]
    df = documents(spark, texts).selectExpr("*", "'x' AS items").repartition(4)
    rows = {r.key: [m.item_id for m in r["items"]] for r in d.with_items(df, item_table(spark, items)).collect()}
    expected = brute(texts, items)
    assert [rows[k] for k in range(len(texts))] == expected
    assert sum(map(bool, expected)) >= 41
    parted = d.with_items(df, item_table(spark, items), index_bytes=4000)
    assert {r.key: [m.item_id for m in r["items"]] for r in parted.collect()} == rows


def test_parts_change_neither_items_nor_scores(spark):
    """Passages that hold a part of an item: what is near the threshold is found alike, with equal scores."""
    items, _ = made(4)
    rng = random.Random(5)
    texts = []
    for _ in range(300):
        words = rng.choice(items)[1].split()
        kept = [word for word in words if rng.random() < rng.choice([0.75, 0.85, 0.95])]
        other = rng.choice(items)[1].split()
        texts.append(" ".join([*other[: rng.randint(0, 30)], *kept, *rng.choice(items)[1].split()[: rng.randint(0, 90)]]))
    df = documents(spark, texts).select("doc_id", "text").repartition(3)
    whole, parted = (
        {r.doc_id: [tuple(m) for m in r["items"]] for r in d.with_items(df, item_table(spark, items), index_bytes=size).collect()}
        for size in (d.INDEX_BYTES, 3000)
    )
    assert parted == whole and 20 < sum(map(bool, whole.values())) < 300


def test_odd_items(spark):
    items = [(1, None), (2, ""), (None, "one two three four five"), (3, " . "), (4, "Zebra quagga"), (5, "b"), (5, "a"), (5, "a")]
    texts = ["one two three four five", "a zebra, quagga!", "zebra a quagga", None, "b"]
    rows = d.with_items(documents(spark, texts), item_table(spark, items)).collect()
    found = {r.key: [m.item_id for m in r["items"]] for r in rows}
    assert found == {0: [], 1: [4, 5], 2: [5], 3: [], 4: []}
    assert d.with_items(documents(spark, texts), item_table(spark, [])).count() == 5
    assert d.with_items(documents(spark, []), item_table(spark, items)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=8), min_size=1, max_size=40),
       st.sets(st.sampled_from("abcdefgh")), st.sampled_from([0.2, 0.5, 0.9]))
def test_search_finds_all_above(items, terms, least):
    block, d.BLOCK = d.BLOCK, 3
    try:
        index = d.Index([(k, " ".join(words)) for k, words in enumerate(items)])
        numbers = {index.vocabulary[t] for t in terms if t in index.vocabulary}
        scores = {}
        for t in numbers:
            for at, weight in zip(*index.postings[t]):
                scores[at] = scores.get(at, 0) + weight
        expected = {at for at, score in scores.items() if score >= least - 1e-9}
        assert {at for at, _ in index.search(numbers, least)} == expected
    finally:
        d.BLOCK = block


def test_given_benchmark(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = d.with_items(docs, items).collect()
    texts = {r.item_id: r.text for r in items.collect()}
    for row in rows:
        found = {m.item_id for m in row["items"]}
        assert {i for i, text in texts.items() if text in row.text} <= found


@pytest.mark.parametrize("text, parts", [("A b? C.", (["a", "b"], ["c"])), ("A b. C d.", (["a", "b"], ["c", "d"])), ("A b", (["a", "b"], []))])
def test_question_and_answer(text, parts):
    assert d.question_and_answer(text) == parts
