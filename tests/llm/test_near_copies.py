import random

import pytest
from llm.conftest import documents
from llm.test_simhash import re_split
from muster.llm import near_copies


def runs(text, words=5):
    parts = re_split(text or "")
    return frozenset(tuple(parts[k : k + words]) for k in range(max(1, len(parts) - words + 1))) if parts else frozenset()


def brute(texts, ids, least=0.8):
    """Places of the rows that stay, of ids that differ."""
    sets, root = [runs(text) for text in texts], list(range(len(texts)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x == y or len(x & y) >= least * len(x | y):
                root[top(a)] = top(b)
    best = {}
    for k in range(len(texts)):
        group, value = top(k), float("inf") if ids[k] is None else ids[k]
        best[group] = min(best.get(group, (value, k)), (value, k))
    return sorted(k for _, k in best.values())


def made(seed, n=160):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeost", k=rng.randint(2, 6))) for _ in range(500)]
    base = [rng.choices(vocabulary, k=rng.randint(30, 300)) for _ in range(12)]
    texts = []
    for _ in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8, 30])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words).capitalize() if rng.random() < 0.3 else " ".join(words))
    return texts + [" ".join(rng.choices(vocabulary, k=50)) for _ in range(30)]


@pytest.mark.parametrize("limit", [2048, 12])
def test_against_brute_force(spark, odd_texts, limit):
    texts = made(1) + odd_texts
    ids = list(range(len(texts)))
    random.Random(2).shuffle(ids)
    df = documents(spark, texts, ids).repartition(4)
    result = near_copies.one_of_each(df, limit=limit)
    assert result.columns == df.columns
    assert sorted(row.key for row in result.collect()) == brute(texts, ids)


def test_repeated_and_missing_ids(spark):
    long = " ".join(f"w{k}" for k in range(100))
    rows = [(1, long), (1, long), (2, long + " end"), (None, "other words are here now"), (None, None), (3, ""), (4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' AS _key", "1 AS node")
    found = near_copies.one_of_each(df).collect()
    assert sorted((row.doc_id, row.text) for row in found if row.doc_id) == [(1, long), (3, ""), (4, "x")]
    assert [row.text for row in found if row.doc_id is None] == ["other words are here now"]
    assert near_copies.one_of_each(df.limit(0)).count() == 0


def test_single_pairs(spark):
    """Pairs alone, with no third text to link them: lines repeated in one of two, and similarities from 0.8 to 0.85."""
    rng, texts, groups = random.Random(4), [], []

    def words(k, n):
        return [f"p{k}w{rng.randrange(10**9)}" for _ in range(n)]

    for k in range(60):
        shared = words(k, 104)
        line = shared[:20]
        pair = (shared + words(k, 1), shared + line * 60) if k % 2 else (shared, shared + line[:10] * 10)
        groups += [k, k]
        texts += [" ".join(one) for one in pair]
    for k in range(60, 660):
        # 104 words are 100 runs of five; n more words on each side are n more runs on each.
        shared, n = words(k, 104), rng.randint(9, 12)
        groups += [k, k]
        texts += [" ".join(shared + words(k, n)) for _ in range(2)]
    sets = [runs(text) for text in texts]
    assert all(len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets[::2], sets[1::2]))
    left = near_copies.one_of_each(documents(spark, texts).repartition(4)).collect()
    lost = [groups[row.doc_id] for row in left if row.doc_id % 2]
    assert not [k for k in lost if k < 60] and len(lost) <= 2
