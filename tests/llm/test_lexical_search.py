import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm.conftest import documents
from muster.llm import lexical_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, best=10):
    bags = [(doc_id, Counter(terms(text))) for doc_id, text in docs if terms(text)]
    total, length = len(bags), sum(bag.total() for _, bag in bags)
    wanted = defaultdict(set)
    for item, text in items:
        if item is not None:
            wanted[item].update(terms(text))
    df = Counter(term for _, bag in bags for term in bag)
    out = []
    for item, words in wanted.items():
        rows = []
        for doc_id, bag in bags:
            m = 10 + 90 * bag.total() * total // length
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
                for t in words
                if t in bag
            )
            if score > 0 and doc_id is not None:
                rows.append((-score, doc_id))
        out += [(item, rank, doc_id, -score) for rank, (score, doc_id) in enumerate(sorted(rows)[:best], 1)]
    return sorted(out)


def found(df):
    assert dict(df.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    words = ["the", "Of", "and", "zeta", "déjà", "x1", "naïve", "é", "rare", "中文", "one", "two", "three"] + [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(len(words))]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(1, 40))) for _ in range(150)]
    # Copies, other orders of the same words, and other words than the items have.
    texts += [texts[3]] * 40 + [" ".join(rng.sample(text.split(), len(text.split()))) for text in texts[:30]]
    texts += [texts[5] + " unheard" + str(k) for k in range(20)] + [None, "", "-- !", "THE the The", "a\x00b", "the\x7fof"]
    docs = [(None if k % 41 == 0 else (k * 7) % 400, text) for k, text in enumerate(texts)] + [(11, "the one")] * 3
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for k in range(25)]
    items += [(3, "another text of item three zeta"), (None, "the one"), (90, None), (91, ""), (92, "nothing like it"), (93, "THE?one")]
    return docs, items


def frames(spark, docs, items):
    ids, texts = [doc_id for doc_id, _ in docs], [text for _, text in docs]
    made = documents(spark, texts, ids).withColumnRenamed("print", "score").withColumnRenamed("key", "Rank")
    return made.repartition(5), spark.createDataFrame(items, "item_id long, text string")


def test_against_brute_force(spark, corpus):
    docs, items = corpus
    df, asked = frames(spark, docs, items)
    expected = brute(docs, items)
    assert found(lexical_search.rank_documents(df, asked)) == expected
    assert found(lexical_search.rank_documents(df, asked, best=3)) == brute(docs, items, 3)


def test_blocks_slices_and_steps_change_nothing(spark, corpus, monkeypatch):
    docs, items = corpus
    df, asked = frames(spark, docs, items)
    monkeypatch.setattr(lexical_search, "SLICE", 5)
    assert found(lexical_search.rank_documents(df, asked, block_words=40)) == brute(docs, items)


def test_scores_exactly_with_few_cells(monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(int(item), b"w%d" % word) for item in range(20) for word in set(rng.geometric(0.1, 12).tolist())]
    for cells, places in ((1 << 20, 1 << 20), (30, 7), (0, 1)):
        monkeypatch.setattr(lexical_search, "CELLS", cells)
        monkeypatch.setattr(lexical_search, "PLACES", places)
        block = lexical_search.Block(rows)
        weights = np.arange(1, len(block.vocabulary) + 1) * 997
        scorer = lexical_search.Scorer(block, weights)
        bags, measures, expected = [], [], []
        for _ in range(15):
            chosen = sorted(rng.choice(len(weights), rng.integers(0, 9), replace=False).tolist())
            bag, m = [(k, int(rng.integers(1, 50))) for k in chosen], int(rng.integers(10, 2000))
            bags.append(np.array(bag, "<i4").tobytes())
            measures.append(m)
            gains = {k: int(weights[k]) * (10**9 * tf // (1000 * tf + 8 * m)) for k, tf in bag}
            names = {k: term for term, k in block.vocabulary.items()}
            expected.append([sum(g for k, g in gains.items() if (int(item), names[k]) in set(rows)) for item in block.items])
        assert scorer.score(bags, np.array(measures)).tolist() == expected


def test_leaders_keep_the_best():
    rng = np.random.default_rng(4)
    leaders, every = lexical_search.Leaders(3, 4), []
    for step in range(30):
        scores = rng.integers(0, 12, (rng.integers(0, 90), 3))
        firsts = rng.permutation(10_000)[: len(scores)]
        classes = np.arange(len(scores)) + 1000 * step
        leaders.offer(scores, firsts, classes)
        every += [(i, -s, f, c) for row, f, c in zip(scores.tolist(), firsts.tolist(), classes.tolist()) for i, s in enumerate(row) if s]
    expected = [row for item in range(3) for row in sorted(r for r in every if r[0] == item)[:4]]
    assert [(i, -s, f, c) for i, s, f, c in leaders.rows.T.tolist()] == expected


def test_empty_tables(spark, corpus):
    docs, items = corpus
    df, asked = frames(spark, docs, items)
    assert found(lexical_search.rank_documents(df.limit(0), asked)) == []
    assert found(lexical_search.rank_documents(df, asked.limit(0))) == []
    assert found(lexical_search.rank_documents(df.filter("text IS NULL"), asked)) == []
