import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import documents
from muster.llm import toxicity

FOLDER = "/root/testdata/sf0.01"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def brute(word, terms):
    found = [0.0]
    for term, weight in terms.items():
        most, stem = toxicity.allowed_errors(term), term.rstrip("*")
        ends = range(1, len(word)) if term.endswith("*") else [len(word)]
        found += [weight * toxicity.FUZZY_WEIGHT[d] for n in ends if (d := distance(word[:n], stem)) <= most]
    return max(found)


@settings(max_examples=300, deadline=None)
@given(st.text("abcde", min_size=1, max_size=12))
def test_matcher(word):
    names = ["abcde", "ab", "abcdeabcd", "eddca", "cab*", "bcdeabca*", "aaaaa"]
    terms = {name: 1 - k / 10 for k, name in enumerate(names)}
    matcher = toxicity.Matcher(terms)
    assert matcher.weight(word) == brute(word, terms) == matcher.weight(word)


def test_misspelled_terms():
    matcher = toxicity.Matcher({"stupid": 1.0, "worthless": 1.0, "lowei*": 0.4})
    words = ("stupid", "st*pid", "stuupid", "stpuid", "wortless", "worhtless", "loweiung", "lowei", "low")
    assert [matcher.weight(word) for word in words] == [1.0, 0.5, 0.5, 0, 0.5, 0.35, 0.4, 0, 0]


def test_windows_and_quotation():
    matcher, none = toxicity.Matcher({"stupid": 1.0, "clown": 1.0}), frozenset()
    near = toxicity.features("you stupid clown", matcher, none)
    far = toxicity.features("stupid " + "word " * 60 + "clown", matcher, none)
    cited = toxicity.features('he wrote "you stupid clown" there', matcher, none)
    assert near[:2] == (2.0, 2.0) and far[:2] == (1.0, 2.0) and cited[0] < 1
    assert toxicity.features("> stupid", matcher, none)[0] < 1
    assert toxicity.features("", matcher, none) == (0.0,) * 4


def sample(spark, n=300):
    rng = random.Random(1)
    texts, marks = [], []
    for k in range(n):
        words = ["".join(rng.choices("aeiounrst", k=rng.randint(2, 7))) for _ in range(40)]
        if k % 4 == 0:
            words[5:5] = rng.choices(["gribble", "snorfak", "blatt"], k=3)
        texts.append(" ".join(words))
        marks.append(int(k % 4 == 0))
    labels = spark.createDataFrame([(k, m) for k, m in enumerate(marks)], "doc_id long, toxic int")
    return texts, labels


def test_learned_from_labels_and_odd_rows(spark, odd_texts):
    texts, labels = sample(spark)
    model = toxicity.learn(documents(spark, texts), labels)
    assert {"gribble", "snorfak"} <= set(model.terms)
    new = ["so gribble and snorfek here", "nothing of it", 'a "gribble" cited', *odd_texts]
    df = documents(spark, new, [None, 1, 1] + list(range(len(odd_texts)))).selectExpr("*", "'x' AS score")
    rows = toxicity.score(df, model).collect()
    by_key = {row.key: row.score for row in rows}
    assert by_key[0] >= 0.5 > max(score for key, score in by_key.items() if key)
    assert all(0 <= score <= 1 for score in by_key.values()) and len(rows) == len(new)
    assert toxicity.score(documents(spark, []), model).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, None), (2, 0), (2, 0), (None, 1)]])
def test_few_labels(spark, labels):
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(documents(spark, ["a b", None, "c"], [1, 2, 3]), known)
    assert 0 < model.score((0.0,) * 4) < 1


def test_held_out_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    counts = toxicity.held_out_accuracy(toxicity.score(docs, toxicity.learn(docs, labels)), labels)
    assert counts["right"] >= 0.97 * sum(counts.values())


def test_labels_of_held_out_rows_do_not_matter(spark):
    texts, labels = sample(spark)
    docs = documents(spark, texts)
    turned = labels.withColumn("toxic", (1 - labels.toxic).cast("int"))
    held = toxicity.is_held_out("doc_id")
    other = labels.filter(~held).unionByName(turned.filter(held))
    assert np.allclose(toxicity.learn(docs, labels).weights, toxicity.learn(docs, other).weights)


def test_quotations_of_whole_lines():
    matcher, filler = toxicity.Matcher({"stupid": 1.0}), "word " * 100

    def strong(text):
        return round(toxicity.features(text, matcher, frozenset())[1], 6)

    for left, right in ('""', "“”", "«»", "„“", "‘’"):
        assert strong(f"he wrote {left}{filler}stupid {filler}end{right} there") == 0.3
        assert strong(f"{left}{filler}end{right} so stupid {left}{filler}end{right}") == 1.0
        assert strong(f"he wrote {left}{filler}stupid {filler}") == 1.0
        assert strong(f"{left}{filler}\nstupid{right} x\n{left}stupid{right}\nstupid") == 2.3
    assert strong(f'"cited" {"x" * 180} stupid {filler} "cited" {filler}') == 1.0
    assert strong(f'a 5" pipe, stupid, "cited" and stupid "stupid"') == 2.3
    assert strong("‘you don’t be stupid’ “a “b” stupid” stupid") == 1.6
    assert strong(f"> {filler}stupid\nİ stupid «stupid»") == 1.6
    many = '"stupid" stupid ' * 20_000
    assert strong(many) == 26_000
