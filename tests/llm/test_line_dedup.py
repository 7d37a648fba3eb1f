from collections import Counter

import numpy as np
from llm.conftest import documents
from muster.llm import line_dedup


def brute(texts, least):
    split = [(text or "").split("\n") for text in texts]

    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    seen = Counter(k for lines in split for k in {key(line) for line in lines} if k)
    kept = [[line for line in lines if seen[key(line)] < least] for lines in split]
    return [("\n".join(k), len(lines), len(lines) - len(k)) for k, lines in zip(kept, split)]


def found(df):
    return sorted((r.key, r.text, r.n_lines, r.n_dropped) for r in df.collect())


def expected(texts, least=10):
    return [(i, *row) for i, row in enumerate(brute(texts, least))]


def test_against_brute_force(spark, odd_texts):
    df = documents(spark, odd_texts, [None if k % 5 == 0 else k % 7 for k in range(len(odd_texts))]).repartition(4)
    result = line_dedup.drop_frequent_lines(df)
    assert result.columns == [*df.columns, "n_lines", "n_dropped"]
    assert found(result) == expected(odd_texts)
    assert found(line_dedup.drop_frequent_lines(df, 2)) == expected(odd_texts, 2)


def test_join_gives_the_same(spark, odd_texts, monkeypatch):
    df = documents(spark, odd_texts).repartition(3)
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    assert found(line_dedup.drop_frequent_lines(df)) == expected(odd_texts)


def test_most_frequent_are_broadcast_and_others_joined(spark, monkeypatch):
    texts = ["often\nRare one \nkeep %d" % k if k < 12 else "often\n\n other\nkeep %d\noften" % k for k in range(60)]
    texts += texts[:3] + [None, ""]
    df = documents(spark, texts).repartition(3)
    # 69 bytes for the commonest key, and as much for "other".
    for room in (0, 69, 140, 1000):
        monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", room)
        assert found(line_dedup.drop_frequent_lines(df)) == expected(texts)


def test_ranges_of_keys_give_the_same(spark, odd_texts, monkeypatch):
    monkeypatch.setattr(line_dedup, "LEAST_BITS", 1000)
    monkeypatch.setattr(line_dedup, "MAX_BITS", 2 * line_dedup.BLOCK_BITS)
    texts = [f"line {k}\nline {k // 12}\nshared" for k in range(1000)] + odd_texts
    assert found(line_dedup.drop_frequent_lines(documents(spark, texts).repartition(3))) == expected(texts)


def test_full_filter_loses_nothing(spark, odd_texts, monkeypatch):
    monkeypatch.setattr(line_dedup, "MAX_BITS", line_dedup.BLOCK_BITS)
    monkeypatch.setattr(line_dedup, "filter_bits", lambda lines: line_dedup.BLOCK_BITS)
    texts = [f"line {k}\nshared" for k in range(3000)] + odd_texts
    assert found(line_dedup.drop_frequent_lines(documents(spark, texts).repartition(5))) == expected(texts)


def test_empty_table_and_clashing_columns(spark):
    assert line_dedup.drop_frequent_lines(documents(spark, [])).count() == 0
    df = documents(spark, ["a\nb"]).selectExpr("*", "'x' AS n_lines", "1 AS n_dropped")
    row = line_dedup.drop_frequent_lines(df).first()
    assert (row.n_lines, row.n_dropped, row.text) == (2, 0, "a\nb")


def test_filter_has_no_false_negatives():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 5000).astype(np.uint64)
    bits = line_dedup.filter_bits(5000)
    twice = np.zeros(bits // 8, np.uint8)
    for at in line_dedup.places(hashes, bits):
        np.bitwise_or.at(twice, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    assert line_dedup.suspected(twice, hashes).all()
    assert line_dedup.suspected(twice, rng.integers(0, 2**63, 5000).astype(np.uint64)).mean() < 0.1
