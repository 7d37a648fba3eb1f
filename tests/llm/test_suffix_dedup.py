import random

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import documents
from muster.llm import suffix_dedup as s


def brute(texts, ids):
    """Spans and kept bytes, from a table of the smallest id of every string."""
    data = [(text or "").encode() for text in texts]
    order = [float("inf") if i is None else i for i in ids]
    smallest = {}
    for doc, text in zip(order, data):
        for at in range(len(text) - s.LENGTH + 1):
            string = text[at : at + s.LENGTH]
            smallest[string] = min(doc, smallest.get(string, doc))
    out = []
    for doc, text in zip(order, data):
        gone = np.zeros(len(text) + 2, bool)
        for at in range(len(text) - s.LENGTH + 1):
            if smallest[text[at : at + s.LENGTH]] < doc:
                gone[at + 1 : at + 1 + s.LENGTH] = True
        edges = np.flatnonzero(np.diff(gone.astype(int))).reshape(-1, 2).tolist()
        kept = bytes(b for b, no in zip(text, gone[1:]) if not no)
        out.append((len(text), [tuple(edge) for edge in edges], kept))
    return out


def check(spark, texts, ids, **more):
    rows = s.remove_repeats(documents(spark, texts, ids).repartition(4), **more).collect()
    found = [(r.doc_id, r.n_bytes, [tuple(span) for span in r.spans], bytes(r.kept)) for r in rows]
    expected = [(i, *row) for i, row in zip(ids, brute(texts, ids))]
    assert sorted(map(repr, found)) == sorted(map(repr, expected))
    return expected


def made(seed, n=60):
    rng = random.Random(seed)
    passage = "".join(rng.choices("abcdefgh ", k=130))
    base = ["".join(rng.choices("abcdeéß ", k=rng.randint(0, 700))) for _ in range(12)]
    texts = []
    for _ in range(n):
        text = rng.choice(base)
        kind = rng.randrange(5)
        at = rng.randint(0, len(text))
        if kind == 0:
            text = text[:at] + "X" + text[at + 1 :]
        elif kind == 1:
            a, b = sorted(rng.choices(range(131), k=2))
            text = "".join(rng.choices("uvwxyz", k=90)) + passage[a:b] + "".join(rng.choices("uvwxyz", k=90))
        elif kind == 2:
            text = rng.choice(base)[:at] + text[at:]
        elif kind == 3:
            text = "ab" * rng.randint(20, 300)
        texts.append(text)
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    texts = made(seed)
    ids = list(range(len(texts)))
    random.Random(seed).shuffle(ids)
    expected = check(spark, texts, ids, batch_bytes=5000)
    assert sum(bool(row[2]) for row in expected) > 10


def test_hot_anchors_are_split_without_loss(spark):
    texts = made(4)
    check(spark, texts, list(range(len(texts))), batch_bytes=2000, hot=1)


def test_hot_is_counted_by_pieces(spark):
    """One batch holds all texts, so batches alone could not tell that an anchor has many surroundings."""
    rng = random.Random(8)
    run = "the same twenty bytes"
    texts = ["".join(rng.choices("qrstuv", k=45)) + run + "".join(rng.choices("qrstuv", k=45)) for _ in range(300)]
    texts += rng.sample(texts, 40)
    data = [text.encode() for text in texts]
    sizes = np.array([len(text) for text in data], np.int64).tobytes()
    ids = np.arange(len(data), dtype=np.int64).tobytes()
    batch = s.Batch({"ids": ids, "sizes": sizes, "bytes": 1, "texts": zstandard.compress(b"".join(data))})
    pieces = {batch.text[a : b + s.LENGTH] for a, b in zip(batch.first, batch.last)}
    assert len(set(batch.piece_hashes().tolist())) == len(pieces)
    for hot in (0, 3, 100):
        check(spark, texts + [text + "!" for text in texts[:50]], list(range(len(texts) + 50)), hot=hot)


def test_odd_rows(spark, odd_texts):
    texts = odd_texts + odd_texts[-20:] + ["y" * 30_000, "y" * 20_000, "yz" * 10_000, "z" + "y" * 49, "y" * 50, "y" * 49]
    check(spark, texts, list(range(len(texts))))
    check(spark, texts, [None if k % 6 == 0 else k % 11 for k in range(len(texts))])
    assert s.remove_repeats(documents(spark, [])).count() == 0
    assert s.remove_repeats(documents(spark, [None, ""])).count() == 2


def brute_repeats(pieces, least):
    """Maximal repeats by trying every string."""
    joined = b"\xff".join(pieces) + b"\xff"
    places = {}
    for a in range(len(joined)):
        for b in range(a + least, len(joined) + 1):
            if b"\xff" in joined[a:b]:
                break
            places.setdefault(joined[a:b], []).append(a)
    out = set()
    for string, found in places.items():
        left = {joined[a - 1] if a and joined[a - 1] != 255 else -a - 1 for a in found}
        right = {joined[a + len(string)] if joined[a + len(string)] != 255 else -a - 1 for a in found}
        if len(found) > 1 and len(left) > 1 and len(right) > 1:
            out.add((len(string), tuple(found)))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", max_size=14), min_size=1, max_size=6), st.integers(1, 4))
def test_maximal_repeats(texts, least):
    pieces = [text.encode() for text in texts]
    found = {(length, tuple(sorted(places.tolist()))) for length, places in s.maximal_repeats(pieces, least)}
    assert found == brute_repeats(pieces, least)


def test_equal_strings_have_equal_anchors():
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 101, 400, np.uint8))
    hashes = s.sliding_minimum(s.run_hashes(text), s.LENGTH - s.RUN + 1)
    alone = [
        s.sliding_minimum(s.run_hashes(text[k : k + s.LENGTH]), s.LENGTH - s.RUN + 1)
        for k in range(len(text) - s.LENGTH + 1)
    ]
    assert all(len(one) == 1 for one in alone) and (np.concatenate(alone) == hashes).all()
