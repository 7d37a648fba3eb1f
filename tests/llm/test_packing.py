import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import documents
from muster.llm import packing, queries
from tokenizers import Tokenizer

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def pack(df, **more):
    return packing.pack_documents(df, RANKS, public_tokenizers.PATTERN, **more)


def check_sequences(rows, capacity):
    spans = defaultdict(list)
    for row in rows:
        spans[row.sequence_id].append((row.offset, row.length))
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(spans)


def test_against_the_other_library(spark, odd_texts):
    texts = odd_texts + ["<|endoftext|> a", "tail " * 3000, " " * 20_000, "é" * 5000]
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    expected = []
    for k, text in enumerate(texts):
        ids = np.array(other.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) % 1024 or 1024
        bounds = [0, *range(first, len(ids), 1024), len(ids)]
        for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
            expected.append((k, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    rows = pack(documents(spark, texts).repartition(5)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    check_sequences(rows, 1024)


def test_repeated_and_missing_ids(spark):
    rows = pack(documents(spark, ["a b", "a b", None, "c"], [1, 1, None, None])).collect()
    assert len(rows) == 4 and check_sequences(rows, 1024) == 1
    assert pack(documents(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), max_size=15))
def test_plan_places_each_rank_once(counts):
    segments = packing.plan(counts, 40)
    spans, used = defaultdict(list), Counter()
    for length, rows in segments.items():
        ends = [row[0] for row in rows[1:]] + [counts[length]]
        assert rows[0][0] == 0
        for (low, first, offset), high in zip(rows, ends):
            assert low < high
            for rank in range(low, high):
                spans[first + rank - low].append((offset, length))
                used[length] += 1
    assert used == Counter(counts)
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 40
        assert sum(3 * length > 40 for _, length in parts) <= 2
    assert sorted(spans) == list(range(len(spans)))


def test_few_sequences():
    rng = random.Random(3)
    lengths = Counter(min(1024, int(rng.lognormvariate(5.8, 1.1)) + 1) for _ in range(20_000))
    segments = packing.plan(lengths, 1024)
    n = 1 + max(
        first + high - low - 1
        for length, rows in segments.items()
        for (low, first, _), high in zip(rows, [row[0] for row in rows[1:]] + [lengths[length]])
    )
    assert n <= 1.01 * sum(length * count for length, count in lengths.items()) / 1024 + 1


@pytest.mark.parametrize("length, sizes", [(1, [1]), (1024, [1024]), (1025, [1, 1024]), (2500, [452, 1024, 1024])])
def test_cut(length, sizes):
    assert [size for _, size in packing.cut(length, 1024)] == sizes


@pytest.mark.parametrize("made", [queries.op9_best_fit_packing, corpus_pipeline.pack])
def test_special_tokens_as_the_vocabulary_has_them(spark, tmp_path, odd_texts, made):
    marked = ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>  \n<|endoftext|", "é <|endoftext|>\t x " * 700]
    texts = odd_texts + marked + ["<|EndOfText|> <|fim_prefix|>"]
    docs = documents(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert other.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    expected = []
    for k, text in enumerate(texts):
        ids = np.array(other.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        for piece, (a, n) in enumerate(packing.cut(len(ids), 1024)):
            expected.append((k, piece, a, n, zlib.crc32(ids[a : a + n].tobytes())))
    rows = (made(spark, docs, str(tmp_path)) if made is corpus_pipeline.pack else made(spark, str(tmp_path))).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected


def fewest(lengths, capacity):
    """The least number of sequences, by trying all assignments that differ."""
    best = len(lengths)
    lengths = sorted(lengths, reverse=True)

    def place(at, rooms):
        nonlocal best
        if len(rooms) >= best and (at < len(lengths) or len(rooms) > best):
            return
        if at == len(lengths):
            best = min(best, len(rooms))
            return
        for k, room in enumerate(rooms):
            if room >= lengths[at] and room not in rooms[:k]:
                place(at + 1, [*rooms[:k], room - lengths[at], *rooms[k + 1 :]])
        place(at + 1, [*rooms, capacity - lengths[at]])

    place(0, [])
    return best


def test_against_the_fewest_sequences():
    """Small packings: never more than one sequence above the least number, mostly none."""
    rng, exact = random.Random(2), 0
    for _ in range(400):
        capacity = rng.randint(6, 20)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        segments = packing.plan(dict(Counter(lengths)), capacity)
        used = set()
        for length, n in Counter(lengths).items():
            for rank in range(n):
                first, sequence, _ = max(one for one in segments[length] if one[0] <= rank)
                used.add(sequence + rank - first)
        least = fewest(lengths, capacity)
        assert least <= len(used) <= least + 1
        exact += len(used) == least
    assert exact > 360
