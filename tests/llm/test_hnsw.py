import math
from collections import defaultdict

import numpy as np
import pytest
from muster.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>, label int, node string, vector string"
EVERY = "vec_id % 20 = 0"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], SCHEMA)


def brute(rows, k=20):
    """All neighbours in order, of usable rows, each (id, vector) once."""
    width = max((len(v) for _, v in rows if v), default=0)
    good = {
        (i, tuple(float(np.float32(x)) for x in v) + (0.0,) * (width - len(v)))
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    }
    out = defaultdict(list)
    for i, v in good:
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def recall(df, expected):
    found = defaultdict(list)
    for row in df.orderBy("query_id", "rank").collect():
        assert row.rank == len(found[row.query_id]) + 1
        found[row.query_id].append((row.vec_id, row.score))
    assert set(found) == {i for i, some in expected.items() if some}
    hits = total = 0
    for i, some in expected.items():
        scores = [score for _, score in found[i]]
        assert scores == sorted(scores, reverse=True) and len(found[i]) == len(some)
        true = dict(some)
        hits += sum(j in true for j, _ in found[i])
        total += len(some)
        assert all(score == pytest.approx(true[j]) for j, score in found[i] if j in true)
    return hits / max(1, total)


def vectors(n, width=12, seed=1):
    rng = np.random.default_rng(seed)
    return [(k, (rng.normal(size=width) * rng.uniform(0.2, 3)).astype(np.float32).tolist()) for k in range(n)]


def test_ties_copies_and_odd_rows(spark):
    rows = vectors(150)
    rows += [(1000 + k, rows[7][1]) for k in range(60)] + [(40, rows[40][1])] * 3
    rows += [(2000, None), (2020, []), (2040, [0.0] * 12), (2060, [None] + [1.0] * 11), (2080, [float("nan")] * 12),
             (2100, [float("inf")] * 12), (None, [1.0] * 12), (2120, [0.5] * 5), (2121, [-0.0, 1.0])]
    df = frame(spark, rows).repartition(4)
    result = hnsw.nearest(df, EVERY)
    expected = brute(rows)
    assert recall(result, expected) == 1.0
    found = {(r.query_id, r.rank): r.vec_id for r in result.collect()}
    assert [found[1000, n] for n in range(1, 21)] == [j for j, _ in expected[1000]]


def test_shards_and_cells(spark):
    rows = vectors(1500, seed=2)
    df = frame(spark, rows)
    assert recall(hnsw.nearest(df, EVERY, cell=250, shard=200), brute(rows)) > 0.9


def test_few_rows(spark):
    for rows in ([], [(20, [1.0, 2.0])], [(20, [1.0, 2.0]), (21, [2.0, 1.0])], [(20, None)]):
        expected = brute(rows)
        assert recall(hnsw.nearest(frame(spark, rows), EVERY), expected) in (0, 1.0)


def test_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert recall(hnsw.nearest(df, EVERY), brute(rows)) > 0.95


def test_graph_recall():
    rng = np.random.default_rng(3)
    data = rng.normal(size=(3000, 32))
    longest = float(np.linalg.norm(data, axis=1).max())
    vectors, queries = hnsw.lengthened(data, longest), hnsw.lengthened(data[::30], longest)
    queries[:, -1] = 0
    found = hnsw.search_graph(hnsw.build_graph(vectors), vectors, queries, hnsw.SEARCH_WIDTH)[:, :20]
    true = np.argsort(-(queries @ vectors.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found.tolist(), true.tolist())]) > 0.95
