"""Nearest neighbours by inner product, over hierarchical navigable small-world graphs.

Vectors get one more component, so that all have the length of the longest and the order by inner product is the order
by distance; a query's own extra component is zero. Different vectors are dealt into cells around centroids, cells of too
many vectors into several shards. A shard's graph is one row of flat arrays: vectors, and per layer its members and
their neighbours. Queries visit the shards of their nearest cells, block by block, and the shards' results are merged.

Centroids, and the number of cells a query visits, are fitted on a bounded sample (`SAMPLE`): as many cells as hold
`COVERAGE` of the sample's true neighbours. Every vector is indexed. Equal vectors are one node that stands for the
`k + 1` smallest of its ids, which is all that any query can return of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.llm.common import map_arrow, saved, shared

NEIGHBOURS = 20
LINKS = 16
BUILD_WIDTH = 96
SEARCH_WIDTH = 160
BATCH = 512
CELL = 8_192
SHARD = 16_384
MAX_CELLS = 1_024
SAMPLE = 16_384
PROBE_QUERIES = 256
COVERAGE = 0.98
EXPAND = 4


def beam(vectors, links, queries, entries, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the best nodes met, best first, and their inner products; all queries move in step.

    `links` has a row of neighbours per node, filled up with -1. Missing results are node -1.
    """
    n, rows = len(queries), np.arange(len(queries))[:, None]
    visited = np.zeros((n, len(vectors) + 1), bool)
    nodes = np.full((n, width), -1)
    scores = np.full((n, width), -np.inf, np.float32)
    nodes[:, : entries.shape[1]] = entries
    scores[:, : entries.shape[1]] = np.einsum("qd,qkd->qk", queries, vectors[entries])
    visited[rows, entries] = True
    waiting = nodes >= 0
    active = np.arange(n)
    while len(active):
        open_scores = np.where(waiting[active], scores[active], -np.inf)
        pick = np.argpartition(-open_scores, EXPAND - 1, axis=1)[:, :EXPAND]
        some = np.take_along_axis(open_scores, pick, 1) > -np.inf
        active, pick, some = active[some.any(1)], pick[some.any(1)], some[some.any(1)]
        if not len(active):
            break
        here = active[:, None]
        at = np.where(some, nodes[here, pick], -1)
        waiting[here, pick] = False
        found = np.where(at[:, :, None] >= 0, links[at], -1).reshape(len(active), -1)
        found.sort(axis=1)
        fresh = (found >= 0) & ~visited[here, found]
        fresh[:, 1:] &= found[:, 1:] != found[:, :-1]
        visited[here, found] = True
        visited[:, -1] = False
        a, b = np.nonzero(fresh)
        near = np.full(found.shape, -np.inf, np.float32)
        near[a, b] = np.einsum("kd,kd->k", queries[active[a]], vectors[found[a, b]])
        all_nodes = np.concatenate([nodes[active], found], axis=1)
        all_scores = np.concatenate([scores[active], near], axis=1)
        all_waiting = np.concatenate([waiting[active], fresh], axis=1)
        best = np.argpartition(-all_scores, width - 1, axis=1)[:, :width]
        nodes[active] = np.take_along_axis(all_nodes, best, 1)
        scores[active] = np.take_along_axis(all_scores, best, 1)
        waiting[active] = np.take_along_axis(all_waiting, best, 1) & (scores[active] > -np.inf)
    order = np.argsort(-scores, axis=1, kind="stable")
    nodes, scores = np.take_along_axis(nodes, order, 1), np.take_along_axis(scores, order, 1)
    return np.where(scores > -np.inf, nodes, -1), scores


def diverse(vectors, nodes: np.ndarray, scores: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates (best first, -1 for none) those nearer to the node than to one kept, then the next best."""
    n, width = nodes.shape
    around = vectors[nodes]
    between = np.matmul(around, around.transpose(0, 2, 1))
    chosen = np.zeros((n, width), bool)
    closest = np.full((n, width), -np.inf, np.float32)
    count = np.zeros(n, np.int64)
    for at in range(width):
        take = (nodes[:, at] >= 0) & (scores[:, at] > closest[:, at]) & (count < keep)
        chosen[:, at] = take
        count += take
        closest[take] = np.maximum(closest[take], between[take, at])
    rank = np.where(chosen, np.arange(width), np.where(nodes >= 0, width + np.arange(width), 3 * width))
    order = np.argsort(rank, axis=1, kind="stable")[:, :keep]
    return np.take_along_axis(nodes, order, 1)


def ranked(nodes: np.ndarray, scores: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates best first, each once."""
    order = np.argsort(nodes, axis=1, kind="stable")
    nodes, scores = np.take_along_axis(nodes, order, 1), np.take_along_axis(scores, order, 1).copy()
    scores[:, 1:][nodes[:, 1:] == nodes[:, :-1]] = -np.inf
    scores[nodes < 0] = -np.inf
    order = np.argsort(-scores, axis=1, kind="stable")[:, :width]
    nodes, scores = np.take_along_axis(nodes, order, 1), np.take_along_axis(scores, order, 1)
    return np.where(scores > -np.inf, nodes, -1), scores


def link_back(vectors, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Every chosen neighbour learns of the new node; a full row keeps a diverse choice of old and new."""
    room = links.shape[1]
    source, target = np.repeat(new, chosen.shape[1]), chosen.ravel()
    source, target = source[target >= 0], target[target >= 0]
    score = np.einsum("kd,kd->k", vectors[source], vectors[target])
    order = np.lexsort((-score, target))
    source, target = source[order], target[order]
    touched, first, count = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(first, count)
    few = place < room
    more = np.full((len(touched), min(room, int(count.max()))), -1)
    more[np.repeat(np.arange(len(touched)), count)[few], place[few]] = source[few]
    every = np.concatenate([links[touched], more], axis=1)
    near = np.einsum("nd,nkd->nk", vectors[touched], vectors[every])
    nodes, scores = ranked(every, near, every.shape[1])
    full = (nodes >= 0).sum(1) > room
    links[touched[~full]] = nodes[~full, :room]
    if full.any():
        links[touched[full]] = diverse(vectors, nodes[full], scores[full], room)


def build_graph(vectors: np.ndarray, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the top down: members, and their neighbours as numbers within the layer.

    A layer's members are inserted in batches that at most double it, found by a beam search in what is there.
    """
    n = len(vectors)
    rng = np.random.default_rng(seed)
    levels = np.floor(-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(np.int64)
    layers: list[tuple[np.ndarray, np.ndarray]] = []
    for level in range(int(levels.max(initial=0)), -1, -1):
        above = layers[-1][0] if layers else np.zeros(0, np.int64)
        members = np.concatenate([above, np.flatnonzero(levels == level)])
        own = vectors[members]
        room = 2 * LINKS if level == 0 else LINKS
        links = np.full((len(members), room), -1)
        done = max(1, len(above))
        if len(above):
            # Members of the layer above begin with the links they have there.
            links[:done, : layers[-1][1].shape[1]] = layers[-1][1][:, :room]
        while done < len(members):
            new = np.arange(done, min(len(members), done + min(BATCH, max(done, 8))))
            queries = own[new]
            width = min(BUILD_WIDTH, max(EXPAND, done))
            entry = descend(layers, vectors, queries)
            nodes, scores = beam(own[:done], links[:done], queries, entry, max(width, EXPAND))
            fellow = queries @ queries.T
            fellow[np.arange(len(new)), np.arange(len(new))] = -np.inf
            near = np.argsort(-fellow, axis=1)[:, : min(LINKS, len(new) - 1)]
            nodes = np.concatenate([nodes, near + done], axis=1)
            scores = np.concatenate([scores, np.take_along_axis(fellow, near, 1)], axis=1)
            nodes, scores = ranked(nodes, scores, 3 * LINKS)
            chosen = diverse(own, nodes, scores, LINKS)
            links[new, : chosen.shape[1]] = chosen
            link_back(own, links, new, chosen)
            done = int(new[-1]) + 1
        layers.append((members, links))
    return layers


def descend(layers, vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Where to enter the layer below: its members begin with those of the layer above, in the same order."""
    entry = np.zeros((len(queries), 1), np.int64)
    for members, links in layers:
        nodes, _ = beam(vectors[members], links, queries, entry, EXPAND)
        entry = np.where(nodes >= 0, nodes, nodes[:, :1])[:, :1]
    return entry


def search_graph(layers, vectors: np.ndarray, queries: np.ndarray, width: int) -> np.ndarray:
    """The nodes met last and best, as rows of `vectors`."""
    members, links = layers[-1]
    nodes, _ = beam(vectors[members], links, queries, descend(layers[:-1], vectors, queries), max(width, EXPAND))
    return np.where(nodes >= 0, members[nodes], -1)


def lengthened(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the component that gives them the longest length."""
    rest = np.maximum(0, longest**2 - (vectors**2).sum(1))
    return np.column_stack([vectors, np.sqrt(rest)]).astype(np.float32)


def centroids_of(sample: np.ndarray, cells: int, seed: int = 0) -> np.ndarray:
    """Spherical k-means of a bounded sample; an empty cell keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:cells]]
    for _ in range(8):
        cell = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, k: int) -> int:
    """How many of the nearest cells hold `COVERAGE` of the true neighbours, within the sample."""
    asked = sample[:: max(1, len(sample) // PROBE_QUERIES)].copy()
    asked[:, -1] = 0
    near = np.argsort(-(asked @ sample.T), axis=1)[:, : k + 1]
    cell = np.argmax(sample @ centres.T, axis=1)
    rank = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)
    needed = np.take_along_axis(rank, cell[near], 1)
    for probes in range(1, len(centres)):
        if (needed < probes).mean() >= COVERAGE:
            return probes
    return len(centres)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: no NULL, no non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a column of numbers, shorter ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), np.float64)
    ends = np.cumsum(np.asarray([len(x) for x in column], np.int64)) if len(column) else np.zeros(0, np.int64)
    sizes = np.diff(ends, prepend=0)
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(ends - sizes, sizes)] = flat
    return out


def graph_rows(width: int, longest: float):
    """A shard's graph as one row of flat arrays."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        ids = np.asarray(rows.column("node"))
        vectors = matrix(rows.column("vector"), width)
        layers = build_graph(lengthened(vectors, longest), int(ids[0]) & 0xFFFF)
        members, links = [layer[0].astype(np.int32) for layer in layers], [layer[1].astype(np.int32) for layer in layers]
        return pa.table(
            {
                "shard": pa.array([rows.column("shard")[0].as_py()], pa.int64()),
                "nodes": [ids.tobytes()],
                "vectors": [vectors.tobytes()],
                "sizes": [[len(one) for one in members]],
                "rooms": [[one.shape[1] for one in links]],
                "members": [np.concatenate(members).tobytes()],
                "links": [np.concatenate([one.ravel() for one in links]).tobytes()],
            },
            schema=pa.schema(
                [
                    ("shard", pa.int64()), ("nodes", pa.binary()), ("vectors", pa.binary()),
                    ("sizes", pa.list_(pa.int32())), ("rooms", pa.list_(pa.int32())),
                    ("members", pa.binary()), ("links", pa.binary()),
                ]
            ),
        )

    return run


GRAPH = "shard long, nodes binary, vectors binary, sizes array<int>, rooms array<int>, members binary, links binary"


def graph_of(row: dict, width: int):
    """Node ids, original vectors and layers of a stored graph."""
    vectors = np.frombuffer(row["vectors"]).reshape(-1, width)
    members, links = np.frombuffer(row["members"], np.int32), np.frombuffer(row["links"], np.int32)
    layers, at, to = [], 0, 0
    for size, room in zip(row["sizes"], row["rooms"]):
        layers.append((members[at : at + size].astype(np.int64), links[to : to + size * room].reshape(size, room).astype(np.int64)))
        at, to = at + size, to + size * room
    return np.frombuffer(row["nodes"], np.int64), vectors, layers


def searched(width: int, longest: float, k: int, beam_width: int):
    """Each block of queries in the graph that the row brings along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                ids, vectors, layers = graph_of(row, width)
                asked = np.frombuffer(row["asked"], np.int64)
                queries = np.frombuffer(row["queries"]).reshape(-1, width)
                longer = np.column_stack([queries, np.zeros(len(queries))]).astype(np.float32)
                found = search_graph(layers, lengthened(vectors, longest), longer, beam_width)
                # Inner products of the vectors as given, in double precision; those of missing results are dropped.
                score = np.where(found >= 0, np.einsum("qd,qkd->qk", queries, vectors[found]), -np.inf)
                node = np.where(found >= 0, ids[found], np.iinfo(np.int64).max)
                best = np.lexsort((node, -score), axis=1)[:, :k]
                score, node = np.take_along_axis(score, best, 1), np.take_along_axis(node, best, 1)
                real = score > -np.inf
                yield {"query": np.repeat(asked, real.sum(1)), "node": node[real], "score": score[real]}

    return run


def blocks(centres, probes: int, counts: dict[int, int], width: int):
    """Queries packed by shard: at most `BATCH` per row, each query for every shard of its nearest cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0

        def packed() -> dict:
            shards, asked, queries = [], [], []
            for shard, parts in waiting.items():
                ids, vectors = (np.concatenate([part[k] for part in parts]) for k in (0, 1))
                for at in range(0, len(ids), BATCH):
                    shards.append(shard)
                    asked.append(ids[at : at + BATCH].tobytes())
                    queries.append(vectors[at : at + BATCH].tobytes())
            waiting.clear()
            return {"shard": shards, "asked": asked, "queries": queries}

        for batch in batches:
            ids, vectors = np.asarray(batch.column("node")), matrix(batch.column("vector"), width)
            longer = np.column_stack([vectors, np.zeros(len(vectors))]).astype(np.float32)
            cells = np.argsort(-(longer @ centres.value.T), axis=1)[:, :probes]
            for cell in np.unique(cells):
                rows = (cells == cell).any(1)
                for part in range(counts.get(int(cell), 0)):
                    waiting.setdefault(int(cell) * SHARD + part, []).append((ids[rows], vectors[rows]))
                    held += int(rows.sum())
            if held >= 64 * BATCH:
                yield packed()
                held = 0
        if waiting:
            yield packed()

    return run


def with_cell(nodes: DataFrame, centres, width: int, longest: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            vectors = lengthened(matrix(batch.column("vector"), width), longest)
            cell = np.argmax(vectors @ centres.value.T, axis=1) if len(vectors) else np.zeros(0, np.int64)
            yield {"node": batch.column("node"), "vector": batch.column("vector"), "asks": batch.column("asks"), "cell": cell}

    return map_arrow(nodes, run, "node long, vector array<double>, asks boolean, cell long")


def nearest(
    df: DataFrame,
    is_query: str,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = NEIGHBOURS,
    cell: int = CELL,
    shard: int = SHARD,
    beam_width: int = SEARCH_WIDTH,
) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score`: the `k` nearest found of each row for which `is_query` holds.

    `is_query` is an SQL expression of `vec_id`.

    Nearest is the largest inner product in double precision, ties to the smaller id; a row is not its own neighbour.
    Vectors that are NULL, zero, or hold NULL or non-finite components take no part, nor do rows without an id. Shorter
    vectors count as filled up with zeros. Repeated rows are one; an id with several vectors is a candidate with each of
    them, and asks with each of them. Equal vectors have equal scores. An empty table gives no rows, and a query without
    candidates has none. Other columns are not read.
    """
    rows = df.select(df[vec_id].cast("bigint").alias("vec_id"), df[vector].cast("array<double>").alias("vector"))
    valid = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector"))).withColumn("asks", F.expr(is_query)).distinct()
    valid = saved(valid, "vectors")
    facts = valid.agg(F.max(F.size("vector")), F.max(length_of("vector"))).first()
    if facts[0] is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, longest = facts[0], float(np.sqrt(facts[1])) * (1 + 1e-9)

    first = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = valid.withColumn("_n", first).filter(F.col("_n") <= k + 1)
    ids = few.groupBy("vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    asking = valid.filter("asks").select("vector").distinct().withColumn("asks", F.lit(True))
    named = ids.join(asking, "vector", "left").select(
        F.monotonically_increasing_id().alias("node"), "vector", "ids", F.coalesce("asks", F.lit(False)).alias("asks")
    )
    nodes = saved(named, "nodes")

    sample_rows = nodes.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).toArrow()
    sample = lengthened(matrix(sample_rows.column("vector"), width), longest)
    cells = int(min(MAX_CELLS, len(sample), max(1, -(-nodes.count() // cell))))
    fitted = centroids_of(sample, cells)
    probes, centres = probes_for(sample, fitted, k), shared(df, fitted)

    dealt = saved(with_cell(nodes.select("node", "vector", "asks"), centres, width, longest), "cells")
    counts = {row["cell"]: -(-row["n"] // shard) for row in dealt.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    parts = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(counts.items()) for x in pair]), F.col("cell"))
    part = F.pmod(F.xxhash64("node"), parts.cast("bigint"))
    sharded = dealt.withColumn("shard", (F.col("cell") * SHARD + part).cast("bigint")).select("shard", "node", "vector")
    graphs = saved(sharded.groupBy("shard").applyInArrow(graph_rows(width, longest), GRAPH), "graphs")

    asked = dealt.filter("asks").select("node", "vector")
    packed = map_arrow(asked, blocks(centres, probes, counts, width), "shard long, asked binary, queries binary")
    work = packed.repartition("shard", "asked").join(graphs, "shard")
    hits = map_arrow(work, searched(width, longest, k + 1, beam_width), "query long, node long, score double")

    merged = hits.join(nodes.select("node", "ids"), "node")
    near = merged.select("query", "score", F.explode("ids").alias("vec_id"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    best = near.withColumn("_n", place).filter(F.col("_n") <= k + 1)
    lists = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("found"))
    answers = saved(lists.join(nodes.select(F.col("node").alias("query"), "vector"), "query").select("vector", "found"), "answers")
    queries = valid.filter("asks").select(F.col("vec_id").alias("query_id"), "vector")
    others = F.filter("found", lambda one: one["vec_id"] != F.col("query_id"))
    listed = queries.join(answers, "vector").select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "one"))
    return listed.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "one.vec_id", "one.score")


def length_of(vector: str) -> Column:
    """The squared length."""
    return F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x)
