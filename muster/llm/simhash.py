"""Near-duplicate documents by SimHash fingerprints, found with BK-trees.

Different fingerprints are dealt into shards so that any two within the radius meet in one: the 64 bits are cut into
`BLOCKS` blocks, and of fingerprints that differ in at most `RADIUS` bits at least `BLOCKS - RADIUS` blocks agree; a
shard holds the fingerprints that agree in one choice of that many blocks. Each shard builds a BK-tree, and its own
fingerprints follow the edges within the radius. The trees of all shards grow with the data, so no tree is broadcast: it
goes only where the fingerprints of its shard are. A shard yields a spanning forest of its links, not its pairs.

Shards above `SHARD_LIMIT` fingerprints are searched in pieces: one tree per piece, and each other piece in its own task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm.common import map_arrow, saved, texts_of
from muster.llm.components import components

WORDS = 4
SEED = 42
RADIUS = 4
BLOCKS = 6
SHARD_LIMIT = 8_192
CHUNK = 100_000
# For each byte, its eight bits in the eight bytes of a number.
LANES = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")).view(np.uint64).ravel()


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """XXH64 of all shingles, repeats included; a shorter text is one shingle, a text without words has none."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(b" ".join(parts), SEED)], np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(part) + 1 for part in parts]) - 1
    starts = np.concatenate(([0], ends[:-words] + 1)).tolist()
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())]
    return np.array(hashes, np.uint64)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if over half the hashes have it."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 64):
        part = hashes[at : at + 255 * 64].astype("<u8").view(np.uint8).reshape(-1, 8)
        for low in range(0, len(part), 255):
            counts += LANES[part[low : low + 255]].sum(axis=0).view(np.uint8)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints_of(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            prints = [majority(shingle_hashes(text, words)) for text in texts_of(batch.column(1))]
            yield {"doc_id": batch.column(0), "print": np.array(prints, np.uint64).view(np.int64)}

    return run


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """`doc_id`, `print`: the 64 bits of each row's text as a signed number."""
    rows = df.select(df[doc_id].alias("doc_id"), df[text].cast("string").alias("text"))
    return map_arrow(rows, fingerprints_of(words), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, print long")


def masks(blocks: int, radius: int) -> list[int]:
    """One mask per choice of blocks that two fingerprints within the radius may agree in."""
    bounds = [64 * k // blocks for k in range(blocks + 1)]
    block = [(1 << high) - (1 << low) for low, high in zip(bounds, bounds[1:])]
    signed = [sum(some) for some in combinations(block, blocks - radius)]
    return [mask - (1 << 64) if mask >> 63 else mask for mask in signed]


def build_forest(groups: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A BK-tree per group, all built level by level.

    Returns, per item: its parent (-1 for a root) and its distance to it; and the items sorted by parent, with the
    first of each parent's children. Fingerprints of a group must differ.
    """
    n = len(prints)
    parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    _, roots, group = np.unique(groups, return_index=True, return_inverse=True)
    waiting = np.setdiff1d(np.arange(n), roots)
    at = roots[group]
    while len(waiting):
        above = at[waiting]
        distance = np.bitwise_count(prints[waiting] ^ prints[above]).astype(np.int64)
        _, first, slot = np.unique(above * 65 + distance, return_index=True, return_inverse=True)
        children = waiting[first]
        parent[children], edge[children] = above[first], distance[first]
        at[waiting] = children[slot]
        rest = np.ones(len(waiting), bool)
        rest[first] = False
        waiting = waiting[rest]
    by_parent = np.argsort(parent, kind="stable")
    starts = np.searchsorted(parent[by_parent], np.arange(n + 1))
    return roots, edge, by_parent, starts


def search_forest(tree, prints: np.ndarray, queries: np.ndarray, first: np.ndarray, radius: int):
    """Pairs (query, item) within the radius. `first` is the root each query starts from."""
    _, edge, by_parent, starts = tree
    who, node = np.arange(len(queries)), first
    while len(who):
        distance = np.bitwise_count(queries[who] ^ prints[node]).astype(np.int64)
        near = distance <= radius
        yield who[near], node[near]
        low, count = starts[node], starts[node + 1] - starts[node]
        owner = np.repeat(np.arange(len(who)), count)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        child = by_parent[low[owner] + offset]
        follow = np.abs(edge[child] - distance[owner]) <= radius
        who, node = who[owner[follow]], child[follow]


def forest_links(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The root of each of n items, after uniting the given pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def shard_links(groups: np.ndarray, prints: np.ndarray, radius: int) -> dict:
    """Spanning links of whole shards: each fingerprint with the root of its part of the shard."""
    tree = build_forest(groups, prints)
    roots = tree[0]
    root_of = roots[np.unique(groups, return_inverse=True)[1]]
    n = len(prints)
    root = np.arange(n)
    step = max(1, 2_000_000 // SHARD_LIMIT)
    sizes = np.bincount(np.unique(groups, return_inverse=True)[1])
    step = max(step, min(n, CHUNK) if sizes.max() <= 64 else step)
    for at in range(0, n, step):
        part = slice(at, at + step)
        found = [(who + at, node) for who, node in search_forest(tree, prints, prints[part], root_of[part], radius)]
        a, b = (np.concatenate([one[k] for one in found]) for k in (0, 1))
        other = a != b
        if other.any():
            united = forest_links(root[a[other]], root[b[other]], n)
            root = united[root]
    linked = root != np.arange(n)
    return {"u": prints[linked].view(np.int64), "v": prints[root[linked]].view(np.int64)}


def shards(radius: int):
    """Whole shards, read one after the other from sorted rows, searched some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64)))
            if sum(len(keys) for keys, _ in held) >= CHUNK:
                keys, prints = (np.concatenate([one[k] for one in held]) for k in (0, 1))
                whole = keys != keys[-1]
                if whole.any():
                    yield shard_links(keys[whole], prints[whole], radius)
                held = [(keys[~whole], prints[~whole])]
        if held:
            keys, prints = (np.concatenate([one[k] for one in held]) for k in (0, 1))
            if len(keys):
                yield shard_links(keys, prints, radius)

    return run


def piece_links(radius: int):
    """Links between two pieces of a large shard: a tree of one, searched with the other."""

    def run(rows: pa.Table) -> pa.Table:
        prints, side = np.asarray(rows.column("print")).view(np.uint64), np.asarray(rows.column("side"))
        tree_of, asked = prints[side != 1], prints[side != 0]
        if not len(tree_of) or not len(asked):
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        tree = build_forest(np.zeros(len(tree_of), np.int64), tree_of)
        index = np.full(len(asked), tree[0][0])
        every = np.unique(np.concatenate([tree_of, asked]))
        root = np.arange(len(every))
        for at in range(0, len(asked), 256):
            part = slice(at, at + 256)
            found = list(search_forest(tree, tree_of, asked[part], index[part], radius))
            a = np.searchsorted(every, asked[part][np.concatenate([one[0] for one in found])])
            b = np.searchsorted(every, tree_of[np.concatenate([one[1] for one in found])])
            if len(a):
                root = forest_links(root[a], root[b], len(every))[root]
        linked = root != np.arange(len(every))
        return pa.table({"u": every[linked].view(np.int64), "v": every[root[linked]].view(np.int64)})

    return run


def near_links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, limit: int = SHARD_LIMIT) -> DataFrame:
    """`u`, `v`: links that join exactly the fingerprints (`print`, all different) within `radius` of each other."""
    choices = F.array(*[F.lit(mask) for mask in masks(blocks, radius)])
    agreed = F.posexplode(F.transform(choices, lambda mask: F.col("print").bitwiseAND(mask)))
    dealt = distinct.select("print", agreed.alias("choice", "bits")).select(
        F.xxhash64("choice", "bits").alias("shard"), "print"
    )
    sizes = dealt.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > limit)
    large = saved(sizes, "large-shards")
    if large.isEmpty():
        whole, pieces = dealt, None
    else:
        whole, pieces = dealt.join(large, "shard", "left_anti"), dealt.join(large, "shard")
    links = map_arrow(whole.repartition("shard").sortWithinPartitions("shard"), shards(radius), "u long, v long")
    if pieces is None:
        return links
    return links.unionByName(pieces_searched(pieces, radius, limit))


def pieces_searched(pieces: DataFrame, radius: int, limit: int) -> DataFrame:
    """Each pair of pieces of a large shard in a task of its own."""
    of: Column = F.ceil(F.col("n") / limit).cast("int")
    mine = pieces.select("shard", "print", of.alias("of")).withColumn("mine", F.pmod(F.xxhash64("print"), F.col("of")).cast("int"))
    pairs = F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("other")
    spread = mine.select("shard", "print", "mine", pairs)
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") == low, 0).otherwise(1)
    tasks = spread.select("shard", low.alias("low"), high.alias("high"), side.alias("side"), "print")
    return tasks.groupBy("shard", "low", "high").applyInArrow(piece_links(radius), "u long, v long")


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS
) -> DataFrame:
    """A row per row of `df`: `doc_id`, `fingerprint` (16 hexadecimal digits), `component_id`.

    Fingerprints link at `radius` or fewer differing bits; `component_id` is the smallest id that can be reached over
    links, the row's own included. Equal texts have one fingerprint and so one component. NULL, empty and blank texts
    have fingerprint zero, which links like any other. NULL ids are rows like others but never a component's id, unless
    it has no other. An empty table gives no rows; other columns are not read.
    """
    prints = saved(fingerprints(df, doc_id, text, words), "fingerprints")
    distinct = saved(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    linked = components(saved(near_links(distinct.select("print"), radius), "near-links"))
    members = distinct.join(linked.withColumnRenamed("node", "print"), "print")
    smallest = saved(members.groupBy("root").agg(F.min("first").alias("component_id")), "components")
    of_print = saved(members.select("print", "root").join(smallest, "root").select("print", "component_id"), "members")
    whole = saved(distinct.join(of_print, "print", "left").select(
        "print", F.coalesce("component_id", "first").alias("component_id")), "classes")
    digits = F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint")
    return prints.join(whole, "print").select("doc_id", digits, "component_id")
