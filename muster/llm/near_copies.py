"""Near copies by similarity: SimHash trees propose, the shingles themselves decide.

A radius that finds all documents of similarity 0.8 is too wide to deal 64-bit fingerprints into small shards by their
bits. So shards are dealt by min-hashes of the shingles: documents of that similarity share one of `BANDS` pairs of
min-hashes all but three times in ten thousand. Inside a shard, the BK-tree of `muster.llm.simhash` gives the pairs
within `RADIUS` bits, and those whose sets of shingles are similar enough are linked. Fingerprints are made from the
different shingles, as similarity is: a bit of two of them differs with a chance of at most 0.19 at similarity 0.8 (texts
of four and five shingles; 0.15 for long ones), so more than `RADIUS` bits at most once in eight thousand. A shard yields
a spanning forest of its links. Documents with the same set of shingles are one node; only nodes with a partner take
their shingles along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muster.llm.common import fresh, map_arrow, saved, texts_of
from muster.llm.components import components
from muster.llm.simhash import build_forest, majority, search_forest, shingle_hashes

WORDS = 5
SIMILARITY = 0.8
RADIUS = 24
BANDS = 8
SHARD_LIMIT = 2_048
STEP = 256
FACTORS = np.random.default_rng(11).integers(1, 2**63, 2 * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)


def band_values(hashes: np.ndarray) -> np.ndarray:
    """A number per band, from two min-hashes each; a text without shingles has zeros."""
    if not len(hashes):
        return np.zeros(BANDS, np.int64)
    smallest = np.array([(hashes * factor).min() for factor in FACTORS])
    return (smallest[::2] * np.uint64(0x9E3779B97F4A7C15) ^ smallest[1::2]).view(np.int64)


def signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            nodes, prints, bands = [], [], []
            for text in texts_of(batch.column("text")):
                hashes = np.unique(shingle_hashes(text, words))
                prints.append(majority(hashes))
                nodes.append(xxhash.xxh3_64_intdigest(hashes.tobytes()))
                bands.append(band_values(hashes))
            yield {
                "doc_id": batch.column("doc_id"),
                "row": batch.column("row"),
                "node": np.array(nodes, np.uint64).view(np.int64),
                "print": np.array(prints, np.uint64).view(np.int64),
                "bands": [one.tolist() for one in bands],
            }

    return run


def shingle_sets(words: int):
    """The sorted different shingles of each node's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(text, words)).tobytes() for text in texts_of(batch.column("text"))]
            yield {"node": batch.column("node"), "shingles": sets}

    return run


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the share of common members among all is at least `least`; two empty sets are equal."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= least * (len(a) + len(b) - common) - 1e-9


def close_pairs(tree_of: np.ndarray, asked: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in `asked` and `tree_of` of fingerprints within the radius. Equal fingerprints share a node of the tree."""
    every, slot = np.unique(tree_of, return_inverse=True)
    members = np.argsort(slot, kind="stable")
    starts = np.searchsorted(slot[members], np.arange(len(every) + 1))
    tree = build_forest(np.zeros(len(every), np.int64), every)
    for at in range(0, len(asked), STEP):
        part = asked[at : at + STEP]
        root = np.full(len(part), tree[0][0])
        for who, node in search_forest(tree, every, part, root, radius):
            count = starts[node + 1] - starts[node]
            owner = np.repeat(np.arange(len(node)), count)
            offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            yield who[owner] + at, members[starts[node][owner] + offset]


def partners(radius: int):
    """Nodes of a shard, or of two pieces of one, that have another within the radius."""

    def run(rows: pa.Table) -> pa.Table:
        prints, side = np.asarray(rows.column("print")).view(np.uint64), np.asarray(rows.column("side"))
        trees, queries = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        has = np.zeros(len(prints), bool)
        if len(trees) and len(queries):
            for who, node in close_pairs(prints[trees], prints[queries], radius):
                a, b = queries[who], trees[node]
                has[a[a != b]] = has[b[a != b]] = True
        return rows.select(["task", "node", "print", "side"]).filter(pa.array(has))

    return run


def verified(radius: int, least: float):
    """Links of a shard, or between two pieces of one: those that join its similar nodes."""

    def run(rows: pa.Table) -> pa.Table:
        prints, side = np.asarray(rows.column("print")).view(np.uint64), np.asarray(rows.column("side"))
        nodes = rows.column("node").to_pylist()
        sets = [np.frombuffer(one, np.uint64) for one in rows.column("shingles").to_pylist()]
        trees, queries = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        root = list(range(len(nodes)))

        def top(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        u, v = [], []
        if len(trees) and len(queries):
            for who, node in close_pairs(prints[trees], prints[queries], radius):
                for a, b in zip(queries[who].tolist(), trees[node].tolist()):
                    # Nodes that are joined already need no further comparison.
                    if a != b and (x := top(a)) != (y := top(b)) and similar(sets[a], sets[b], least):
                        root[x] = y
                        u.append(nodes[a])
                        v.append(nodes[b])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def shard_tasks(nodes: DataFrame, limit: int) -> DataFrame:
    """`task`, `node`, `print`, `side`: each shard, or each pair of pieces of a large one; side 0 is in the tree, side 1
    asks, side 2 does both. Shards of one node are left out."""
    dealt = nodes.select("node", "print", F.posexplode("bands").alias("band", "value"))
    rows = saved(dealt.select(F.xxhash64("band", "value").alias("shard"), "node", "print"), "shards")
    sizes = saved(rows.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1"), "shard-sizes")
    pieces = rows.join(sizes, "shard").withColumn("of", F.ceil(F.col("n") / limit).cast("int"))
    mine = pieces.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("of")).cast("int"))
    spread = mine.select("shard", "node", "print", "mine", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("other"))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") == low, 0).otherwise(1)
    return spread.select(F.xxhash64("shard", low, high).alias("task"), "node", "print", side.alias("side"))


def node_links(docs: DataFrame, rows: DataFrame, words: int, least: float, limit: int) -> DataFrame:
    """`u`, `v`: links that join the nodes of similar documents. `docs` has `doc_id`, `row`, `text`."""
    nodes = rows.groupBy("node").agg(
        F.min("print").alias("print"), F.min("bands").alias("bands"), F.min(F.struct("doc_id", "row")).alias("one")
    )
    nodes = saved(nodes, "nodes")
    kind = "task long, node long, print long, side int"
    near = shard_tasks(nodes, limit).groupBy("task").applyInArrow(partners(RADIUS), kind)
    near = saved(near, "partners")
    chosen = near.select("node").distinct().join(nodes.select("node", "one.*"), "node")
    same = docs["row"] == chosen["row"]
    texts = docs.join(chosen.select("node", F.col("doc_id").alias("_id"), "row"), same & docs["doc_id"].eqNullSafe(F.col("_id")))
    sets = map_arrow(texts.select("node", "text"), shingle_sets(words), "node long, shingles binary").dropDuplicates(["node"])
    work = near.join(saved(sets, "shingles"), "node")
    return work.groupBy("task").applyInArrow(verified(RADIUS, least), "u long, v long")


def one_of_each(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    least: float = SIMILARITY,
    limit: int = SHARD_LIMIT,
) -> DataFrame:
    """The rows of `df`, one of each group of near copies, all columns as they are.

    Documents are linked if at least `least` of their different runs of `words` words (A-Z lower-cased; fewer words are
    one run) are common to both; groups are what links join. The row with the smallest id stays, NULL being largest;
    of rows with one id, the one that comes first by a hash of all columns; of rows that are equal in all columns, any
    one. Texts without words are one group. An empty table stays empty.
    """
    row_name, id_name, number = (fresh(name, df.columns) for name in ("_row", "_id", "_first"))
    named = df.withColumn(row_name, F.xxhash64(*[F.col(f"`{name}`") for name in df.columns]))
    # NULL ids count as the largest.
    order = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(np.iinfo(np.int64).max))
    docs = named.select(order.alias("doc_id"), F.col(row_name).alias("row"), F.col(text).cast("string").alias("text"))
    made = map_arrow(docs, signatures(words), "doc_id long, row long, node long, print long, bands array<long>")
    rows = saved(made, "signatures")
    roots = components(saved(node_links(docs, rows, words, least, limit), "copy-links"))
    of_node = rows.select("doc_id", "row", "node").join(roots, "node", "left")
    group = F.coalesce("root", "node").alias("group")
    kept = of_node.select(group, "doc_id", "row").groupBy("group").agg(F.min(F.struct("doc_id", "row")).alias("one"))
    keep = saved(kept.select("one.*").withColumnsRenamed({"doc_id": id_name, "row": row_name}), "kept")
    left = named.withColumn(id_name, order).join(keep, [id_name, row_name], "left_semi")
    again = rows.groupBy("doc_id", "row").agg(F.count("*").alias("n")).filter("n > 1")
    if not again.isEmpty():
        first = F.row_number().over(Window.partitionBy(id_name, row_name).orderBy(F.lit(0)))
        left = left.withColumn(number, first).filter(F.col(number) == 1)
    return left.select([F.col(f"`{name}`") for name in df.columns])
