"""Lines that many documents share are dropped.

Two Bloom filters, of keys seen once and of keys seen twice, are built inside every input partition, united block by
block, and sent to all tasks. Only keys that the second filter suspects leave their partition, to be counted exactly.

Filters grow with the counted lines up to `MAX_BITS`, which bounds what is broadcast. Where that would leave a line less
than `LEAST_BITS` bits, keys are dealt to ranges by their hash, and each range has filters of its own, one after the other.
Frequent keys are broadcast, the most frequent first; of the others, if `BROADCAST_BYTES` has no room for all, a filter is
broadcast, and lines that it holds are joined with them. The result is exact at every size.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muster.llm.common import fresh, map_arrow, saved, shared, texts_of, without

MIN_DOCS = 10
BITS_PER_LINE = 16
LEAST_BITS = 4
BLOCK_BITS = 1 << 19
MAX_BITS = 1 << 29
# Frequent keys beyond so many bytes, the rarest of them, are joined instead of broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024
FLUSH = 50_000


def key_of(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def keys_of(text: bytes) -> set[bytes]:
    keys = set(map(key_of, text.split(b"\n")))
    keys.discard(b"")
    return keys


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash, both in one block, so that blocks can be united one by one."""
    block = (hashes >> np.uint64(40)) % np.uint64(bits // BLOCK_BITS) * np.uint64(BLOCK_BITS)
    inside = np.uint64(BLOCK_BITS - 1)
    return block + (hashes & inside), block + ((hashes >> np.uint64(19)) & inside)


def suspected(twice: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter holds each hash."""
    def hit(at: np.ndarray) -> np.ndarray:
        return (twice[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1)

    one, two = places(hashes, len(twice) * 8)
    return (hit(one) & hit(two)).astype(bool)


def filter_bits(lines: int) -> int:
    """Bits of a filter: a power of two that gives each line `BITS_PER_LINE`, within bounds."""
    wanted = max(1, lines) * BITS_PER_LINE
    return int(min(MAX_BITS, max(2 * BLOCK_BITS, 1 << (wanted - 1).bit_length())))


def hashes_of(keys) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64)


def in_range(hashes: np.ndarray, part: int, parts: int) -> np.ndarray:
    """Whether each hash belongs to this one of the ranges."""
    return (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts) == np.uint64(part)


def partition_filters(bits: int, part: int, parts: int):
    """One row per block that the partition touched: its bits seen once, and seen twice, of keys of one range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        touched = np.zeros(bits // BLOCK_BITS, bool)

        def add(hashes: np.ndarray) -> None:
            distinct, counts = np.unique(hashes, return_counts=True)
            again = distinct[(counts > 1) | suspected(once, distinct)]
            for into, some in ((once, distinct), (twice, again)):
                for at in places(some, bits):
                    np.bitwise_or.at(into, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
            touched[places(distinct, bits)[0] // np.uint64(BLOCK_BITS)] = True

        pending, size = [], 0
        for batch in batches:
            for text in texts_of(batch.column(0)):
                hashes = hashes_of(keys_of(text))
                hashes = hashes[in_range(hashes, part, parts)]
                pending.append(hashes)
                size += len(hashes)
                if size >= FLUSH:
                    add(np.concatenate(pending))
                    pending, size = [], 0
        if pending:
            add(np.concatenate(pending))
        width = BLOCK_BITS // 8
        for block in np.flatnonzero(touched):
            some = slice(block * width, (block + 1) * width)
            yield {"block": [int(block)], "once": [pack(once[some])], "twice": [pack(twice[some])]}

    return run


def pack(block: np.ndarray) -> bytes:
    return zlib.compress(block.tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8).copy()


def united_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """A bit is seen twice if one partition says so, or two have seen it once."""
    once: dict[int, np.ndarray] = {}
    twice: dict[int, np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            block, mine, more = row["block"], unpack(row["once"]), unpack(row["twice"])
            if block in once:
                twice[block] |= more | (once[block] & mine)
                once[block] |= mine
            else:
                once[block], twice[block] = mine, more
    for block, bits in twice.items():
        yield {"block": [block], "twice": [pack(bits)]}


def count_lines(texts: DataFrame) -> int:
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    return texts.agg(F.sum(F.coalesce(breaks, F.lit(0)) + 1)).first()[0] or 0


def seen_twice(texts: DataFrame, lines: int, part: int = 0, parts: int = 1) -> np.ndarray:
    """The second filter of one range of keys over all documents, at most `MAX_BITS` bits."""
    bits = filter_bits(-(-lines // parts))
    rows = map_arrow(texts, partition_filters(bits, part, parts), "block long, once binary, twice binary")
    blocks = map_arrow(rows.repartition("block"), united_blocks, "block long, twice binary")
    twice, width = np.zeros(bits // 8, np.uint8), BLOCK_BITS // 8
    for row in blocks.toLocalIterator():
        twice[row["block"] * width : (row["block"] + 1) * width] = unpack(bytes(row["twice"]))
    return twice


def suspects(twice, part: int, parts: int):
    """Suspected keys of one range, each once per document, counted inside the partition as far as memory allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in texts_of(batch.column(0)):
                keys = list(keys_of(text))
                if keys:
                    hashes = hashes_of(keys)
                    mask = suspected(twice.value, hashes) & in_range(hashes, part, parts)
                    counts.update(key for key, yes in zip(keys, mask) if yes)
                if len(counts) >= FLUSH:
                    yield {"key": list(counts), "n": list(counts.values())}
                    counts.clear()
        if counts:
            yield {"key": list(counts), "n": list(counts.values())}

    return run


def frequent_keys(df: DataFrame, min_docs: int = MIN_DOCS, text: str = "text") -> DataFrame:
    """`key`, `n_docs`: exactly the keys that at least `min_docs` documents hold, from suspected keys only."""
    texts = df.select(df[text].cast("string").alias("text"))
    if min_docs < 2:
        raise ValueError("min_docs below 2: the filter of twice-seen keys would miss keys")
    lines = count_lines(texts)
    parts = max(1, -(-lines * LEAST_BITS // MAX_BITS))
    found = []
    for part in range(parts):
        twice = shared(df, seen_twice(texts, lines, part, parts))
        counted = map_arrow(texts, suspects(twice, part, parts), "key binary, n long")
        counted = counted.groupBy("key").agg(F.sum("n").alias("n_docs")).filter(F.col("n_docs") >= min_docs)
        # Written between ranges, so that no task holds the filters of two.
        found.append(counted if parts == 1 else saved(counted, "frequent-range"))
    return functools.reduce(DataFrame.unionAll, found)


def kept_lines(text: bytes, drop) -> tuple[bytes, int, int]:
    lines = text.split(b"\n")
    kept = [line for at, line in enumerate(lines) if not drop(at, line)]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def rewritten(schema: T.StructType, text: str, counts: tuple[str, str], dropper, gone: str | None = None) -> tuple:
    """A batch function that replaces the text and adds the counts, and the schema of its result."""
    rest = without(schema, [*counts, gone])
    fields = [schema[name] if name != text else T.StructField(text, T.StringType()) for name in rest]
    added = [T.StructField(name, T.LongType()) for name in counts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            drops = dropper(batch)
            new = [kept_lines(value, drop) for value, drop in zip(texts_of(batch.column(text)), drops)]
            columns = {name: batch.column(name) for name in rest}
            yield columns | {
                text: pa.array([one[0] for one in new], pa.binary()).cast(pa.string()),
                counts[0]: [one[1] for one in new],
                counts[1]: [one[2] for one in new],
            }

    return run, T.StructType(fields + added)


def drop_frequent_lines(
    df: DataFrame, min_docs: int = MIN_DOCS, text: str = "text", counts: tuple[str, str] = ("n_lines", "n_dropped")
) -> DataFrame:
    """All columns, with the lines gone whose key at least `min_docs` documents hold; adds `n_lines`, `n_dropped`.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Empty keys never count. A NULL or
    empty text has one empty line and becomes an empty text. Every row is a document, repeated ids and NULL ids
    included; an empty table gives an empty table. Columns named like the added ones (`counts`) are replaced.
    """
    df = df.withColumn(text, F.col(text).cast("string"))
    # Keys of a level have at least half as many documents as any other of it.
    level = F.floor(F.log2("n_docs"))
    frequent = saved(frequent_keys(df, min_docs, text).withColumn("level", level), "frequent-lines")
    sizes = frequent.groupBy("level").agg(F.sum(F.octet_length("key") + 64).alias("size")).collect()
    room, least = BROADCAST_BYTES, None
    for row in sorted(sizes, key=lambda row: -row["level"]):
        room -= row["size"]
        if room < 0:
            least = row["level"]
            break
    common = frequent if least is None else frequent.filter(F.col("level") > least)
    known = shared(df, frozenset(bytes(row["key"]) for row in common.select("key").collect()))
    if least is not None:
        return drop_with_join(df, known, frequent.filter(F.col("level") <= least), text, counts)

    def by_key(batch: pa.RecordBatch):
        keys = known.value
        return [lambda _, line: key_of(line) in keys] * batch.num_rows

    return map_arrow(df, *rewritten(df.schema, text, counts, by_key))


def lines_held(by):
    """The lines of each text whose key the filter holds: digest of the text, place of the line, key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for digest, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                keys = list(map(key_of, text.split(b"\n")))
                at = np.flatnonzero(suspected(by.value, hashes_of(keys))).tolist()
                if at:
                    yield {"digest": [digest] * len(at), "pos": at, "key": [keys[k] for k in at]}

    return run


def drop_with_join(df: DataFrame, known, rare: DataFrame, text: str, counts: tuple[str, str]) -> DataFrame:
    """The same where not all frequent keys can be broadcast: `known` are, `rare` are joined.

    Only lines that a filter of the rare keys holds leave their partition. Which lines go depends on the text alone, so
    places are found once per different text, by plain shuffled joins.
    """
    same, gone = fresh("_digest", df.columns), fresh("_drop", df.columns)
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    keys = rare.select(F.col("key").cast("string").alias("text"))
    # Every key twice: then the second filter holds exactly these.
    held = shared(df, seen_twice(keys.unionAll(keys), rare.count()))
    lines = map_arrow(df.select(digest.alias("digest"), text), lines_held(held), "digest string, pos int, key binary")
    hits = lines.join(rare.select("key"), "key", "left_semi")
    found = saved(hits.groupBy("digest").agg(F.collect_set("pos").alias("_drop")), "frequent-places")
    found = found.withColumnsRenamed({"digest": same, "_drop": gone})
    rows = df.withColumn(same, digest).join(found, same, "left").drop(same)

    def by_place(batch: pa.RecordBatch):
        keys = known.value
        places = [frozenset(value or ()) for value in batch.column(gone).to_pylist()]
        return [lambda at, line, places=one: at in places or key_of(line) in keys for one in places]

    return map_arrow(rows, *rewritten(rows.schema, text, counts, by_place, gone))
