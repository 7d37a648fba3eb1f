"""Documents cut into pieces and packed into sequences of a fixed number of tokens.

Only lengths matter for packing, and there are at most `capacity` of them. So pieces are counted by length, the packing
is planned for the counts, and each piece finds its place from its length and its rank among the pieces of that length.
The plan is the same work for any number of documents, and no task sees more than its share of the pieces.

Plan: pieces above a third of the capacity are matched first, the longest with the longest that still fits, so that at
most two of them share a sequence; the others go, longest first, where they leave the smallest gap.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muster.llm.common import map_arrow, saved, shared, texts_of

CAPACITY = 1024
END_ID = 2
# The special tokens of `byte_bpe_50k.json`; the file of ranks leaves them out.
SPECIAL = {"<|endoftext|>": 50256}
PIECES = "piece int, start long, length long, ids_crc32 long, _part int, _rank long"


def encoder(ranks_path: str, pattern: str, special: dict[str, int]):
    """Byte-level BPE from a file of ranks, which has no special tokens; any other strings are ordinary text."""
    import base64

    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece: all of full length but the first, which may be shorter."""
    first = length % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


def cut_pieces(id_name: str, ranks_path: str, pattern: str, capacity: int, end_id: int, special: dict[str, int]):
    """A row per piece, with its rank among the pieces of its length in the same partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encode = partial(encoder(ranks_path, pattern, special).encode, allowed_special="all")
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            ids, rows = batch.column(0), []
            for at, text in enumerate(texts_of(batch.column(1))):
                tokens = np.array([*encode(text.decode("utf-8", "replace")), end_id], "<u4")
                for piece, (start, length) in enumerate(cut(len(tokens), capacity)):
                    crc = zlib.crc32(tokens[start : start + length].tobytes())
                    rows.append((at, piece, start, length, crc, part, seen[length]))
                    seen[length] += 1
            if rows:
                table = np.array(rows, np.int64)
                names = ["piece", "start", "length", "ids_crc32", "_part", "_rank"]
                yield {id_name: ids.take(pa.array(table[:, 0]))} | {n: table[:, k + 1] for k, n in enumerate(names)}

    return run


def match_large(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of one or two large lengths and how many sequences have each: longest with longest that fits."""
    left, lengths, patterns = dict(counts), sorted(counts), []
    while lengths:
        longest = lengths[-1]
        n = left[longest]
        fit = bisect_left(lengths, capacity - longest + 1) - 1
        if fit < 0:
            patterns.append(((longest,), n))
            taken = {longest: n}
        elif lengths[fit] == longest:
            pairs = n // 2
            if pairs:
                patterns.append(((longest, longest), pairs))
                taken = {longest: 2 * pairs}
            elif fit:
                patterns.append(((longest, lengths[fit - 1]), 1))
                taken = {longest: 1, lengths[fit - 1]: 1}
            else:
                patterns.append(((longest,), 1))
                taken = {longest: 1}
        else:
            pairs = min(n, left[lengths[fit]])
            patterns.append(((longest, lengths[fit]), pairs))
            taken = {longest: pairs, lengths[fit]: pairs}
        for length, used in taken.items():
            left[length] -= used
            if not left[length]:
                lengths.remove(length)
    return patterns


def plan(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int]]]:
    """Per length, in order of rank: first rank, first sequence, offset. Further ranks get the following sequences."""
    large = {length: n for length, n in counts.items() if 3 * length > capacity}
    by_gap: dict[int, list[list]] = defaultdict(list)
    gaps: list[int] = []

    def add(pattern: tuple[int, ...], n: int) -> None:
        gap = capacity - sum(pattern)
        if gap not in by_gap or not by_gap[gap]:
            insort(gaps, gap)
        by_gap[gap].append([pattern, n])

    for pattern, n in match_large(large, capacity):
        add(pattern, n)
    for length in sorted(set(counts) - set(large), reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each, there = capacity // length, None
                pattern = ()
            else:
                gap = gaps[at]
                there, each = by_gap[gap].pop(), gap // length
                if not by_gap[gap]:
                    gaps.pop(at)
                pattern = there[0]
            room = n // each if there is None else there[1]
            used = min(room, n // each)
            if used:
                add(pattern + (length,) * each, used)
            elif room or there is None:
                used = 1
                add(pattern + (length,) * n, 1)
                each = n
            n -= used * each
            if there is not None and there[1] > used:
                add(pattern, there[1] - used)
    segments: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    ranks, first = Counter(), 0
    for gap in gaps:
        for pattern, n in by_gap[gap]:
            offset = 0
            for length in pattern:
                segments[length].append((ranks[length], first, offset))
                ranks[length] += n
                offset += length
            first += n
    return dict(segments)


def placed(segments):
    """Sequence and offset of each piece, from its length and rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        tables = {length: np.array(rows, np.int64) for length, rows in segments.value.items()}
        for batch in batches:
            lengths, ranks = (np.asarray(batch.column(name)) for name in ("length", "_rank"))
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                table, mine = tables[int(length)], lengths == length
                at = np.searchsorted(table[:, 0], ranks[mine], "right") - 1
                sequence[mine] = table[at, 1] + ranks[mine] - table[at, 0]
                offset[mine] = table[at, 2]
            yield {name: batch.column(name) for name in batch.schema.names} | {"sequence_id": sequence, "offset": offset}

    return run


def pack_documents(
    df: DataFrame,
    ranks_path: str,
    pattern: str,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    special: dict[str, int] | None = None,
) -> DataFrame:
    """A row per piece: `doc_id`, `piece`, `start`, `length`, `ids_crc32`, `sequence_id`, `offset`.

    A NULL or empty text is the end id alone. Every row is a document of its own, whatever its id; ids may be NULL or
    repeat. Documents of more than `capacity` tokens are cut, all pieces but the first being full. Other columns are
    not read. An empty table gives no rows. Sequences are numbered from 0. `special` has the ids of the vocabulary's
    special tokens, by their strings; without it those strings are ordinary text.
    """
    rows = df.select(df[doc_id].alias("doc_id"), df[text].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    cutter = cut_pieces("doc_id", ranks_path, pattern, capacity, end_id, special or {})
    made = map_arrow(rows, cutter, f"doc_id {kind}, {PIECES}")
    pieces = saved(made, "pieces")
    counts = pieces.groupBy("_part", "length").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", "length", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    by_length = {row["length"]: row["n"] for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    segments = shared(df, plan(by_length, capacity))
    ranked = pieces.join(before, ["_part", "length"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    done = map_arrow(
        ranked.select(*columns, "_rank"),
        placed(segments),
        f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
    return done
