"""Passages that repeat an earlier document are removed, byte by byte.

Documents are packed into batches that are written once. Of the hashes of all short runs of bytes in a string of `LENGTH`
bytes the smallest is its anchor, so equal strings have equal anchors, and neighbouring strings mostly share theirs.

1. Anchors of all batches meet in buckets; those that only one document has are forgotten.
2. Each batch sends the text around its shared anchors, each different piece once, to the shard of the anchor.
3. A shard builds an enhanced suffix array of its different pieces and scans it with a stack for the intervals of its
   common-prefix tree. Intervals whose occurrences differ in the byte before them are maximal repeats; each yields the
   smallest document among all its occurrences. Pieces without a partner need no array.
4. Batches learn, for their pieces, which document has each string first, and drop what a smaller document has.

Anchors with very many different pieces (`HOT`, counted per batch and added up) are not gathered in one shard, which
bounds what an array is built of. Their strings are rows of their own: the first document of each by a grouped minimum,
which combines before it shuffles, given back to the batches by a join whose large keys adaptive execution splits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.llm.common import map_arrow, saved, texts_of

LENGTH = 50
RUN = 20
BATCH_BYTES = 1024 * 1024
BUCKET_BYTES = 4 * 1024 * 1024
BUCKETS = 64
WINDOWS = 64
HOT = 5_000
CHUNK = 400_000
NO_ID = np.iinfo(np.int64).max
BATCH = "batch long, bytes long, ids binary, sizes binary, digests binary, texts binary"


def batches_of(batch_bytes: int):
    """Documents packed into rows of about so many bytes. A NULL id counts as larger than every other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, number = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        texts: list[bytes] = []

        def packed() -> dict:
            nonlocal number
            number += 1
            sizes = np.array([len(text) for text in texts], np.int64)
            row = {
                "batch": [(part << 32) + number],
                "bytes": [int(sizes.sum())],
                "ids": [np.array(ids, np.int64).tobytes()],
                "sizes": [sizes.tobytes()],
                "digests": [b"".join(map(xxhash.xxh3_128_digest, texts))],
                "texts": [zstandard.compress(b"".join(texts), 3)],
            }
            ids.clear()
            texts.clear()
            return row

        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                ids.append(NO_ID if doc_id is None else doc_id)
                texts.append(text)
                held += len(text) + 16
                if held >= batch_bytes:
                    yield packed()
                    held = 0
        if ids:
            yield packed()

    return run


class Batch:
    """A batch's documents and its strings, grouped where neighbours have the same anchor."""

    def __init__(self, row: dict) -> None:
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.text = zstandard.decompress(row["texts"]) if row["bytes"] else b""
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.find_groups()

    def find_groups(self) -> None:
        """`first`, `last`: first and last string of each group; `anchor`, `doc`: its anchor and document."""
        n = len(self.text) - LENGTH + 1
        if n <= 0:
            self.first = self.last = self.doc = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.uint64)
            return
        self.runs = run_hashes(self.text)
        smallest = sliding_minimum(self.runs, LENGTH - RUN + 1)[:n]
        begins = np.ones(n, bool)
        begins[1:] = smallest[1:] != smallest[:-1]
        begins[self.starts[:-1][self.starts[:-1] < n]] = True
        first = np.flatnonzero(begins)
        length = np.diff(np.append(first, n))
        # Long groups, as in periodic text, are cut; the strings that would leave their document are at its end.
        pieces = -(-length // WINDOWS)
        owner = np.repeat(np.arange(len(first)), pieces)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        low = first[owner] + step * WINDOWS
        high = np.minimum(low + WINDOWS, first[owner] + length[owner])
        doc = np.searchsorted(self.starts, low, "right") - 1
        high = np.minimum(high, self.starts[doc + 1] - LENGTH + 1)
        real = low < high
        self.first, self.last, self.doc = low[real], high[real] - 1, doc[real]
        self.anchor = smallest[self.first]

    def piece_hashes(self) -> np.ndarray:
        """A hash of each group's piece, from the runs of bytes that cover it."""
        last = self.last + LENGTH - RUN
        total = (last - self.first).astype(np.uint64)
        for at in range(0, LENGTH + WINDOWS, RUN):
            total = mixed(total + self.runs[np.minimum(self.first + at, last)])
        return total


def mixed(values: np.ndarray) -> np.ndarray:
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    return values ^ (values >> np.uint64(32))


def run_hashes(data: bytes) -> np.ndarray:
    """A hash of the `RUN` bytes from each place on, from the 8-byte words that cover them."""
    n = len(data) - RUN + 1
    total = np.zeros(n, np.uint64)
    for k, at in enumerate(sorted({*range(0, RUN - 7, 8), RUN - 8})):
        word = np.ndarray((n,), "<u8", data, at, (1,))
        total += word * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64 | 1)
        total ^= total >> np.uint64(29)
    return mixed(total)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours."""
    n = len(values) - width + 1
    known, size = values, 1
    while 2 * size <= width:
        known = np.minimum(known[:-size], known[size:])
        size *= 2
    return np.minimum(known[:n], known[width - size : width - size + n])


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


def packed(*arrays: np.ndarray) -> list[bytes]:
    return [zlib.compress(np.ascontiguousarray(array).tobytes(), 1) for array in arrays]


def unpacked(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), kind)


def listed_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The documents of each batch that have a string, by the digest of their text."""
    for row in rows_of(batches):
        sizes, ids = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["ids"], np.int64)
        places = np.flatnonzero(sizes >= LENGTH)
        digests = [row["digests"][16 * place : 16 * place + 16] for place in places.tolist()]
        yield {"batch": np.full(len(places), row["batch"]), "place": places, "id": ids[places], "digest": digests}


def copies_of(packs: DataFrame) -> DataFrame:
    """`batch`, `copies`: places of documents whose whole text a document with a smaller id has."""
    rows = map_arrow(packs.select("batch", "ids", "sizes", "digests"), listed_documents, "batch long, place long, id long, digest binary")
    first = saved(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "copied")
    later = rows.join(first, "digest").filter("id > first")
    return later.groupBy("batch").agg(F.collect_list("place").alias("copies"))


class Listing:
    """A batch's different anchors in the order in which buckets get them: by bucket, then by number.

    Batches and buckets both know this order, so a bucket answers with a bit per anchor.
    """

    def __init__(self, anchors: np.ndarray, buckets: int) -> None:
        self.anchors, slot = np.unique(anchors, return_inverse=True)
        bucket = (self.anchors % np.uint64(buckets)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        at = np.empty_like(self.order)
        at[self.order] = np.arange(len(self.order))
        self.place = at[slot]
        listed = bucket[self.order]
        cuts = np.flatnonzero(np.diff(listed, prepend=-1))
        self.buckets, self.starts = listed[cuts], np.append(cuts, len(listed))

    def flags(self, told: list[dict], name: str) -> np.ndarray:
        """The bits that the buckets told, for each group of the batch."""
        every = np.zeros(len(self.order), bool)
        for answer, k in zip(told, np.searchsorted(self.buckets, [answer["bucket"] for answer in told]).tolist()):
            if answer[name]:
                a, b = self.starts[k], self.starts[k + 1]
                every[a:b] = np.unpackbits(np.frombuffer(answer[name], np.uint8), count=b - a)
        return every[self.place]


def anchors_by_bucket(buckets: int):
    """Per batch and bucket: its different anchors, their different pieces, and whether two of its documents have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for row in rows_of(batches):
            batch = Batch(row)
            if not len(batch.anchor):
                continue
            hashes = batch.piece_hashes()
            order = np.lexsort((hashes, batch.anchor))
            sorted_anchors, docs, hashes = batch.anchor[order], batch.doc[order], hashes[order]
            new = np.append(True, sorted_anchors[1:] != sorted_anchors[:-1])
            differ = new | np.append(True, hashes[1:] != hashes[:-1])
            other = np.append(False, docs[1:] != docs[:-1]) & ~new
            first = np.flatnonzero(new)
            anchors, several = sorted_anchors[first], np.logical_or.reduceat(other, first)
            counts = np.add.reduceat(differ, first, dtype=np.uint32)
            listing = Listing(anchors, buckets)
            groups = np.split(listing.order, listing.starts[1:-1])
            yield {
                "bucket": listing.buckets,
                "batch": [row["batch"]] * len(groups),
                # Sorted numbers of 48 bits: more than enough to forget most anchors; the rest is compared as text.
                "anchors": [short(anchors[some]) for some in groups],
                "several": [packed(np.packbits(several[some]))[0] for some in groups],
                "pieces": [packed(counts[some])[0] for some in groups],
            }

    return run


def short(anchors: np.ndarray) -> bytes:
    return np.ascontiguousarray((anchors >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def long(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def shared_anchors(hot: int):
    """For each batch of a bucket: bits of its anchors that two documents have, and of those with very many pieces."""

    def run(rows: pa.Table) -> pa.Table:
        blobs = [long(blob) for blob in rows.column("anchors").to_pylist()]
        sizes = [len(one) for one in blobs]
        several = [
            np.unpackbits(unpacked(blob, np.uint8))[:size].astype(bool)
            for blob, size in zip(rows.column("several").to_pylist(), sizes)
        ]
        every, mine = np.concatenate(blobs), np.repeat(np.arange(len(sizes)), sizes)
        _, slot, count = np.unique(every, return_inverse=True, return_counts=True)
        shared = (count[slot] > 1) | (np.bincount(slot, np.concatenate(several)) > 0)[slot]
        pieces = together(rows.column("pieces").to_pylist(), np.uint32)
        often = (np.bincount(slot, pieces) > hot)[slot]
        cuts = np.cumsum(sizes)[:-1]
        kept, frequent = np.split(shared, cuts), np.split(shared & often, cuts)
        some = [k for k, one in enumerate(kept) if one.any()]
        bits = [[np.packbits(one[k]).tobytes() if one[k].any() else b"" for k in some] for one in (kept, frequent)]
        chosen = rows.select(["batch", "bucket"]).take(pa.array(some, pa.int64()))
        return chosen.append_column("shared", pa.array(bits[0], pa.binary())).append_column("hot", pa.array(bits[1], pa.binary()))

    return run


def together(blobs: list[bytes] | None, kind=np.uint64) -> np.ndarray:
    return np.concatenate([unpacked(blob, kind) for blob in blobs]) if blobs else np.zeros(0, kind)


def wanted_groups(batch: Batch, row: dict, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Groups of shared anchors: those that are sent as pieces, and those of hot anchors.

    Copies need none: all of their strings are in an earlier document.
    """
    listing = Listing(batch.anchor, buckets)
    wanted, often = listing.flags(row["told"], "shared"), listing.flags(row["told"], "hot")
    if row["copies"]:
        wanted &= ~np.isin(batch.doc, row["copies"])
    return np.flatnonzero(wanted & ~often), np.flatnonzero(wanted & often)


def piece_texts(batch: Batch, groups: np.ndarray) -> list[bytes]:
    return [batch.text[a : b + LENGTH] for a, b in zip(batch.first[groups].tolist(), batch.last[groups].tolist())]


def hot_places(batch: Batch, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each string of the groups: where it begins, and its document's place."""
    counts = batch.last[groups] - batch.first[groups] + 1
    return np.repeat(batch.first[groups], counts) + spread(counts), np.repeat(batch.doc[groups], counts)


def hot_digests(batch: Batch, places: np.ndarray) -> list[bytes]:
    return [xxhash.xxh3_128_digest(batch.text[at : at + LENGTH]) for at in places.tolist()]


def hot_strings(buckets: int):
    """Per batch: the different strings of hot anchors, with the smallest and the largest document that has each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for row in rows_of(batches):
            batch = Batch(row)
            places, docs = hot_places(batch, wanted_groups(batch, row, buckets)[1])
            span: dict[bytes, tuple[int, int]] = {}
            for digest, doc in zip(hot_digests(batch, places), batch.ids[docs].tolist()):
                low, high = span.get(digest, (doc, doc))
                span[digest] = min(low, doc), max(high, doc)
            if span:
                low, high = np.array(list(span.values()), np.int64).T
                yield {"batch": np.full(len(span), row["batch"]), "digest": list(span), "low": low, "high": high}

    return run


def hot_firsts(work: DataFrame, buckets: int) -> DataFrame:
    """`batch`, `strings`: the strings of hot anchors that a smaller document has, and the smallest one."""
    some = work.filter(F.exists("told", lambda one: F.octet_length(one["hot"]) > 0))
    rows = saved(map_arrow(some, hot_strings(buckets), "batch long, digest binary, low long, high long"), "hot-strings")
    spans = rows.groupBy("digest").agg(F.min("low").alias("first"), F.max("high").alias("end"))
    known = rows.join(spans.filter("first < end").drop("end"), "digest").filter("first < high")
    return known.groupBy("batch").agg(F.collect_list(F.struct("digest", "first")).alias("strings"))


def digests(texts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts))


def pieces_by_shard(buckets: int):
    """Per batch and shard: different pieces, with the smallest and the largest document that has each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for row in rows_of(batches):
            if not row["told"]:
                continue
            batch = Batch(row)
            groups, _ = wanted_groups(batch, row, buckets)
            if not len(groups):
                continue
            texts, keys, docs = piece_texts(batch, groups), batch.anchor[groups], batch.ids[batch.doc[groups]]
            _, one, slot = np.unique(digests(texts), return_index=True, return_inverse=True)
            low, high = np.full(len(one), NO_ID), np.full(len(one), np.iinfo(np.int64).min)
            np.minimum.at(low, slot, docs)
            np.maximum.at(high, slot, docs)
            shard = (mixed(keys[one]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(shard[order], prepend=-1))[1:]):
                mine = [texts[k] for k in one[some].tolist()]
                sizes = np.array([len(text) for text in mine], np.uint16)
                blobs = packed(keys[one[some]], sizes, low[some], high[some])
                names = ("keys", "sizes", "low", "high")
                yield {"shard": [int(shard[some[0]])], "batch": [row["batch"]]} | {
                    name: [blob] for name, blob in zip(names, blobs)
                } | {"texts": [zstandard.compress(b"".join(mine), 3)]}

    return run


def suffix_words(data: bytes, n: int, more: int) -> np.ndarray:
    """The 8 bytes from each place on as a number that sorts as they do, with `more` zeros behind."""
    words = np.zeros(n + more, np.uint64)
    words[:n] = np.ndarray((n,), ">u8", data + bytes(8), 0, (1,))
    return words


def repeated_starts(words: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """The places whose first `least` bytes occur again; no other suffix is in an interval of that length."""
    total = np.zeros(len(starts), np.uint64)
    for at in range(0, least, 8):
        unused = max(0, at + 8 - least) * 8
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + (words[starts + at] >> np.uint64(unused)) + np.uint64(1))
    _, slot, count = np.unique(total, return_inverse=True, return_counts=True)
    return starts[count[slot] > 1]


def common_prefixes(words: np.ndarray, places: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each sorted suffix shares with the one before it, at most to the end of either piece."""
    a, b = places[:-1], places[1:]
    shared, same = np.zeros(len(a), np.int64), np.ones(len(a), bool)
    for k in range(depth):
        differ = words[a + 8 * k] ^ words[b + 8 * k]
        for byte in range(8):
            same &= (differ >> np.uint64(56 - 8 * byte)) == 0
            shared += same
        if not same.any():
            break
    return np.minimum(shared, np.minimum(room[a], room[b]))


def intervals(shared: np.ndarray, least: int) -> np.ndarray:
    """Common-prefix intervals of at least `least` bytes, found with a stack: rows of length, first and last place."""
    stack: list[tuple[int, int]] = []
    found: list[tuple[int, int, int]] = []
    end = 0
    hits = np.flatnonzero(shared >= least)
    for at, value in zip(hits.tolist(), shared[hits].tolist()):
        low = at
        if stack and at > end:
            while stack:
                length, first = stack.pop()
                found.append((length, first, end))
        while stack and stack[-1][0] > value:
            length, low = stack.pop()
            found.append((length, low, at))
        if not stack or stack[-1][0] < value:
            stack.append((value, low))
        end = at + 1
    while stack:
        length, first = stack.pop()
        found.append((length, first, end))
    return np.array(found, np.int64).reshape(-1, 3)


def repeat_intervals(pieces: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places of suffixes of the pieces, joined by one separator each, and the intervals that are maximal repeats.

    Intervals whose occurrences all follow the same byte are left out: the longer repeat that begins there has the same
    occurrences. Pieces hold no byte 255, as UTF-8 does not.
    """
    data = b"\xff".join(pieces) + b"\xff"
    sizes = np.array([len(piece) + 1 for piece in pieces])
    room = np.repeat(np.cumsum(sizes) - 1, sizes) - np.arange(len(data))
    depth = -(-int(sizes.max()) // 8) + 1
    words = suffix_words(data, len(data), 8 * depth + 8)
    starts = repeated_starts(words, np.flatnonzero(room >= max(least, 1)), least)
    if not len(starts):
        return starts, np.zeros((0, 3), np.int64)
    places = starts[np.lexsort([words[starts + 8 * k] for k in range(depth - 1, -1, -1)])]
    found = intervals(common_prefixes(words, places, room, depth), least)
    # The byte before each suffix; the first of a piece differs from all others.
    before = np.frombuffer(data, np.uint8)[places - 1].astype(np.int64)
    before = np.where((places == 0) | (before == 255), 256 + np.arange(len(places)), before)
    changes = np.concatenate(([0], np.cumsum(before[1:] != before[:-1])))
    return places, found[changes[found[:, 2]] > changes[found[:, 1]]]


def maximal_repeats(pieces: list[bytes], least: int = LENGTH) -> Iterator[tuple[int, np.ndarray]]:
    """Length and all places of every repeat that can be extended neither to the left nor to the right without losing an
    occurrence."""
    places, found = repeat_intervals(pieces, least)
    for length, first, last in found.tolist():
        yield length, places[first : last + 1]


def spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, … for each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def first_documents(pieces: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For each string of each piece, the smallest document of all pieces that hold it."""
    sizes = np.array([len(piece) + 1 for piece in pieces])
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(pieces)), sizes)
    first = docs[owner]
    places, found = repeat_intervals(pieces, LENGTH)
    if len(found):
        members = found[:, 2] - found[:, 1] + 1
        every = places[np.repeat(found[:, 1], members) + spread(members)]
        smallest = np.repeat(np.minimum.reduceat(docs[owner[every]], np.cumsum(members) - members), members)
        strings = np.repeat(found[:, 0] - LENGTH + 1, members)
        # Where the occurrence's own document is the smallest there is nothing to learn.
        news = smallest < docs[owner[every]]
        every, smallest, strings = every[news], smallest[news], strings[news]
        np.minimum.at(first, np.repeat(every, strings) + spread(strings), np.repeat(smallest, strings))
    return [first[a : a + size - LENGTH] for a, size in zip(starts.tolist(), sizes.tolist())]


def first_by_batch(rows: pa.Table) -> pa.Table:
    """For each batch of a shard: the pieces in which a smaller document has a string, and that document per string."""
    blobs = rows.select(["keys", "sizes", "low", "high", "texts"]).to_pylist()
    texts: list[bytes] = []
    for blob in blobs:
        joined, at = zstandard.decompress(blob["texts"]), 0
        for size in unpacked(blob["sizes"], np.uint16).tolist():
            texts.append(joined[at : at + size])
            at += size
    keys, low, high = (
        np.concatenate([unpacked(blob[name], kind) for blob in blobs])
        for name, kind in (("keys", np.uint64), ("low", np.int64), ("high", np.int64))
    )
    mine = np.repeat(np.arange(len(blobs)), [len(unpacked(blob["sizes"], np.uint16)) for blob in blobs])
    digest = digests(texts)
    _, one, slot = np.unique(digest, return_index=True, return_inverse=True)
    smallest = np.full(len(one), NO_ID)
    np.minimum.at(smallest, slot, low)

    # Only anchors with several different pieces need the array; anchors do not share strings.
    _, family, count = np.unique(keys[one], return_inverse=True, return_counts=True)
    firsts: dict[int, np.ndarray] = {}
    least = np.full(len(one), NO_ID)
    several = np.flatnonzero(count[family] > 1)
    several = several[np.argsort(family[several], kind="stable")]
    size = np.cumsum([len(texts[k]) for k in one[several].tolist()]) if len(several) else np.zeros(0)
    begin = 0
    while begin < len(several):
        stop = int(np.searchsorted(size, (size[begin - 1] if begin else 0) + CHUNK, "right"))
        stop = max(stop, begin + 1)
        while stop < len(several) and family[several[stop]] == family[several[stop - 1]]:
            stop += 1
        some = several[begin:stop]
        found = first_documents([texts[k] for k in one[some].tolist()], smallest[some])
        firsts.update(zip(some.tolist(), found))
        least[some] = [first.min() for first in found]
        begin = stop

    out: dict[str, list] = {"batch": [], "found": [], "counts": [], "firsts": [], "keys": []}
    numbers = rows.column("batch").to_pylist()
    in_array = np.zeros(len(one), bool)
    in_array[several] = True
    plain = ~in_array[slot] & (smallest[slot] < high)
    strung = in_array[slot] & (least[slot] < high)
    cuts = np.flatnonzero(np.diff(mine, prepend=-1)).tolist() + [len(mine)]
    for a, b in zip(cuts, cuts[1:]):
        simple = a + np.flatnonzero(plain[a:b])
        chosen, counts, docs = [simple], [np.ones(len(simple), np.uint16)], [smallest[slot[simple]]]
        some = a + np.flatnonzero(strung[a:b])
        per_string = [firsts[group] for group in slot[some].tolist()]
        chosen.append(some)
        counts.append(np.array([len(firsts_of) for firsts_of in per_string], np.uint16))
        docs += per_string
        which = np.concatenate(chosen).astype(np.int64)
        if len(which):
            arrays = (digest[which], np.concatenate(counts).astype(np.uint16), np.concatenate(docs), keys[which])
            for name, value in zip(out, (numbers[mine[a]], *packed(*arrays))):
                out[name].append(value)
    return pa.table(out, schema=pa.schema([("batch", pa.int64())] + [(name, pa.binary()) for name in list(out)[1:]]))


def removed_strings(batch: Batch, row: dict, buckets: int) -> np.ndarray:
    """Whether the string from each place on is one that a smaller document has."""
    marks = np.zeros(len(batch.text) + 1, bool)
    for place in row["copies"] or ():
        marks[batch.starts[place] : batch.starts[place + 1] - LENGTH + 1] = True
    if not row["told"]:
        return marks
    groups, often = wanted_groups(batch, row, buckets)
    if row["strings"]:
        first = {bytes(one["digest"]): one["first"] for one in row["strings"]}
        places, docs = hot_places(batch, often)
        smallest = [first.get(digest, NO_ID) for digest in hot_digests(batch, places)]
        marks[places] |= np.array(smallest, np.int64) < batch.ids[docs]
    if not row["found"]:
        return marks
    digest, counts, firsts = (
        np.concatenate([unpacked(blob, kind) for blob in row[name]])
        for name, kind in (("found", np.uint64), ("counts", np.uint16), ("firsts", np.int64))
    )
    ends = np.cumsum(counts.astype(np.int64))
    known = {d: firsts[end - count : end] for d, end, count in zip(digest.tolist(), ends.tolist(), counts.tolist())}
    groups = groups[np.isin(batch.anchor[groups], together(row["keys"]))]
    texts = piece_texts(batch, groups)
    docs = batch.ids[batch.doc[groups]]
    for text, doc, at, d in zip(texts, docs.tolist(), batch.first[groups].tolist(), digests(texts).tolist()):
        smaller = known.get(d)
        if smaller is not None:
            marks[at : at + len(text) - LENGTH + 1] = smaller < doc
    return marks


def cleaned(buckets: int):
    """The documents of each batch, with what is removed and what is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for row in rows_of(batches):
            batch = Batch(row)
            marks = removed_strings(batch, row, buckets)
            # A place is covered if a marked string begins on it or at most `LENGTH` - 1 places before it.
            change = np.zeros(len(batch.text) + LENGTH + 1, np.int64)
            at = np.flatnonzero(marks)
            change[at] += 1
            change[at + LENGTH] -= 1
            covered = np.cumsum(change)[: len(batch.text)] > 0
            text = np.frombuffer(batch.text, np.uint8)
            kept, spans = [], []
            for a, b in zip(batch.starts.tolist(), batch.starts[1:].tolist()):
                mine = covered[a:b]
                edges = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                spans.append([{"start": int(x), "end": int(y)} for x, y in edges])
                kept.append(text[a:b][~mine].tobytes() if len(edges) else batch.text[a:b])
            yield {
                "doc_id": [None if doc_id == NO_ID else doc_id for doc_id in batch.ids.tolist()],
                "n_bytes": batch.sizes,
                "spans": spans,
                "kept": kept,
            }

    return run


def remove_repeats(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    batch_bytes: int = BATCH_BYTES,
    buckets: int = BUCKETS,
    hot: int = HOT,
) -> DataFrame:
    """A row per document: `doc_id`, `n_bytes`, `spans` (removed runs of bytes, `start` and `end`), `kept` (the others).

    Texts are UTF-8 bytes. A byte is removed if it belongs to a string of `LENGTH` bytes that also begins in a document
    with a smaller id, as the input has it. NULL texts are empty. A NULL id counts as larger than every other; documents
    with equal ids, and NULL ids, remove nothing from each other. Repeated rows are documents of their own. An empty
    table gives no rows; other columns are not read. What is kept need not be whole characters.
    """
    rows = df.select(df[doc_id].cast("bigint").alias("doc_id"), df[text].cast("string").alias("text"))
    packs = saved(map_arrow(rows, batches_of(batch_bytes), BATCH), "batches")
    total = packs.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(buckets, -(-total // BUCKET_BYTES))
    anchors = map_arrow(packs, anchors_by_bucket(buckets), "bucket long, batch long, anchors binary, several binary, pieces binary")
    told = anchors.groupBy("bucket").applyInArrow(shared_anchors(hot), "batch long, bucket long, shared binary, hot binary")
    told = told.groupBy("batch").agg(F.collect_list(F.struct("bucket", "shared", "hot")).alias("told"))
    known = saved(told.join(copies_of(packs), "batch", "full"), "told")
    work = packs.join(known, "batch", "left")
    kinds = "shard long, batch long, keys binary, sizes binary, low binary, high binary, texts binary"
    pieces = map_arrow(work, pieces_by_shard(buckets), kinds)
    answers = pieces.groupBy("shard").applyInArrow(
        first_by_batch, "batch long, found binary, counts binary, firsts binary, keys binary"
    )
    lists = [F.collect_list(name).alias(name) for name in ("found", "counts", "firsts", "keys")]
    firsts = answers.groupBy("batch").agg(*lists).join(hot_firsts(work, buckets), "batch", "full")
    marked = work.join(firsts, "batch", "left")
    out = "doc_id long, n_bytes long, spans array<struct<start: bigint, end: bigint>>, kept binary"
    return map_arrow(marked, cleaned(buckets), out)
