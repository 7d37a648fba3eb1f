"""Fill-in-middle: documents cut into prefix, middle and suffix and put together in another order, and back again.

A document is a piece table: a short list of descriptors (buffer, start, end) over two buffers that never change, the
bytes of the text and those of the sentinels. Cutting splits descriptors, arranging permutes them, the inverse permutation
restores them, and digests read the described bytes one descriptor after the other. Text is copied only to be returned,
some megabytes of it at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muster.llm.common import by_bytes, map_arrow, texts_of, without

SEED = 42
# Of a hundred documents: how many are rearranged, and how many of those have their suffix first.
RATE, SUFFIX_FIRST = 50, 80
SENTINELS = (b"<P>", b"<S>", b"<M>")
PREFIX, SUFFIX, MIDDLE = range(3)
PLAIN, PSM, SPM = "plain", "psm", "spm"
# The order of the three parts in the output of each form.
ORDER = {PSM: (PREFIX, SUFFIX, MIDDLE), SPM: (SUFFIX, PREFIX, MIDDLE)}
TEXT, MARKS = 0, 1
MARK_BYTES = b"".join(SENTINELS)
ADDED = {
    "n": T.LongType(),
    "form": T.StringType(),
    "prefix_chars": T.LongType(),
    "middle_chars": T.LongType(),
    "output": T.StringType(),
    "output_sha256": T.StringType(),
}
RESTORED = {"restored": T.StringType(), "restored_sha256": T.StringType()}


class Span(NamedTuple):
    """Bytes of one buffer; an end behind the start, or none."""

    buffer: int
    start: int
    end: int


class Pieces:
    """A sequence of spans over the text and the sentinels."""

    def __init__(self, text: bytes, spans: Sequence[Span] | None = None) -> None:
        self.buffers = (memoryview(text), memoryview(MARK_BYTES))
        self.spans = [Span(TEXT, 0, len(text))] if spans is None else list(spans)

    def views(self) -> Iterator[memoryview]:
        for buffer, start, end in self.spans:
            yield self.buffers[buffer][start:end]

    def split(self, place: int) -> int:
        """Cut at a byte of the described sequence; the number of descriptors before the cut."""
        for at, (buffer, start, end) in enumerate(self.spans):
            if place <= 0:
                return at
            if place < end - start:
                self.spans[at : at + 1] = [Span(buffer, start, start + place), Span(buffer, start + place, end)]
                return at + 1
            place -= end - start
        return len(self.spans)

    def between(self, low: int, high: int) -> list[Span]:
        """Descriptors of the bytes from `low` to before `high`; those of empty parts are none."""
        first = self.split(low)
        return self.spans[first : first + self.split(high) - first] if high > low else []

    def digest(self) -> str:
        digest = hashlib.sha256()
        for view in self.views():
            digest.update(view)
        return digest.hexdigest()

    def written(self) -> bytes:
        return b"".join(self.views())


def sentinel(part: int) -> Span:
    start = sum(map(len, SENTINELS[:part]))
    return Span(MARKS, start, start + len(SENTINELS[part]))


def arranged(text: bytes, low: int, high: int, form: str) -> Pieces:
    """Prefix up to `low`, middle up to `high` and the rest, in the order of the form, each behind its sentinel."""
    table = Pieces(text)
    if form == PLAIN:
        return table
    parts = [()] * 3
    parts[PREFIX], parts[MIDDLE], parts[SUFFIX] = (
        table.between(a, b) for a, b in ((0, low), (low, high), (high, len(text)))
    )
    return Pieces(text, [span for part in ORDER[form] for span in (sentinel(part), *parts[part])])


def restored(output: bytes, form: str) -> Pieces:
    """The text again, from the output and its form alone: sentinels are found, cut out, and the order is undone.

    A rearranged text holds no sentinel of its own, and none arises where parts meet, so the first of each is the one
    that was put there. An output without the sentinels of its form is taken as it is.
    """
    table = Pieces(output)
    if form not in ORDER:
        return table
    starts, behind = [], 0
    for part in ORDER[form]:
        at = output.find(SENTINELS[part], behind)
        if at < 0:
            return table
        behind = at + len(SENTINELS[part])
        starts.append((at, behind))
    ends = [at for at, _ in starts[1:]] + [len(output)]
    parts = {part: table.between(low, end) for part, (_, low), end in zip(ORDER[form], starts, ends)}
    return Pieces(output, [span for part in (PREFIX, MIDDLE, SUFFIX) for span in parts[part]])


def token_ends(text: bytes) -> np.ndarray:
    """Where tokens end: a run of other bytes with the white space before it, or white space at the end of the text."""
    codes = np.frombuffer(text, np.uint8)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(text)) if len(text) else ends


def code_points(text: bytes, low: int, high: int) -> int:
    codes = np.frombuffer(text, np.uint8)[low:high]
    return int(np.count_nonzero((codes & 0xC0) != 0x80))


def drawn(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers that follow from the seed and the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[at : at + 8], 16) for at in range(0, 32, 8)]


def chosen(text: bytes, doc_id: int | None, seed: int, rate: int, suffix_first: int) -> tuple[int, str, int, int]:
    """Number of tokens, form, and the bytes where prefix and middle end."""
    ends = token_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = drawn(seed, doc_id)
    if not n or h3 % 100 >= rate or any(mark in text for mark in SENTINELS):
        return n, PLAIN, 0, 0
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    places = (int(ends[cut - 1]) if cut else 0 for cut in (low, high))
    return n, SPM if h4 % 100 < suffix_first else PSM, *places


def rearrange(
    df: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    seed: int = SEED,
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """All columns and `n`, `form`, `prefix_chars`, `middle_chars`, `output`, `output_sha256`.

    The cuts fall between tokens (a run of other characters with the ASCII white space before it, or white space at the
    end) and follow from the seed and the id alone, so every run cuts alike. Documents that are empty, that hold a
    sentinel, or that are not drawn stay plain: the output is the text and the lengths are NULL. A NULL text is an empty
    one. A NULL id draws like an empty id, repeated ids draw alike. Columns named like the added ones are replaced; an
    empty table gives an empty table.
    """
    rest = without(df.schema, list(ADDED))
    kept = df.withColumn(text, F.col(f"`{text}`").cast("string")).schema
    fields = [kept[name] for name in rest] + [T.StructField(name, kind) for name, kind in ADDED.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in by_bytes(batches, text):
            rows = []
            for key, value in zip(batch.column(doc_id).to_pylist(), texts_of(batch.column(text))):
                n, form, low, high = chosen(value, key, seed, rate, suffix_first)
                table = arranged(value, low, high, form)
                lengths = (None, None) if form == PLAIN else (code_points(value, 0, low), code_points(value, low, high))
                rows.append((n, form, *lengths, table.written(), table.digest()))
            columns = dict(zip(ADDED, map(list, zip(*rows))))
            columns["output"] = pa.array(columns["output"], pa.binary()).cast(pa.string())
            yield {name: batch.column(name) for name in rest} | columns

    return map_arrow(df.withColumn(text, F.col(f"`{text}`").cast("string")), run, T.StructType(fields))


def restore(df: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """All columns and `restored`, `restored_sha256`: the texts that `rearrange` was given, from its output and form.

    A NULL output is an empty one, a NULL or unknown form is plain. Columns named like the added ones are replaced.
    """
    rest = without(df.schema, list(RESTORED))
    fields = [df.schema[name] for name in rest] + [T.StructField(name, kind) for name, kind in RESTORED.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in by_bytes(batches, output):
            tables = [restored(value, how) for value, how in zip(texts_of(batch.column(output)), batch.column(form).to_pylist())]
            yield {name: batch.column(name) for name in rest} | {
                "restored": pa.array([table.written() for table in tables], pa.binary()).cast(pa.string()),
                "restored_sha256": [table.digest() for table in tables],
            }

    return map_arrow(df, run, T.StructType(fields))
