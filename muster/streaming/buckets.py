"""Keys dealt to buckets that share a state.

A stateful processor asks Spark for its state through a socket, call by call. With a state per key the calls of a
micro-batch grow with its keys and rows; with a state per bucket they are a few per bucket, and rows cross in chunks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator, Sequence
from itertools import batched

from pyspark.sql import Column, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessorHandle

BUCKET = "_bucket"
# A bucket's rows are sorted by one task, as those of a key are; more buckets mean fewer rows in each and more calls.
BUCKETS = 1024
CHUNK = 5000


def bucket_of(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{key}`") for key in keys]), F.lit(BUCKETS)).cast("int")


def alike(value: object) -> object:
    """The same, and hashable, for values that Spark groups together."""
    if isinstance(value, float):
        return "NaN" if value != value else value
    if isinstance(value, (list, tuple)):
        return tuple(map(alike, value))
    return bytes(value) if isinstance(value, bytearray) else value


def values_of(rows: Iterable[Row], names: Sequence[str]) -> Iterator[tuple]:
    """The named columns of rows that all have the same columns."""
    places: list[int] = []
    for row in rows:
        places = places or [row.__fields__.index(name) for name in names]
        yield tuple([row[at] for at in places])


class Chunks:
    """Tuples in list state, some thousand to an element."""

    def __init__(self, handle: StatefulProcessorHandle, name: str) -> None:
        self.state = handle.getListState(name, T.StructType([T.StructField("rows", T.BinaryType())]))

    def append(self, rows: Iterable[tuple]) -> None:
        for some in batched(rows, CHUNK):
            self.state.appendList([(pickle.dumps(some),)])

    def rows(self) -> Iterator[tuple]:
        for (some,) in self.state.get():
            yield from pickle.loads(some)

    def put(self, rows: Iterable[tuple]) -> None:
        replace(self.state, [(pickle.dumps(some),) for some in batched(rows, CHUNK)])


def replace(state, rows: list[tuple]) -> None:
    """Put a list of any length into a list state."""
    if rows:
        state.put(rows)
    else:
        state.clear()
