"""SentencePiece encoding and decoding, of models with merges by score and bytes for unknown characters.

Merging ends in the one sequence of pieces of which every two neighbours are compatible: merging their joined text gives
the two again. So each prefix of a text has one last piece. A table holds it: an automaton lists the pieces that end at
a place, the longest first, and the one that is compatible with the last piece of the prefix before it is stored. The
ids are read off the table from the end. That is linear in the text, whatever its characters.

Which pieces are compatible follows from the merge that made each piece, taken back from the newest on both sides of
their border. Where scores are equal, which holds for runs of white space, the joined text is merged instead.

Texts are cut where no piece reaches across, and short parts met before are not encoded again.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muster.llm.common import map_arrow, texts_of, without

SPACE = "▁"
BAD = "�"
# Parts of at most so many characters are remembered, up to twice so many of them in a task; likewise pairs of pieces.
SHORT, REMEMBERED = 64, 1 << 18
PAIRS = 1 << 19
# Rows that are encoded or decoded before they are handed on.
ROWS = 256
# The parts of longer texts are not listed all at once.
LONG = 1 << 20
# Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
FIRST = -1


class Vocabulary(NamedTuple):
    """What a model file says, and the merge that makes each piece."""

    pieces: list[str]
    kinds: list[int]
    # Rank of a normal piece by score, equal for equal scores; the smaller is merged first.
    ranks: list[int]
    # The two pieces that a piece is merged from last; None for single characters and pieces that merging never gives.
    splits: list[tuple[int, int] | None]
    # Whether merging the text of a piece gives that piece.
    reached: list[bool]
    # Whether each merge of a piece has a rank of its own above those before it.
    plain: list[bool]
    dummy_prefix: bool
    unknown: str


def merged(text: str, ids: dict[str, int], ranks: list[int]) -> tuple[list[str], tuple[str, str] | None]:
    """Neighbours are joined, the best score first and the leftmost of equal ones, while that gives a piece.

    Also the two parts of the last join. Quadratic, for texts of two pieces at most.
    """
    parts, last = list(text), None
    while True:
        best, at = None, -1
        for k in range(len(parts) - 1):
            piece = ids.get(parts[k] + parts[k + 1])
            if piece is not None and (best is None or ranks[piece] < best):
                best, at = ranks[piece], k
        if best is None:
            return parts, last
        last = parts[at], parts[at + 1]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    """Read a model; only such as need no other normal form and hold no pieces that users defined."""
    from sentencepiece import sentencepiece_model_pb2

    read = sentencepiece_model_pb2.ModelProto()
    read.ParseFromString(model)
    form, trained = read.normalizer_spec, read.trainer_spec
    kinds = [piece.type for piece in read.pieces]
    fits = (
        trained.model_type == trained.BPE
        and trained.byte_fallback
        and not trained.treat_whitespace_as_suffix
        and form.escape_whitespaces
        and not form.precompiled_charsmap
        and not form.remove_extra_whitespaces
        and not read.denormalizer_spec.precompiled_charsmap
        and set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}
    )
    if not fits:
        raise ValueError("a model with merges, bytes for unknown characters and unchanged white space is needed")
    pieces = [piece.piece for piece in read.pieces]
    scores = [piece.score for piece in read.pieces]
    order = {score: rank for rank, score in enumerate(sorted({s for s, k in zip(scores, kinds) if k == NORMAL}, reverse=True))}
    ranks = [order[score] if kind == NORMAL else -1 for score, kind in zip(scores, kinds)]
    ids = {piece: k for k, piece in enumerate(pieces) if kinds[k] == NORMAL}
    if not all(letter in ids for piece in ids for letter in piece):
        raise ValueError("a model with a piece for every character of its pieces is needed")
    splits, reached, plain = [None] * len(pieces), [False] * len(pieces), [False] * len(pieces)
    shared = {rank for rank, n in Counter(ranks).items() if n > 1}
    for piece, k in sorted(ids.items(), key=lambda item: len(item[0])):
        parts, last = merged(piece, ids, ranks)
        reached[k] = len(parts) == 1
        if reached[k] and last is not None:
            left, right = splits[k] = ids[last[0]], ids[last[1]]
            older = all(splits[part] is None or ranks[part] < ranks[k] for part in (left, right))
            plain[k] = older and plain[left] and plain[right] and ranks[k] not in shared
        else:
            plain[k] = reached[k]
    return Vocabulary(pieces, kinds, ranks, splits, reached, plain, form.add_dummy_prefix, trained.unk_surface)


def in_class(characters) -> str:
    return "".join(map(re.escape, sorted(characters)))


class Decoder:
    """Decodes with one vocabulary."""

    def __init__(self, known: Vocabulary) -> None:
        self.known = known
        # What a piece stands for; leading white space is taken off later, where it is the first.
        self.surfaces = [self.surface(k) for k in range(len(known.pieces))]

    def surface(self, piece: int) -> bytes:
        kind, text = self.known.kinds[piece], self.known.pieces[piece]
        if kind == CONTROL:
            return b""
        if kind == BYTE:
            return bytes([int(text[1:-1], 16)])
        return (self.known.unknown if kind == UNKNOWN else text.replace(SPACE, " ")).encode()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: white space for its sign, without the one put before the text, bytes joined to characters."""
        kinds, surfaces = self.known.kinds, self.surfaces
        data = b"".join(map(surfaces.__getitem__, ids))
        if self.known.dummy_prefix and data.startswith(b" "):
            first = next(k for k in ids if surfaces[k])
            if kinds[first] == NORMAL:
                data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return replaced(data)


class Encoder:
    """Encodes with one vocabulary."""

    def __init__(self, known: Vocabulary) -> None:
        import ahocorasick

        self.known = known
        self.ids = {piece: k for k, piece in enumerate(known.pieces) if known.kinds[k] == NORMAL}
        self.bytes = {int(piece[1:-1], 16): k for k, piece in enumerate(known.pieces) if known.kinds[k] == BYTE}
        self.merges = {split: k for k, split in enumerate(known.splits) if split is not None}
        self.automaton = ahocorasick.Automaton()
        for piece, k in self.ids.items():
            if known.reached[k]:
                self.automaton.add_word(piece, k)
        self.automaton.make_automaton()
        single = {piece for piece in self.ids if len(piece) == 1}
        # A character without a piece of its own is in no piece, so nothing reaches across it.
        self.letters = single
        rest = in_class(single - {SPACE})
        inner = any(SPACE in piece.lstrip(SPACE) for piece in self.ids)
        cut = f"[{rest}{SPACE}]+" if inner else f"{SPACE}*[{rest}]+|{SPACE}+"
        self.parts = re.compile(f"{cut}|[^{rest}{SPACE}]+")
        self.pairs: dict[tuple[int, int], bool] = {}
        # Parts met lately, and those met before them: parts that come often are always in one of the two.
        self.remembered: dict[str, list[int]] = {}
        self.earlier: dict[str, list[int]] = {}
        self.lengths = [len(piece) for piece in known.pieces]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined text of two pieces gives these two."""
        key = left, right
        answer = self.pairs.get(key)
        if answer is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            plain = self.known.plain
            answer = self.pairs[key] = self.unjoined(left, right) if plain[left] and plain[right] else self.remerged(left, right)
        return answer

    def remerged(self, left: int, right: int) -> bool:
        pieces = self.known.pieces
        return merged(pieces[left] + pieces[right], self.ids, self.known.ranks)[0] == [pieces[left], pieces[right]]

    def unjoined(self, left: int, right: int) -> bool:
        """Take back the newest merge on either side of the border, until no merge is left.

        At each step the two pieces at the border must not have been joined before the merge that is taken back: their
        join would have come first if its rank were smaller, or equal and its place further left.
        """
        ranks, splits, merges = self.known.ranks, self.known.splits, self.merges
        until = len(ranks)
        while True:
            joined = merges.get((left, right))
            if joined is not None and ranks[joined] < until:
                return False
            a, b = splits[left], splits[right]
            if a is None and b is None:
                return True
            if b is None or (a is not None and ranks[left] > ranks[right]):
                until, left = ranks[left], a[1]
            else:
                until, right = ranks[right] + 1, b[0]

    def table(self, text: str) -> list[int]:
        """The last piece of every prefix of a text whose characters all have pieces, from the prefix of one character."""
        last, lengths, answers = [FIRST] * len(text), self.lengths, self.pairs.get
        for end, piece in self.automaton.iter(text):
            if last[end] < 0:
                before = end - lengths[piece]
                if before < 0:
                    last[end] = piece
                else:
                    left = last[before]
                    answer = answers((left, piece))
                    if answer or (answer is None and self.compatible(left, piece)):
                        last[end] = piece
        if FIRST in last:
            raise ValueError(f"a prefix without a last piece in {text[:40]!r}")
        return last

    def ids_of_part(self, part: str) -> list[int]:
        if part[0] not in self.letters:
            return [self.bytes[code] for code in part.encode()]
        last, lengths, at, ids = self.table(part), self.lengths, len(part) - 1, []
        while at >= 0:
            piece = last[at]
            ids.append(piece)
            at -= lengths[piece]
        ids.reverse()
        return ids

    def encode(self, text: str) -> list[int]:
        """The ids of a text, without those for its begin and end."""
        if not text:
            return []
        text = text.replace(" ", SPACE)
        ids, remembered = [], self.remembered
        text = SPACE + text if self.known.dummy_prefix else text
        parts = self.parts.findall(text) if len(text) < LONG else (one.group() for one in self.parts.finditer(text))
        for part in parts:
            found = remembered.get(part)
            if found is None:
                found = self.earlier.get(part) or self.ids_of_part(part)
                if len(part) <= SHORT:
                    if len(remembered) >= REMEMBERED:
                        self.earlier, self.remembered = remembered, {}
                        remembered = self.remembered
                    remembered[part] = found
            ids += found
        return ids


def replaced(data: bytes) -> str:
    """Characters as far as bytes are some; each other byte is the sign for a bad character."""
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as bad:
            out += [data[at : at + bad.start].decode(), BAD]
            at += bad.start + 1
    return "".join(out)


# The last coder of each kind that this process has made, so that tasks that follow each other use what it remembers.
MADE: dict[type, tuple[Vocabulary, object]] = {}


def coder(kind: type, known: Vocabulary):
    if MADE.get(kind, (None, None))[0] is not known:
        MADE[kind] = known, kind(known)
    return MADE[kind][1]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some rows at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            yield batch.slice(low, ROWS)


def shared_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary for every task; its size is that of the model file, whatever the number of documents."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(vocabulary(file.read()))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns and `ids`: an array of the ids of the text's pieces, without begin or end, nothing sampled.

    `path` names the model file on the driver. NULL and empty texts have no ids; every row is a text of its own. A column
    named like the added one is replaced; an empty table gives an empty table.
    """
    known = shared_vocabulary(df.sparkSession, path)
    given = df.withColumn(text, F.col(f"`{text}`").cast("string"))
    rest = without(given.schema, [ids])
    fields = [given.schema[name] for name in rest] + [T.StructField(ids, T.ArrayType(T.IntegerType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = coder(Encoder, known.value)
        for batch in slices(batches):
            found = [encoder.encode(value.decode("utf-8", "replace")) for value in texts_of(batch.column(text))]
            yield {name: batch.column(name) for name in rest} | {ids: pa.array(found, pa.list_(pa.int32()))}

    return map_arrow(given, run, T.StructType(fields))


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns and `decoded`: the text of an array of ids.

    NULL and empty arrays, and NULL ids, give an empty text; ids that the vocabulary does not have stop the query. A
    column named like the added one is replaced.
    """
    known = shared_vocabulary(df.sparkSession, path)
    given = df.withColumn(ids, F.filter(F.col(f"`{ids}`").cast("array<int>"), lambda k: k.isNotNull()))
    rest = without(given.schema, [decoded])
    fields = [given.schema[name] for name in rest] + [T.StructField(decoded, T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        decoder = coder(Decoder, known.value)
        for batch in slices(batches):
            lists = [row.values for row in batch.column(ids)]
            texts = [decoder.decode([] if some is None else some.to_numpy(zero_copy_only=False).tolist()) for some in lists]
            yield {name: batch.column(name) for name in rest} | {decoded: texts}

    return map_arrow(given, run, T.StructType(fields))
