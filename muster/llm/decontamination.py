"""Training documents that hold benchmark items.

Items are in a BM25 inverted index whose postings carry their impact, cut into blocks with the largest impact of each.
An impact is a term's share of the score that the item's own text would get, so a passage that holds a whole item scores
1 and one threshold serves all items. Every passage of every document is a query, answered by block-max WAND with all
items above the threshold; an item is found if enough of the words of its question and answer follow each other there.

Passages are two neighbouring blocks of words, so that an item lies within one of them wherever it stands; items are
classed by length, and each class has blocks of its own length. What the pivot test of WAND would find first, whether
the rarer terms and all that the common terms may add can reach the threshold at all, is asked for many passages at once.

The index is broadcast, so its size is checked: items of more than `INDEX_BYTES` are indexed in parts, and the rows are
written between parts, so that no task holds two. All parts have the word counts of all items, and a passage is searched for
the items of its own class only, so neither parts nor other items change what is found or its score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muster.llm.common import fresh, map_arrow, saved, shared, texts_of

K1, B = 1.2, 0.75
LEAST_SCORE = 0.7
LEAST_OVERLAP = 0.8
WORDS = 5
BLOCK = 64
COMMON = 10
INDEX_BYTES = 32 * 1024 * 1024
GROUP_WORDS = 200_000
WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"[.!?…][\"'”»)]*\s+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer: what follows the last question mark, else the last sentence."""
    text = text.strip()
    at = text.rfind("?", 0, max(0, len(text) - 1)) + 1
    if not at:
        ends = [found.end() for found in SENTENCE_END.finditer(text)]
        at = ends[-1] if ends else len(text)
    return words_of(text[:at]), words_of(text[at:])


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    """Runs of five words; fewer words are one run."""
    return {tuple(words[k : k + WORDS]) for k in range(max(1, len(words) - WORDS + 1))} if words else set()


def share(part: set, whole: set) -> float:
    return len(part & whole) / len(part) if part else 1.0


class Item:
    """What is needed to verify an item."""

    def __init__(self, item_id: int, text: str) -> None:
        self.item_id = item_id
        self.words = words_of(text)
        # Words of a block of its class.
        self.length = max(16, 1 << max(0, len(self.words) - 1).bit_length())
        question, answer = question_and_answer(text)
        self.runs, self.question, self.answer = shingles(self.words), shingles(question), set(answer)

    def overlaps(self, passage: list[str]) -> tuple[float, float, float]:
        """Shares of the runs of the item, of those of its question, and of the words of its answer."""
        if len(self.words) < WORDS:
            n = len(self.words)
            runs = {tuple(passage[k : k + n]) for k in range(len(passage) - n + 1)}
            whole = share(self.runs, runs)
            return whole, whole, whole
        runs = shingles(passage)
        question = self.question if all(len(run) == WORDS for run in self.question) else set()
        return share(self.runs, runs), share(question, runs), share(self.answer, set(passage))


def holds(overlaps: tuple[float, float, float]) -> bool:
    """The item's runs are there, or its question's runs and its answer's words (and most of the item with them)."""
    whole, question, answer = overlaps
    return whole >= LEAST_OVERLAP or (question >= LEAST_OVERLAP and answer >= LEAST_OVERLAP and whole >= 0.5)


class Totals(NamedTuple):
    """Of all items, whatever part an index has of them: how many have words, their words, and items by word."""

    items: int
    words: int
    holding: dict[str, int]


class Index:
    """Postings by term: items in order, their impacts, the largest impact of each block and of the whole list."""

    def __init__(self, items: list[tuple[int, str]], totals: Totals | None = None) -> None:
        self.items = [item for item in (Item(*pair) for pair in sorted(items)) if item.words]
        counts = [Counter(item.words) for item in self.items]
        held = Counter(word for count in counts for word in count)
        n, n_words, holding = totals or (len(self.items), sum(len(item.words) for item in self.items), held)
        idf = {word: math.log(1 + (n - holding[word] + 0.5) / (holding[word] + 0.5)) for word in held}
        mean = n_words / max(1, n)
        postings: dict[str, list[tuple[int, float]]] = {word: [] for word in held}
        for at, (item, count) in enumerate(zip(self.items, counts)):
            norm = K1 * (1 - B + B * len(item.words) / mean)
            weights = {word: idf[word] * k * (K1 + 1) / (k + norm) for word, k in count.items()}
            total = sum(weights.values())
            for word, weight in weights.items():
                postings[word].append((at, weight / total))
        self.vocabulary = {word: number for number, word in enumerate(postings)}
        self.postings = [([at for at, _ in rows], [w for _, w in rows]) for rows in postings.values()]
        self.block_max = [[max(ws[k : k + BLOCK]) for k in range(0, len(ws), BLOCK)] for _, ws in self.postings]
        self.most = [max(blocks) for blocks in self.block_max]
        self.classes = self.length_classes()

    def length_classes(self) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per class: words of a block; where each term's rarer postings begin; their items and impacts; what all
        common terms may add to each item."""
        common = max(COMMON, len(self.items) // 50)
        by_length: dict[int, set[int]] = {}
        for at, item in enumerate(self.items):
            by_length.setdefault(item.length, set()).add(at)
        out = []
        for length, members in sorted(by_length.items()):
            starts, rows, weights, rest = [0], [], [], np.zeros(len(self.items))
            for items, impacts in self.postings:
                mine = [(at, w) for at, w in zip(items, impacts) if at in members]
                if len(items) <= common:
                    rows += [at for at, _ in mine]
                    weights += [w for _, w in mine]
                else:
                    for at, w in mine:
                        rest[at] += w
                starts.append(len(rows))
            out.append((length, np.array(starts), np.array(rows, np.int64), np.array(weights), rest))
        return out

    def search(self, terms: set[int], least: float) -> list[tuple[int, float]]:
        """All items that score at least `least`, by block-max WAND."""
        lists = [[0, *self.postings[t], self.block_max[t], self.most[t]] for t in terms]
        found = []
        while lists:
            lists.sort(key=lambda one: one[1][one[0]])
            bound, pivot = 0.0, None
            for k, one in enumerate(lists):
                bound += one[4]
                if bound >= least - 1e-9:
                    pivot = one[1][one[0]]
                    break
            if pivot is None:
                break
            while k + 1 < len(lists) and lists[k + 1][1][lists[k + 1][0]] == pivot:
                k += 1
            upto = lists[: k + 1]
            bound, end = 0.0, lists[k + 1][1][lists[k + 1][0]] if k + 1 < len(lists) else math.inf
            for one in upto:
                place = one[0]
                block = place // BLOCK
                while block < len(one[3]) and one[1][min(len(one[1]), (block + 1) * BLOCK) - 1] < pivot:
                    block += 1
                if block < len(one[3]):
                    bound += one[3][block]
                    end = min(end, one[1][min(len(one[1]), (block + 1) * BLOCK) - 1] + 1)
            if bound < least - 1e-9:
                target = max(end, pivot + 1)
            elif lists[0][1][lists[0][0]] == pivot:
                score = math.fsum(one[2][one[0]] for one in upto)
                if score >= least - 1e-9:
                    found.append((pivot, score))
                target = pivot + 1
            else:
                target = pivot
            for one in upto:
                place, items = one[0], one[1]
                while place < len(items) and items[place] < target:
                    jump = place + BLOCK
                    place = jump if jump < len(items) and items[jump] < target else place + 1
                one[0] = place
            lists = [one for one in lists if one[0] < len(one[1])]
        return found


def candidate_passages(index: Index, ids: np.ndarray, starts: np.ndarray, least: float) -> Iterator[tuple[int, int, int, int]]:
    """Class, document, first and last word of passages that may reach the threshold for an item of the class.

    `ids` are the terms of all documents one after the other, -1 for words that are in no item.
    """
    for length, first, rows, weights, rest in index.classes:
        if not len(rows) and not (rest >= least).any():
            continue
        # Blocks are numbered through all documents, with one number left free between documents.
        sizes = np.diff(starts)
        blocks = -(-sizes // length) + 1
        base = np.cumsum(blocks) - blocks
        doc = np.repeat(np.arange(len(sizes)), sizes)
        block = base[doc] + (np.arange(len(ids)) - starts[doc]) // length
        known = ids >= 0
        term, where = ids[known], block[known]
        pair = np.unique(where * len(index.postings) + term)
        term, where = pair % len(index.postings), pair // len(index.postings)
        count = first[term + 1] - first[term]
        owner = np.repeat(np.arange(len(term)), count)
        at = first[term][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        total = int(blocks.sum()) + 1
        if (rest >= least).any():
            hot = np.arange(total - 1)
        else:
            key, slot = np.unique(rows[at] * total + where[owner], return_inverse=True)
            score = np.bincount(slot, weights[at], len(key))
            follows = np.append(key[1:] == key[:-1] + 1, False)
            both = score + np.where(follows, np.append(score[1:], 0.0), 0.0)
            hot = np.unique(key[both + rest[key // total] >= least - 1e-9] % total)
            # A passage may also begin one block earlier, where the first block holds none of the item's rarer terms.
            alone = key[score + rest[key // total] >= least - 1e-9] % total
            hot = np.union1d(hot, alone - 1)
        which = np.searchsorted(base, hot, "right") - 1
        for number, k in zip(hot.tolist(), which.tolist()):
            low = (number - int(base[k])) * length
            if k >= 0 and 0 <= low < sizes[k]:
                yield length, k, low, min(low + 2 * length, int(sizes[k]))


def found_items(index: Index, texts: list[str], least: float) -> list[dict[int, tuple[float, float, float, float]]]:
    """Per document: the items it holds, with score and overlaps of the best passage."""
    known, out = index.vocabulary.get, [{} for _ in texts]
    words = [words_of(text) for text in texts]
    ids = np.array([known(word, -1) for some in words for word in some], np.int64)
    starts = np.concatenate(([0], np.cumsum([len(some) for some in words]))).astype(np.int64)
    for length, k, low, high in candidate_passages(index, ids, starts, least):
        terms = set(ids[starts[k] + low : starts[k] + high].tolist()) - {-1}
        for at, score in index.search(terms, least):
            item = index.items[at]
            if item.length != length:
                continue
            overlaps = item.overlaps(words[k][low:high])
            if holds(overlaps):
                best = out[k].get(item.item_id)
                out[k][item.item_id] = max(best, (score, *overlaps)) if best else (score, *overlaps)
    return out


MATCH = "array<struct<item_id: bigint, score: double, overlap: double, question_overlap: double, answer_overlap: double>>"


def with_items(
    df: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    name: str = "items",
    least: float = LEAST_SCORE,
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """All columns and `name`: an array of the items that the row's text holds, by item id, empty if none.

    An item is found if one passage has 0.8 of its different five-word runs, or 0.8 of those of its question and 0.8 of
    the words of its answer; an item of fewer words only as a whole. Case and signs between words do not matter. Items
    without words, NULL items and items without an id are never found; of items with one id, the text that sorts first
    counts. NULL and empty texts hold none. Every row is a document, repeated or without an id. A column of that name is
    replaced; empty tables give no rows, or rows without items.
    """
    given = items.select(items[item_id].cast("bigint").alias("item_id"), items[item_text].cast("string").alias("text"))
    usable = given.filter("item_id IS NOT NULL AND text IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text"))
    size = usable.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = max(1, math.ceil(size / index_bytes))
    rest = df.drop(name).withColumn(text, F.col(text).cast("string"))
    schema = T.StructType([*rest.schema.fields, T.StructField(name, T._parse_datatype_string(MATCH))])
    if parts == 1:
        index = shared(df, Index([(row["item_id"], row["text"]) for row in usable.collect()]))
        return map_arrow(rest, matched(index, text, name, least), schema)
    columns = [fresh(f"_{name}_{part}", df.columns) for part in range(parts)]
    result, usable = rest, saved(usable.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts))), "items")
    for part, (column, totals) in enumerate(zip(columns, totals_of_parts(usable, parts))):
        # One part is at most about `index_bytes` of text, whatever the number of items.
        rows = usable.filter(F.col("part") == part).collect()
        index = shared(df, Index([(row["item_id"], row["text"]) for row in rows], totals))
        fields = T.StructType([*result.schema.fields, T.StructField(column, schema[name].dataType)])
        result = saved(map_arrow(result, matched(index, text, column, least), fields), "decontamination")
    return result.withColumn(name, F.array_sort(F.concat(*columns))).drop(*columns)


def totals_of_parts(items: DataFrame, parts: int) -> Iterator[Totals]:
    """The totals of all items for each part, with the counts of the part's words only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            words = [words_of(one.decode("utf-8", "replace")) for one in texts_of(batch.column("text"))]
            yield {"part": batch.column("part"), "n": list(map(len, words)), "words": [sorted(set(some)) for some in words]}

    listed = saved(map_arrow(items.select("part", "text"), run, "part long, n long, words array<string>"), "item-words")
    n, n_words = listed.filter("n > 0").agg(F.count("*"), F.sum("n")).first()
    words = listed.select("part", F.explode("words").alias("word"))
    holding = saved(words.groupBy("word").agg(F.count("*").alias("n")), "item-word-counts")
    for part in range(parts):
        mine = holding.join(words.filter(F.col("part") == part).select("word").distinct(), "word", "left_semi")
        yield Totals(n, n_words or 0, {row["word"]: row["n"] for row in mine.collect()})


def matched(index, text: str, name: str, least: float):
    """A batch function that adds the items, for some thousand words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts = [one.decode("utf-8", "replace") for one in texts_of(batch.column(text))]
            found: list[dict] = []
            group: list[str] = []
            size = 0
            for at, one in enumerate(texts):
                group.append(one)
                size += len(one) // 5 + 1
                if size >= GROUP_WORDS or at == len(texts) - 1:
                    found += found_items(index.value, group, least)
                    group, size = [], 0
            names = ("item_id", "score", "overlap", "question_overlap", "answer_overlap")
            rows = [[dict(zip(names, (item, *one[item]))) for item in sorted(one)] for one in found]
            yield {column: batch.column(column) for column in batch.schema.names} | {name: rows}

    return run
