"""Ranked lexical search: the best documents for each item, with equal bags of words scored once.

Documents are restricted to the words of the items. What is left of a document is its bag (how often it holds which of
these words) and its measure of length; documents that agree in both are one class and have equal scores for every item.
Classes are grouped by a hash, and by bag and measure themselves, so that no two different ones are taken for one. Each
class is scored once, every task keeps the best classes of each item, and only classes that come among the best of all
are expanded to their documents, by ascending id.

Items are taken in blocks of bounded size, one after the other, so that what tasks hold does not grow with the items.
Counts of documents and words are those of all documents, so where blocks are cut does not matter to scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muster.llm.common import map_arrow, saved, shared, texts_of

BEST = 10
TERM, GAP = re.compile(rb"[0-9A-Za-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")
# Words of an item block, and items of a block: bounds of what is broadcast.
BLOCK_WORDS, BLOCK_ITEMS = 1 << 20, 1 << 16
# Texts are read in slices of so many bytes, cut between words.
SLICE = 1 << 20
# Numbers in a matrix of scores, and in one of weights of frequent words.
CELLS = 1 << 21
# Places of words in items that are added up at once.
PLACES = 1 << 22


def slices(text: bytes) -> Iterator[bytes]:
    """The lower-cased text in pieces that cut no word, however long the text."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            found = GAP.search(text, end)
            end = found.start() if found else len(text)
        yield text[at:end].lower()
        at = end


def term_counts(text: bytes) -> Counter:
    """How often a text holds each of its words: runs of ASCII letters and digits and other than ASCII characters."""
    counts: Counter = Counter()
    for piece in slices(text):
        counts.update(TERM.findall(piece))
    return counts


def item_terms(items: DataFrame) -> DataFrame:
    """`item_id`, `term`: the different words of each item. Rows of one id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            terms = [sorted(term_counts(text)) for text in texts_of(batch.column("text"))]
            yield {"item_id": batch.column("item_id"), "terms": pa.array(terms, pa.list_(pa.binary()))}

    found = map_arrow(items.filter("item_id IS NOT NULL"), run, "item_id long, terms array<binary>")
    return found.select("item_id", F.explode("terms").alias("term")).distinct()


class Block:
    """Items of one block: their words, numbered, and which items hold each."""

    def __init__(self, rows: list[tuple[int, bytes]]) -> None:
        self.items = np.array(sorted({item for item, _ in rows}), np.int64)
        self.vocabulary = {term: k for k, term in enumerate(sorted({term for _, term in rows}))}
        term = np.array([self.vocabulary[term] for _, term in rows], np.int64)
        item = np.searchsorted(self.items, np.array([item for item, _ in rows], np.int64))
        order = np.lexsort((item, term))
        self.holders = item[order]
        self.first = np.searchsorted(term[order], np.arange(len(self.vocabulary) + 1))


def bags_of(docs: DataFrame, block: Broadcast) -> DataFrame:
    """`doc_id`, `n`, `bag` of every document that has words: pairs of word and count as 32-bit numbers, by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known = block.value.vocabulary
        for batch in batches:
            sizes, bags = [], []
            for text in texts_of(batch.column("text")):
                counts = term_counts(text)
                sizes.append(counts.total())
                bag = sorted((known[term], n) for term, n in counts.items() if term in known)
                bags.append(np.array(bag, "<i4").tobytes())
            yield {"doc_id": batch.column("doc_id"), "n": sizes, "bag": pa.array(bags, pa.binary())}

    return map_arrow(docs, run, "doc_id long, n long, bag binary").filter("n > 0")


def pairs_in(bags: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words and counts of bags, one after the other, and the number of words of each bag."""
    pairs = np.frombuffer(b"".join(bags), "<i4").reshape(-1, 2).astype(np.int64)
    return pairs, np.array([len(bag) // 8 for bag in bags], np.int64)


def document_frequencies(bags: DataFrame) -> DataFrame:
    """`word`, `n_docs`: how many documents hold each word, counted inside every task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            pairs, _ = pairs_in(texts_of(batch.column("bag")))
            more = np.bincount(pairs[:, 0]) if len(pairs) else np.zeros(0, np.int64)
            low, high = sorted((counts, more), key=len)
            high = high.copy()
            high[: len(low)] += low
            counts = high
        words = np.flatnonzero(counts)
        yield {"word": words, "n": counts[words]}

    return map_arrow(bags.select("bag"), run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n_docs"))


def weight(n_docs: int, holding: int) -> int:
    """The weight of a word that `holding` of `n_docs` documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


class Scorer:
    """Scores of classes for the items of a block: exact whole numbers.

    The words that most items hold are multiplied as matrices, of which no sum comes near 2^53; those of the others are
    added up item by item.
    """

    def __init__(self, block: Block, weights: np.ndarray) -> None:
        self.block, self.weights = block, weights
        held = np.diff(block.first)
        n_items = len(block.items)
        heads = min(CELLS // max(n_items, 1), 4096, len(held))
        head = np.sort(np.argsort(-held, kind="stable")[:heads])
        head = head[held[head] > n_items // 64]
        self.column = np.full(len(held), -1, np.int64)
        self.column[head] = np.arange(len(head))
        self.matrix = np.zeros((len(head), n_items))
        for at, word in enumerate(head):
            self.matrix[at, block.holders[block.first[word] : block.first[word + 1]]] = 1

    def score(self, bags: list[bytes], measures: np.ndarray) -> np.ndarray:
        """A row per class, a column per item."""
        pairs, sizes = pairs_in(bags)
        owner, word, times = np.repeat(np.arange(len(bags)), sizes), pairs[:, 0], pairs[:, 1]
        gain = self.weights[word] * ((1_000_000_000 * times) // (1000 * times + 8 * measures[owner]))
        column = self.column[word]
        dense = column >= 0
        frequent = np.zeros((len(bags), len(self.matrix)))
        frequent[owner[dense], column[dense]] = gain[dense]
        scores = (frequent @ self.matrix).astype(np.int64)
        owner, word, gain = owner[~dense], word[~dense], gain[~dense]
        first = self.block.first
        held = first[word + 1] - first[word]
        ends = np.cumsum(held)
        flat, width, low = scores.reshape(-1), scores.shape[1], 0
        while low < len(word):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PLACES, "right")))
            some = held[low:high]
            which = np.repeat(np.arange(low, high), some)
            inside = np.arange(len(which)) - np.repeat(np.cumsum(some) - some, some)
            item = self.block.holders[first[word[which]] + inside]
            np.add.at(flat, owner[which] * width + item, gain[which])
            low = high
        return scores


class Leaders:
    """The best classes of each item so far: higher scores first, then smaller first documents."""

    def __init__(self, n_items: int, best: int) -> None:
        self.best, self.least = best, np.ones(n_items, np.int64)
        self.rows = np.zeros((4, 0), np.int64)

    def offer(self, scores: np.ndarray, firsts: np.ndarray, classes: np.ndarray) -> None:
        if len(scores) > self.best and np.count_nonzero(scores >= self.least) > 4 * self.best * scores.shape[1]:
            # At least `best` of these reach this score, so nothing below it can stay.
            kth = np.partition(scores, len(scores) - self.best, axis=0)[len(scores) - self.best]
            self.least = np.maximum(self.least, kth)
        at, item = np.nonzero(scores >= self.least)
        rows = np.concatenate([self.rows, np.array([item, scores[at, item], firsts[at], classes[at]])], axis=1)
        rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
        starts = np.searchsorted(rows[0], np.arange(len(self.least)))
        place = np.arange(rows.shape[1]) - starts[rows[0]]
        last = rows[:, place == self.best - 1]
        self.least[last[0]] = np.maximum(self.least[last[0]], last[1])
        self.rows = rows[:, place < self.best]


def best_classes(classes: DataFrame, block: Broadcast, weights: Broadcast, best: int) -> DataFrame:
    """`item_id`, `score`, `first_id`, `class`: of each task, the best classes of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        scorer, items = Scorer(block.value, weights.value), block.value.items
        leaders, rows = Leaders(len(items), best), max(1, CELLS // max(len(items), 1))
        for batch in batches:
            for low in range(0, batch.num_rows, rows):
                some = batch.slice(low, rows)
                measures, firsts, which = (some.column(name).to_numpy() for name in ("m", "first_id", "class"))
                leaders.offer(scorer.score(texts_of(some.column("bag")), measures), firsts, which)
        item, score, first, which = leaders.rows
        yield {"item_id": items[item], "score": score, "first_id": first, "class": which}

    return map_arrow(classes, run, "item_id long, score long, first_id long, class long")


def first_rows(df: DataFrame, keys: list[str], order: list, best: int, name: str) -> DataFrame:
    """The first `best` rows of each key with their number from 1; rows of a key are first thinned in 32 parts."""
    salt = F.pmod(F.xxhash64(*[F.col(column) for column in df.columns]), F.lit(32))
    parts = Window.partitionBy(*keys, "_salt").orderBy(*order)
    thin = df.withColumn("_salt", salt).withColumn("_place", F.row_number().over(parts)).filter(F.col("_place") <= best)
    ranked = thin.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(name) <= best).drop("_salt", "_place")


def ranked_block(docs: DataFrame, rows: list[tuple[int, bytes]], best: int) -> DataFrame:
    """The ranking for the items of one block."""
    made = Block(rows)
    block = shared(docs, made)
    bags = saved(bags_of(docs, block), "bags")
    n_docs, words = bags.agg(F.count("*"), F.sum(F.col("n").cast("decimal(38,0)"))).first()
    holding = np.zeros(len(made.vocabulary), np.int64)
    for row in document_frequencies(bags).collect():
        # One row per word of the block, whatever the number of documents.
        holding[row["word"]] = row["n_docs"]
    weights = shared(docs, np.array([weight(n_docs, int(n)) for n in holding], np.int64))
    share = F.expr(f"CAST((CAST(n AS DECIMAL(20,0)) * {90 * n_docs}) div {int(words or 1)} AS BIGINT)")
    measured = bags.filter("octet_length(bag) > 0 AND doc_id IS NOT NULL").select("doc_id", "bag", (share + 10).alias("m"))
    hashed = measured.withColumn("hash", F.xxhash64("bag", "m"))
    grouped = hashed.groupBy("hash", "m", "bag").agg(F.min("doc_id").alias("first_id"))
    classes = saved(grouped.withColumn("class", F.monotonically_increasing_id()), "classes")
    ahead = best_classes(classes.select("m", "bag", "first_id", "class"), block, weights, best)
    order = [F.desc("score"), F.asc("first_id"), F.asc("class")]
    winners = saved(first_rows(ahead, ["item_id"], order, best, "_rank").select("item_id", "score", "class"), "winners")
    wanted = classes.join(winners.select("class").distinct(), "class", "left_semi").select("class", "hash", "m", "bag")
    wanted = saved(wanted, "wanted")
    # Hashes of at most `best` classes for each item of the block.
    near = hashed.join(F.broadcast(wanted.select("hash").distinct()), "hash", "left_semi")
    # The first documents of a class are found before they meet it again; equal rows stay apart.
    near = near.withColumn("_row", F.monotonically_increasing_id())
    members = first_rows(near, ["hash", "m", "bag"], [F.asc("doc_id"), F.asc("_row")], best, "_member")
    expanded = members.join(wanted, ["hash", "m", "bag"]).select("class", "doc_id", "_row")
    found = winners.join(expanded, "class").select("item_id", "doc_id", "score", "_row")
    final = first_rows(found, ["item_id"], [F.desc("score"), F.asc("doc_id"), F.asc("_row")], best, "rank")
    return saved(final.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked")


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    best: int = BEST,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_words: int = BLOCK_WORDS,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """`item_id`, `rank`, `doc_id`, `score`: the `best` documents of each item with a score above 0, ties by smaller id.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. Every row of `docs` is
    a document; rows with an id that comes again are ranked each. Documents without an id count in all statistics but are
    not ranked; NULL and empty texts have no words and do not count. Items without an id are left out, rows of one item id
    are one item with all their words, items without words or without a document have no row. Other columns are not
    looked at. Empty tables give an empty table.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    asked = items.select(F.col(f"`{item_id}`").cast("bigint").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text"))
    terms = saved(item_terms(asked), "item-terms")
    n_words, n_items = terms.agg(F.count("*"), F.count_distinct("item_id")).first()
    parts = max(1, math.ceil(n_words / block_words), math.ceil(n_items / block_items))
    results = []
    for part in range(parts):
        mine = terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        # About `block_words` words, whatever the number of items.
        rows = [(row["item_id"], bytes(row["term"])) for row in mine.collect()]
        if rows:
            results.append(ranked_block(given, rows, best))
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, results)
