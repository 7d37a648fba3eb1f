"""Toxicity of documents: misspelled lexicon terms, weighed in their context.

A lexicon of words and word beginnings is learned from labelled documents. Its trie is intersected with Levenshtein
automata: a state is a set of (trie node, errors), made once per set and letter and kept, so a word is one walk over a
table and most words leave it after a few letters. Hits count more where they stand close together, and less inside
quotation marks. A logistic model of the densest window and of the whole document gives the score.

Fitting reads a bounded sample of labelled rows (`SAMPLE`); scoring reads every text to its end.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muster.llm.common import map_arrow, saved, shared, texts_of

SAMPLE = 16_384
MAX_CANDIDATES = 20_000
MAX_TERMS = 500
MAX_KNOWN = 20_000
WINDOW = 25
QUOTED_WEIGHT = 0.3
FUZZY_WEIGHT = {0: 1.0, 1: 0.5, 2: 0.35}
PREFIXES = range(3, 9)
LEAST_RATIO = 8.0
# A term that many toxic documents hold, and clean ones hardly ever, weighs 1; misspelled it still weighs more than any
# other term.
STRONG_RATIO = 50.0
STRONG_PURITY = 100
STRONG_SHARE = 0.05
WEAK_WEIGHT = 0.3
STRONG = 0.34
TOKEN = re.compile(r"[^\W_][\w*$@]*")
MARK = re.compile('["“”„«»‘’]')
# Marks that close each other; “ closes a quotation that „ opened, and opens one otherwise.
KINDS_OF_MARKS = {'"': '"', "“": "“", "”": "“", "„": "“", "«": "«", "»": "«", "‘": "‘", "’": "‘"}
STOPS = ",.;:!?)]}"
MEMO = 300_000
STATES = 50_000


def words_of(text: str) -> list[str]:
    """Lower-cased words; signs that may stand for a letter are kept inside a word."""
    return [word.rstrip("*$@_") for word in TOKEN.findall(text.lower())]


def allowed_errors(term: str) -> int:
    """Short terms and word beginnings have too many neighbours that are ordinary words."""
    if term.endswith("*"):
        return 0 if len(term) < 8 else 1
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Matcher:
    """The weight of a word: that of the heaviest lexicon term it spells, less for each error; 0 if it spells none."""

    def __init__(self, terms: Mapping[str, float]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.limit, self.final, self.prefix = [-1], [(-1, 0.0)], [(-1, 0.0)]
        for term, weight in terms.items():
            self.insert(term.rstrip("*"), allowed_errors(term), weight, term.endswith("*"))
        self.reset()

    def insert(self, word: str, errors: int, weight: float, beginning: bool) -> None:
        node = 0
        self.limit[0] = max(self.limit[0], errors)
        for letter in word:
            if letter not in self.children[node]:
                self.children[node][letter] = len(self.children)
                self.children.append({})
                self.limit.append(-1)
                self.final.append((-1, 0.0))
                self.prefix.append((-1, 0.0))
            node = self.children[node][letter]
            self.limit[node] = max(self.limit[node], errors)
        ends = self.prefix if beginning else self.final
        ends[node] = (errors, weight)

    def reset(self) -> None:
        self.memo: dict[str, float] = {}
        self.ids: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.accepts: list[float] = []
        self.begins: list[float] = []
        self.sets: list[frozenset] = []
        self.start = self.state({(0, 0)})

    def state(self, members: set[tuple[int, int]]) -> int:
        """The number of a set of states, closed under skipped letters of the term."""
        todo, closed = list(members), set()
        while todo:
            node, errors = todo.pop()
            if errors > self.limit[node] or (node, errors) in closed:
                continue
            closed.add((node, errors))
            todo.extend((child, errors + 1) for child in self.children[node].values())
        key = frozenset(closed)
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            self.accepts.append(heaviest(key, self.final))
            self.begins.append(heaviest(key, self.prefix))
        return self.ids[key]

    def step(self, state: int, letter: str) -> int:
        after: set[tuple[int, int]] = set()
        for node, errors in self.sets[state]:
            after.add((node, errors + 1))
            for other, child in self.children[node].items():
                after.add((child, errors + (other != letter)))
        after = {(node, errors) for node, errors in after if errors <= self.limit[node]}
        return self.state(after) if after else -1

    def walk(self, word: str) -> float:
        state, best, last = self.start, 0.0, len(word) - 1
        for at, letter in enumerate(word):
            after = self.steps[state].get(letter)
            if after is None:
                after = self.steps[state][letter] = self.step(state, letter)
            if after < 0:
                return best
            state = after
            # A beginning is one only if the word goes on.
            if at < last and self.begins[after] > best:
                best = self.begins[after]
        return max(best, self.accepts[state])

    def weight(self, word: str) -> float:
        if word not in self.memo:
            if len(self.memo) > MEMO or len(self.sets) > STATES:
                self.reset()
            self.memo[word] = self.walk(word)
        return self.memo[word]


def heaviest(members: frozenset[tuple[int, int]], ends: list[tuple[int, float]]) -> float:
    return max((ends[n][1] * FUZZY_WEIGHT[e] for n, e in members if e <= ends[n][0]), default=0.0)


def quotations(line: str) -> list[tuple[int, int]]:
    """Places from an opening mark to its closing mark, found in one pass; what is not closed is no quotation.

    A straight mark behind a space opens, one before a space or a stop closes, others do what is due.
    """
    if line[:2].lstrip().startswith(">"):
        return [(0, len(line))]
    spans, opened = [], {kind: [] for kind in KINDS_OF_MARKS.values()}
    for found in MARK.finditer(line):
        at, mark = found.start(), found.group()
        before, after = line[at - 1 : at] if at else " ", line[at + 1 : at + 2] or " "
        waiting = opened[KINDS_OF_MARKS[mark]]
        if mark == '"':
            opens = before.isspace() and not after.isspace()
            closes = not before.isspace() and (after.isspace() or after in STOPS)
            if waiting and opens:
                waiting[:] = [at]
                continue
            if not waiting and closes:
                continue
            starts = not waiting
        elif mark == "’" and before.isalnum() and after.isalnum():
            # An apostrophe.
            continue
        else:
            starts = mark in "„«‘" or mark == "“" and not (waiting and line[waiting[-1]] == "„")
        if starts:
            waiting.append(at)
        elif waiting:
            spans.append((waiting.pop(), at))
    return spans


class Quoted:
    """Whether places of a text, asked for in order, are in quotations of their line, which is looked at once."""

    def __init__(self, text: str) -> None:
        self.text, self.end = text, -1
        self.starts: list[int] = []
        self.ends: list[int] = []

    def __call__(self, start: int, end: int) -> bool:
        if start > self.end:
            low, high = self.text.rfind("\n", 0, start) + 1, self.text.find("\n", start)
            self.end = len(self.text) if high < 0 else high
            self.starts, self.ends = [], []
            for first, last in sorted(quotations(self.text[low : self.end])):
                # Those inside others, or that cross them, make one with them.
                if self.ends and low + first < self.ends[-1]:
                    self.ends[-1] = max(self.ends[-1], low + last)
                else:
                    self.starts.append(low + first)
                    self.ends.append(low + last)
        at = bisect_right(self.starts, start) - 1
        return at >= 0 and end <= self.ends[at]


def features(text: str, matcher: Matcher, known: frozenset[str]) -> tuple[float, ...]:
    """Weight of the hits in the densest window of words; of strong terms in the whole text; of others there, and per
    hundred words."""
    low = text.lower()
    same = len(low) == len(text)
    tokens = TOKEN.findall(low)
    forms = {}
    for raw in set(tokens):
        word = raw.rstrip("*$@_")
        weight = matcher.weight(word)
        if weight and word not in known:
            forms[raw] = weight
    if not forms:
        return 0.0, 0.0, 0.0, 0.0
    at, weights, strong, weak = [], [], 0.0, 0.0
    quoted = Quoted(text if same else low)
    for place, found in enumerate(TOKEN.finditer(low)):
        weight = forms.get(found.group())
        if weight is not None:
            counted = weight * (QUOTED_WEIGHT if quoted(*found.span()) else 1.0)
            at.append(place)
            weights.append(counted)
            if weight >= STRONG:
                strong += counted
            else:
                weak += counted
    sums = np.concatenate(([0.0], np.cumsum(weights)))
    first = np.searchsorted(at, np.asarray(at) - WINDOW, "right")
    # The constant keeps one hit in a short text from looking dense.
    return float((sums[1:] - sums[first]).max()), strong, weak, 100 * weak / (len(tokens) + 50)


def terms_of(text: str) -> set[str]:
    """Words, and beginnings of words marked by a star."""
    words = {word for word in words_of(text) if len(word) > 2}
    return words | {word[:n] + "*" for word in words for n in PREFIXES if len(word) > n}


def decoded(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    return (text.decode("utf-8", "replace") for text in texts_of(batch.column(column)))


def counted_terms(candidates=None):
    """Documents per term, of all terms or of candidates, added up inside the partition as far as memory allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in decoded(batch):
                found = terms_of(text)
                counts.update(found if candidates is None else found & candidates.value)
                if len(counts) > MEMO:
                    yield {"term": list(counts), "n": list(counts.values())}
                    counts.clear()
        if counts:
            yield {"term": list(counts), "n": list(counts.values())}

    return run


def held_terms(candidates):
    """The candidates that each document holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {"terms": [sorted(terms_of(text) & candidates.value) for text in decoded(batch)]}

    return run


def cover(documents: list[list[str]], weights: Mapping[str, float], least: float) -> list[str]:
    """Terms picked one by one for the weight they add to documents; a document counts half as much after each.

    Of terms that add the same, whole words go before beginnings, and longer before shorter. A term that contains a
    picked one, or is contained in it, is dropped if nearly all documents that hold it hold that one.
    """
    holders: dict[str, list[int]] = {}
    for at, terms in enumerate(documents):
        for term in terms:
            holders.setdefault(term, []).append(at)
    rows = {term: np.array(some) for term, some in holders.items()}
    worth, picked = np.ones(len(documents)), []

    def rank(term: str) -> tuple:
        return weights[term] * worth[rows[term]].sum(), not term.endswith("*"), len(term), term

    bound = {term: rank(term) for term in rows}
    while bound and len(picked) < MAX_TERMS:
        best = max(bound, key=bound.get)
        now = rank(best)
        if now < bound[best]:
            bound[best] = now
            continue
        if now[0] < least:
            break
        picked.append(best)
        worth[rows[best]] *= 0.5
        stem, held = best.rstrip("*"), set(holders[best])
        for term in [one for one in bound if one == best or one.startswith(stem) or stem.startswith(one.rstrip("*"))]:
            if len(held.intersection(holders[term])) >= 0.9 * len(holders[term]):
                del bound[term]
    return picked


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights of a logistic model, the constant first; none but the constant may be negative."""
    used = np.ones(x.shape[1] + 1, bool)
    design = np.column_stack([np.ones(len(x)), x])
    while True:
        weights = np.zeros(used.sum())
        part = design[:, used]
        penalty = ridge * np.array([0.0] + [1.0] * (len(weights) - 1))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(part @ weights, -30, 30)))
            slope = part.T @ (p - y) + penalty * weights
            curve = (part * (p * (1 - p))[:, None]).T @ part + np.diag(penalty + 1e-9)
            change = np.clip(np.linalg.solve(curve, slope), -4, 4)
            weights = weights - change
            if np.abs(change).max() < 1e-6:
                break
        full = np.zeros(len(used))
        full[used] = weights
        if (full[1:] >= 0).all():
            return full
        used[1:] &= full[1:] >= 0


def is_held_out(doc_id: str) -> Column:
    """Rows whose labels are never learned from: a fifth, by the checksum of the id. A NULL id is not one of them."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


class Model:
    """Lexicon, ordinary words that only look like its terms, and the logistic weights."""

    def __init__(self, terms: Mapping[str, float], known: frozenset[str], weights: np.ndarray) -> None:
        self.terms, self.known, self.weights = terms, known, weights

    def score(self, found: tuple[float, ...]) -> float:
        margin = float(self.weights[0] + self.weights[1:] @ np.log1p(found))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def labelled_sample(df: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, sample: int) -> DataFrame:
    """`text`, `label` of at most `sample` labelled documents that are not held out, equal texts once.

    Documents are taken in order of a hash of their id. An id with several labels has the largest.
    """
    usable = labels.select(labels[doc_id].alias("_id"), labels[label].cast("int").alias("label"))
    known = usable.filter(~is_held_out("_id") & F.col("_id").isNotNull() & F.col("label").isin(0, 1))
    chosen = known.groupBy("_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = df.select(df[doc_id].alias("_id"), F.coalesce(df[text].cast("string"), F.lit("")).alias("text"))
    # At most `sample` ids, so their size is bounded whatever the tables hold.
    pairs = rows.join(F.broadcast(chosen), "_id").select("text", "label")
    once = pairs.groupBy(F.sha2("text", 256)).agg(F.min("text").alias("text"), F.max("label").alias("label"))
    return saved(once.select("text", "label"), "labelled")


def learn_terms(sample: DataFrame) -> dict[str, float]:
    """Lexicon terms and their weights: those that toxic documents hold `LEAST_RATIO` times as often as clean ones.

    A strong term weighs 1; the weight of others grows with the logarithm of that ratio, up to `WEAK_WEIGHT`.
    """
    toxic, clean = sample.filter("label = 1"), sample.filter("label = 0")
    n, n_clean = toxic.count(), clean.count()
    least = max(2.0, 0.01 * n)

    def counts(rows: DataFrame, known=None) -> DataFrame:
        made = map_arrow(rows.select("text"), counted_terms(known), "term string, n long")
        return made.groupBy("term").agg(F.sum("n").alias("n"))

    often = counts(toxic).filter(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(MAX_CANDIDATES)
    in_toxic = {row["term"]: row["n"] for row in often.collect()}
    in_clean = {row["term"]: row["n"] for row in counts(clean, shared(sample, frozenset(in_toxic))).collect()}
    ratio = {
        term: (hits + 0.5) / (n + 1) * (n_clean + 1) / (in_clean.get(term, 0) + 0.5) for term, hits in in_toxic.items()
    }
    rise = WEAK_WEIGHT / np.log(STRONG_RATIO)

    def weight(term: str) -> float:
        hits = in_toxic[term]
        often = hits >= max(3, STRONG_SHARE * n) and ratio[term] >= STRONG_RATIO
        if often and hits >= STRONG_PURITY * in_clean.get(term, 0):
            return 1.0
        return min(WEAK_WEIGHT, float(np.log(ratio[term]) * rise))

    weights = {term: weight(term) for term, one in ratio.items() if one >= LEAST_RATIO}
    held = map_arrow(toxic.select("text"), held_terms(shared(sample, frozenset(weights))), "terms array<string>")
    return {term: weights[term] for term in cover([row["terms"] for row in held.collect()], weights, 0.25 * least)}


def looks_like(matcher, exact):
    """Words that match, but are no term and do not begin like one, per label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts: Counter[tuple[str, int]] = Counter()
        for batch in batches:
            for text, label in zip(decoded(batch), batch.column("label").to_pylist()):
                words = {word for word in words_of(text) if matcher.value.weight(word)}
                counts.update((word, label) for word in words if not terms_of(word) & exact.value)
        yield {"word": [k[0] for k in counts], "label": [k[1] for k in counts], "n": list(counts.values())}

    return run


def learn(df: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", label="toxic", sample: int = SAMPLE) -> Model:
    """A model from labelled documents; without toxic or without clean ones every score is the share of toxic ones,
    counted with half a toxic and one and a half clean ones more."""
    rows = labelled_sample(df, labels, doc_id, text, label, sample)
    terms = learn_terms(rows)
    forms = map_arrow(rows, looks_like(shared(rows, Matcher(terms)), shared(rows, frozenset(terms))), "word string, label int, n long")
    usual = forms.groupBy("word").agg(F.sum(F.col("n") * (1 - 2 * F.col("label"))).alias("n")).filter("n >= 0")
    known = frozenset(row["word"] for row in usual.orderBy(F.desc("n"), "word").limit(MAX_KNOWN).collect())
    model = shared(rows, Model(terms, known, np.zeros(5)))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        matcher = Matcher(model.value.terms)
        for batch in batches:
            pairs = [features(one, matcher, model.value.known) for one in decoded(batch)]
            names = ("near", "strong", "weak", "dense")
            yield {"label": batch.column("label")} | {name: [one[k] for one in pairs] for k, name in enumerate(names)}

    found = map_arrow(rows, measured, "label int, near double, strong double, weak double, dense double")
    table = np.array(found.collect(), float).reshape(-1, 5)
    y = table[:, 0]
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 2)
        return Model(terms, known, np.array([np.log(share / (1 - share)), 0.0, 0.0, 0.0, 0.0]))
    return Model(terms, known, fit(np.log1p(table[:, 1:]), y))


def score(df: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """All columns and `name`, from 0 to 1.

    NULL and empty texts score what a text without hits does. A column of that name is replaced; rows, ids and other
    columns stay as they are, repeated or NULL; an empty table stays empty.
    """
    known = shared(df, model)
    rest = df.drop(name).withColumn(text, F.col(text).cast("string"))
    schema = T.StructType([*rest.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        model = known.value
        matcher = Matcher(model.terms)
        for batch in batches:
            scores = [model.score(features(one, matcher, model.known)) for one in decoded(batch, text)]
            yield {field: batch.column(field) for field in batch.schema.names} | {name: scores}

    return map_arrow(rest, run, schema)


def held_out_accuracy(scored: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "toxic") -> Mapping:
    """Counts of held-out labelled rows: right, missed, wrongly marked."""
    rows = scored.filter(is_held_out(doc_id)).join(labels.select(doc_id, label), doc_id)
    marked = F.col("score") >= 0.5
    return rows.agg(
        F.count_if(marked == (F.col(label) == 1)).alias("right"),
        F.count_if(~marked & (F.col(label) == 1)).alias("missed"),
        F.count_if(marked & (F.col(label) == 0)).alias("wrong"),
    ).first().asDict()
