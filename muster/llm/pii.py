"""Personal data in text: base rules, and further spans chosen by boosted trees.

Base spans follow fixed patterns and checks. Beside them, generous patterns propose candidates that may overlap each
other and the base spans. A candidate's format and context are a handful of yes/no features, so all candidates of all
documents are counted by feature pattern, and trees are boosted on those counts: what they learn is which formats and
contexts are mostly right. Right are the base spans, and of the others those with evidence that the base rules do not ask
for: a phone number of usual length behind a word that announces one, a mail address with its signs spelled out, a card
number whose check digit is right. A candidate that no base span covers is added if its calibrated score is high, such as
a phone number without its plus sign, or a mail address written with words.

All text work is Spark's own expressions. What reaches the driver are the counts of feature patterns, whose number is
bounded by the number of features.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm.common import saved

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
LABEL = "[A-Za-z0-9-]"
# The base patterns. Possessive repeats and the look at the character before keep each scan linear in very long texts;
# neither changes a match: where the start of a run of such characters fails, the rest of the run fails too.
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Generous patterns, by the kind that they propose.
AT, DOT = r"(?:@| ?[\[(](?:at|AT)[\])] ?| (?:at|AT) )", r"(?:\.| ?[\[(](?:dot|DOT)[\])] ?| (?:dot|DOT) )"
PROPOSALS = {
    "email": rf"(?<!{LOCAL})(?=[A-Za-z0-9]){LOCAL}{{1,64}}+{AT}{LABEL}{{1,63}}+(?:{DOT}{LABEL}{{1,63}}+){{1,8}}+",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,4}+(?:\.[0-9]{1,4}+){3}(?![0-9A-Za-z])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ ./-]?+[0-9]){9,15}+",
    "phone": r"(?<![0-9+])(?:\+|00)?+(?:\([0-9]{1,5}\)|[0-9])(?:[ ()./-]{0,2}+[0-9]){6,14}+",
}
CUES = {
    "email": r"(?i)(?:e-?mails?|mail(?: to)?|contact|write|reach|kontakt|correo|courriel)\W*$",
    "ip": r"(?i)(?:ip|address|host|server|client|from|ping)\W*$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta|no|number|nr)\W*$",
    "phone": r"(?i)\b(?:tel|(?:tele)?phone|call|fax|mobile|cell|whatsapp|sms|telefon|tél|teléfono|móvil)\W*$",
}
# A mail address that hides its sign or its dots on purpose; ` at ` alone is also prose ("look at host.org").
SPELLED = r"[\[(](?:at|AT|dot|DOT)[\])]| (?:dot|DOT) "
BEFORE = 24
# The plus sign is none: base phones all have it, other candidates never.
FEATURES = (
    "brackets", "spaces", "hyphens", "dots", "spelled", "exact", "long", "short", "cue", "glued_before", "glued_after",
)
ROUNDS, RATE = 24, 0.3
LEAST_SHARE = 0.9
FOLDS = 5
CHUNK = 128
SPAN = "struct<start: bigint, end: bigint, part: string, before: string, after: string>"


def found(df: DataFrame, text: str, pattern: str, name: str, hint: Column) -> DataFrame:
    """Add the matches; texts without the hint are not scanned, as they can have none."""
    # Matches and gaps are columns of their own, so that each text is scanned once for either.
    p = F.lit(pattern)
    rows = df.withColumn("_part", F.when(hint, F.regexp_extract_all(text, p, F.lit(0))).otherwise(F.array()))
    some = F.size("_part") > 0
    rows = rows.withColumn("_gap", F.when(some, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>")))
    n = F.size("_part")
    zipped = F.arrays_zip(
        F.col("_part").alias("part"), F.slice("_gap", 1, n).alias("gap"), F.slice("_gap", 2, n).alias("next")
    )
    rows = rows.withColumn("_zipped", zipped).drop("_part", "_gap")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPAN}>").alias("all"))

    def step(s: Column, x: Column) -> Column:
        low = s["at"] + F.length(x["gap"])
        high = low + F.length(x["part"])
        span = F.struct(
            low.cast("bigint").alias("start"),
            high.cast("bigint").alias("end"),
            x["part"].alias("part"),
            F.right(x["gap"], F.lit(BEFORE)).alias("before"),
            F.left(x["next"], F.lit(1)).alias("after"),
        )
        return F.struct(high.cast("bigint").alias("at"), F.array_append(s["all"], span).alias("all"))

    # An array that grows is copied with every element, so spans are placed in chunks, and the chunks after that.
    rows = rows.withColumn("_chunks", F.transform(chunks(F.col("_zipped")), lambda chunk: F.aggregate(chunk, start, step)))
    nothing = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all"))

    def add(s: Column, x: Column) -> Column:
        return F.struct((s["at"] + x["at"]).alias("at"), F.array_append(s["all"], s["at"]).alias("all"))

    rows = rows.withColumn("_offsets", F.aggregate("_chunks", nothing, add, lambda s: s["all"])).drop("_zipped")
    moved = F.zip_with(
        "_chunks",
        "_offsets",
        lambda chunk, offset: F.transform(
            chunk["all"],
            lambda x: F.struct((x["start"] + offset).alias("start"), (x["end"] + offset).alias("end"), x["part"], x["before"], x["after"]),
        ),
    )
    return rows.withColumn(name, F.flatten(moved)).drop("_chunks", "_offsets")


def chunks(array: Column) -> Column:
    """The array in parts of `CHUNK` elements; none of an empty one. `array` is a column, so that it is computed once."""
    n = F.size(array)
    firsts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    return F.transform(firsts, lambda first: F.slice(array, first, F.lit(CHUNK)))


def with_bounds(spans: Column) -> Column:
    """Chunks of spans in order of place, each with its first start and last end."""
    def bound(chunk: Column) -> Column:
        low, high = F.array_min(F.transform(chunk, lambda x: x["start"])), F.array_max(F.transform(chunk, lambda x: x["end"]))
        return F.struct(low.alias("low"), high.alias("high"), chunk.alias("spans"))

    return F.transform(chunks(spans), bound)


def overlapped(bounded: Column, x: Column, and_also: Callable[[Column], Column] = lambda b: F.lit(True)) -> Column:
    """Whether a span overlaps one of those in chunks, of which only a few come near it."""
    near = F.filter(bounded, lambda chunk: (chunk["low"] < x["end"]) & (x["start"] < chunk["high"]))
    return F.exists(near, lambda chunk: F.exists(chunk["spans"], lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]) & and_also(b)))


def digits(part: Column) -> Column:
    return F.regexp_replace(part, F.lit("[^0-9]"), F.lit(""))


def passes_luhn(number: Column) -> Column:
    """From the right, every second digit counts twice, less 9 if that is above 9; the sum is a multiple of 10."""
    figures = F.transform(F.split(F.reverse(number), ""), lambda x: x.cast("int"))
    counted = F.transform(figures, lambda x, at: F.when(at % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(F.filter(counted, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def octet(part: Column) -> Column:
    """At most 255, whatever zeros stand before."""
    bare = F.ltrim(part, F.lit("0"))
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


def accepted(kind: str, part: Column) -> Column:
    """The check of a base match."""
    number = digits(part)
    if kind == "ip":
        return F.forall(F.split(part, r"\."), octet)
    if kind == "card":
        return F.length(number).between(13, 19) & passes_luhn(number)
    if kind == "phone":
        return F.length(number).between(9, 15)
    return F.lit(True)


def hint(kind: str, text: str, generous: bool = False) -> Column:
    if kind == "email":
        return F.regexp_like(text, F.lit(r"@|[\[( ](?i:at)[\]) ]")) if generous else F.contains(F.col(text), F.lit("@"))
    return F.contains(F.col(text), F.lit("+")) if kind == "phone" and not generous else F.regexp_like(text, F.lit("[0-9]"))


def base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Add a column per kind: an array of its base spans."""
    for kind in KINDS:
        df = found(df, text, BASE[kind], kind, hint(kind, text))
        df = df.withColumn(kind, F.filter(kind, accepts(kind)))
    return df


def accepts(kind: str):
    return lambda x: accepted(kind, x["part"])


def bits(kind: str, x: Column) -> Column:
    """The features of a candidate as bits of a number."""
    part = x["part"]
    n = F.length(digits(part))
    low, high = {"email": (0, 9), "ip": (4, 12), "card": (13, 19), "phone": (9, 15)}[kind]
    usual = {"email": n <= 4, "ip": n <= 12, "card": n == 16, "phone": n.isin(10, 11, 12)}[kind]
    tests = [
        part.contains("(") | part.contains("["),
        part.contains(" "),
        part.contains("-"),
        part.contains("."),
        F.regexp_like(part, F.lit(SPELLED)),
        usual,
        n > high,
        n < low,
        F.regexp_like(x["before"], F.lit(CUES[kind])),
        F.regexp_like(x["before"], F.lit(r"[\p{L}\p{N}_=\"#/]$")),
        F.regexp_like(x["after"], F.lit(r"^[\p{L}\p{N}_=\"#/]")),
    ]
    weighed = [F.when(F.coalesce(test, F.lit(False)), F.lit(1 << k)).otherwise(F.lit(0)) for k, test in enumerate(tests)]
    total = weighed[0]
    for one in weighed[1:]:
        total = total + one
    return total


def evident(kind: str, x: Column) -> Column:
    """Whether a candidate is right without its base pattern: the check of its kind, and a sign of what is meant where
    that check says little."""
    if kind == "email":
        return F.regexp_like(x["part"], F.lit(SPELLED))
    if kind == "phone":
        return accepted(kind, x["part"]) & F.regexp_like(x["before"], F.lit(CUES[kind]))
    return accepted(kind, x["part"])


def candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """Add `base` and `proposed`: arrays of `kind` (its place in `KINDS`), `start`, `end`, `bits`, `right` (1 or 0).

    What is proposed overlaps no base span. Base spans are right, proposed ones if there is evidence.
    """
    rows = base_spans(df, text)

    def marked(kind: str, right: Callable[[str, Column], Column]) -> Column:
        number = F.lit(KINDS.index(kind)).alias("kind")

        def one(x: Column) -> Column:
            mark = F.when(right(kind, x), 1).otherwise(0).alias("right")
            return F.struct(number, x["start"].alias("start"), x["end"].alias("end"), bits(kind, x).alias("bits"), mark)

        return F.transform(kind, one)

    base = F.concat(*[marked(kind, lambda kind, x: F.lit(True)) for kind in KINDS])
    rows = rows.withColumn("base", base).drop(*KINDS)
    for kind in KINDS:
        rows = found(rows, text, PROPOSALS[kind], kind, hint(kind, text, True))
    proposed = F.concat(*[marked(kind, evident) for kind in KINDS])

    rows = rows.withColumn("_proposed", proposed).drop(*KINDS)
    ordered = F.array_sort(F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    rows = rows.withColumn("_base", ordered).withColumn("_bounded", with_bounds(F.col("_base")))
    # Asked for twice, the chunks are a column of their own and not computed again for each span.
    free = F.when(F.size("_bounded") == 0, F.col("_proposed")).otherwise(F.filter("_proposed", lambda x: ~overlapped(F.col("_bounded"), x)))
    return rows.withColumn("proposed", free).drop("_proposed", "_base", "_bounded")


@dataclass
class Tree:
    """Two questions deep: leaves by the answers, no before yes."""

    first: int
    then: tuple[int, int]
    leaves: tuple[float, float, float, float]

    def values(self, table: np.ndarray) -> np.ndarray:
        low = np.where(table[:, self.then[0]], self.leaves[1], self.leaves[0])
        high = np.where(table[:, self.then[1]], self.leaves[3], self.leaves[2])
        return np.where(table[:, self.first], high, low)


def best_split(table: np.ndarray, gradient: np.ndarray, weight: np.ndarray) -> tuple[int, float]:
    """The question that gains most, and its gain."""
    yes_g, yes_w = gradient @ table, weight @ table
    all_g, all_w = gradient.sum(), weight.sum()
    gain = yes_g**2 / (yes_w + 1) + (all_g - yes_g) ** 2 / (all_w - yes_w + 1) - all_g**2 / (all_w + 1)
    best = int(np.argmax(gain))
    return best, float(gain[best])


def boost(table: np.ndarray, seen: np.ndarray, right: np.ndarray) -> tuple[float, list[Tree]]:
    """Gradient boosting of the logistic loss over counted feature patterns: a start value and trees."""
    share = (right.sum() + 1) / (seen.sum() + 2)
    start = float(np.log(share / (1 - share)))
    margin, trees = np.full(len(table), start), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = right - seen * p, seen * p * (1 - p)
        first, gain = best_split(table, gradient, weight)
        if gain < 1e-6:
            break
        leaves, then = [], []
        for side in (False, True):
            mine = table[:, first].astype(bool) == side
            second, _ = best_split(table[mine], gradient[mine], weight[mine])
            then.append(second)
            for answer in (False, True):
                leaf = mine & (table[:, second].astype(bool) == answer)
                leaves.append(RATE * float(gradient[leaf].sum() / (weight[leaf].sum() + 1)))
        tree = Tree(first, tuple(then), tuple(leaves))
        margin = margin + tree.values(table)
        trees.append(tree)
    return start, trees


def margins(model: tuple[float, list[Tree]], table: np.ndarray) -> np.ndarray:
    start, trees = model
    return sum((tree.values(table) for tree in trees), np.full(len(table), start))


def unpacked(patterns: list[int]) -> np.ndarray:
    return np.array([[bits >> k & 1 for k in range(len(FEATURES))] for bits in patterns], float).reshape(-1, len(FEATURES))


def calibrated(scores: np.ndarray, seen: np.ndarray, right: np.ndarray) -> float | None:
    """The lowest score from which on, among rows not trained on, at least `LEAST_SHARE` are right; one right and one
    wrong row are added, so that few rows have to be all right and very few never suffice."""
    least = None
    for score in sorted(set(scores.tolist()), reverse=True):
        above = scores >= score
        if right[above].sum() + 1 >= LEAST_SHARE * (seen[above].sum() + 2):
            least = score
    return least


def learn(spans: DataFrame) -> dict[int, tuple[tuple[float, list[Tree]], float]]:
    """Per kind: trees and threshold, from the counts of all candidates; kinds too rare for a threshold are left out.

    The threshold is found on scores by trees of other candidates: each fifth, by a hash of document and place, is
    scored by trees of the other four.
    """
    columns = ("kind", "start", "bits", "right")
    rows = spans.select("doc_id", F.inline("base")).unionByName(spans.select("doc_id", F.inline("proposed"))).select("doc_id", *columns)
    fold = F.pmod(F.xxhash64("doc_id", "start"), F.lit(FOLDS)).alias("fold")
    # At most one row per kind, fold and feature pattern.
    counts = rows.groupBy("kind", fold, "bits").agg(F.count("*").alias("seen"), F.sum("right").alias("right")).collect()
    by_kind = defaultdict(list)
    for row in counts:
        by_kind[row["kind"]].append(row)
    models = {}
    for kind, some in by_kind.items():
        table = unpacked([row["bits"] for row in some])
        of, seen, right = (np.array([row[name] for row in some], float) for name in ("fold", "seen", "right"))
        scores = np.zeros(len(some))
        for held in np.unique(of):
            mine = of == held
            if not mine.all():
                scores[mine] = margins(boost(table[~mine], seen[~mine], right[~mine]), table[mine])
        least = calibrated(scores, seen, right)
        if least is not None:
            models[kind] = (boost(table, seen, right), least)
    return models


def chosen(df: DataFrame, models: dict, name: str) -> DataFrame:
    """Add the proposed spans that reach their kind's threshold and overlap no better one that does.

    Of equally good ones the first counts.
    """
    if not models:
        return df.withColumn(name, F.filter("proposed", lambda x: F.lit(False)))

    def score(x: Column) -> Column:
        out = F.lit(None).cast("double")
        for kind, ((start, trees), least) in sorted(models.items()):
            total = F.lit(start - least)
            for tree in trees:
                def asked(k: int) -> Column:
                    return x["bits"].bitwiseAND(F.lit(1 << k)) == 0

                a, b, c, d = map(F.lit, tree.leaves)
                no, yes = F.when(asked(tree.then[0]), a).otherwise(b), F.when(asked(tree.then[1]), c).otherwise(d)
                total = total + F.when(asked(tree.first), no).otherwise(yes)
            out = F.when(x["kind"] == kind, total).otherwise(out)
        return out

    def scored(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), (-score(x)).alias("rank"))

    good = F.filter(F.transform("proposed", scored), lambda x: F.coalesce(x["rank"] <= 1e-9, F.lit(False)))
    rows = df.withColumn("_good", F.array_sort(good)).withColumn("_bounded", with_bounds(F.col("_good")))

    def order(x: Column) -> Column:
        return F.struct(x["rank"], x["start"], x["end"], x["kind"])

    best = F.filter("_good", lambda x: ~overlapped(F.col("_bounded"), x, lambda b: order(b) < order(x)))
    best = F.when(F.size("_bounded") < 1, F.col("_good")).otherwise(best)
    return rows.withColumn(name, best).drop("_good", "_bounded")


def personal_spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id`, `base`, `added`: arrays of `kind` (its place in `KINDS`), `start`, `end` in code points, end exclusive.

    `base` has the base spans by kind and place. `added` has what the trees add, which overlaps neither base spans nor
    each other. NULL and empty texts have neither. Every row is a document, whatever its id; equal texts have equal
    spans. An empty table gives no rows; other columns are not read.
    """
    rows = df.select(df[doc_id].alias("doc_id"), F.coalesce(df[text].cast("string"), F.lit("")).alias("text"))
    spans = saved(candidates(rows).select("doc_id", "base", "proposed"), "spans")
    spans = chosen(spans, learn(spans), "added")

    def plain(array: Column) -> Column:
        made = F.transform(array, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
        return F.array_sort(made)

    return spans.select("doc_id", plain(F.col("base")).alias("base"), plain(F.col("added")).alias("added"))


def written(spans: Column) -> Column:
    """`kind:start:end` of each, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def redacted(df: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets. `doc_id` must be unique and not NULL.

    Spans of different kinds that overlap are replaced together, by the first one's kind.
    """
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    names = F.array(*map(F.lit, KINDS))
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    source = F.col(text)

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(source, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        mark = F.concat(F.lit("["), F.element_at(names, x["kind"] + 1), F.lit("]"))
        apart = x["start"] >= s["at"]
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(apart, F.concat(s["out"], gap, mark)).otherwise(s["out"]).alias("out"))

    rest = F.aggregate("_spans", begin, step, lambda s: F.concat(s["out"], F.substring(source, (s["at"] + 1).cast("int"), F.length(source))))
    known = spans.select(F.col(doc_id).alias("_id"), every.alias("_spans"))
    joined = df.join(known, df[doc_id] == F.col("_id"))
    return joined.withColumn(text, F.coalesce(rest, F.col(text))).drop("_id", "_spans")
