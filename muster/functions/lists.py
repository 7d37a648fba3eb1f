"""Expressions on arrays of words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from muster.functions.text import ascii_lower


def words_of(text: Column) -> Column:
    """Whitespace-separated words; the first or last may be empty, as rows they are filtered after `explode`."""
    return F.split(text, r"\s+")


def joined(words: Column, separator: str = " ") -> Column:
    """The words as one text; empty for a NULL array."""
    return F.coalesce(F.array_join(words, separator), F.lit(""))


def absent_in(words: Column, word: Column, fold: bool = False) -> Column:
    """True if `word` is not an element; `fold` ignores ASCII case on both sides."""
    known = F.coalesce(words, F.array().cast("array<string>"))
    if fold:
        known, word = F.transform(known, ascii_lower), ascii_lower(word)
    return ~F.coalesce(F.array_contains(known, word), F.lit(False))


def append_absent(words: Column, word: Column, fold: bool = False) -> Column:
    """Append `word` in its own spelling unless it is already an element."""
    known = F.coalesce(words, F.array().cast("array<string>"))
    return F.when(word.isNotNull() & absent_in(words, word, fold), F.array_append(known, word)).otherwise(known)


def remove_every(words: Column, word: Column) -> Column:
    """Delete every element equal to `word`; a NULL `word` deletes nothing."""
    return F.when(word.isNull(), words).otherwise(F.array_remove(words, word))
