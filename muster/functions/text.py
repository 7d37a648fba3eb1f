"""Scalar text and number expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_lower(col: Column) -> Column:
    """Lower-case A to Z only; `lower` would also change letters outside ASCII."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def strip_all_space(col: Column) -> Column:
    """Delete every whitespace character, inner ones too."""
    return F.regexp_replace(col, r"\s", "")


def squeeze(col: Column) -> Column:
    """Trim and reduce each run of whitespace to one blank."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def blank_to(col: Column, default: Column) -> Column:
    """`default` where `col` is NULL or empty."""
    return F.coalesce(F.nullif(col, F.lit("")), default)


def has_value(col: Column) -> Column:
    """True unless the text is missing, empty or the word `null`."""
    return F.coalesce((col != "") & (col != "null"), F.lit(False))


def kb_to_mb(col: Column) -> Column:
    """Whole megabytes, truncated toward zero."""
    return (col / F.lit(1024)).cast("bigint")


def nth_field(col: Column, n: int) -> Column:
    """The n-th whitespace-separated field, counted from 1; NULL when there are fewer."""
    before = rf"(?:\S+\s+){{{n - 1}}}"
    return F.nullif(F.regexp_extract(col, rf"^\s*{before}(\S+)", 1), F.lit(""))


def date_label(ts: Column) -> Column:
    """Short weekday, month, day and minute, as in `Mon 01-15 09:30`."""
    return F.date_format(ts, "E MM-dd HH:mm")


def glob_to_like(glob: str) -> str:
    """A LIKE pattern for a file-name glob made of `*`, `?` and plain characters."""
    like = {"*": "%", "?": "_", "%": r"\%", "_": r"\_", "\\": r"\\"}
    return "".join(like.get(char, char) for char in glob)
