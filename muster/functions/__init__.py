"""Column expressions shared by the operators. All are JVM built-ins; none is a UDF."""

from muster.functions.lists import (
    absent_in,
    append_absent,
    joined,
    remove_every,
    words_of,
)
from muster.functions.text import (
    ascii_lower,
    blank_to,
    date_label,
    glob_to_like,
    has_value,
    kb_to_mb,
    nth_field,
    squeeze,
    strip_all_space,
)
from muster.functions.timeline import micros, slot_of, span_text

__all__ = [
    "absent_in",
    "append_absent",
    "ascii_lower",
    "blank_to",
    "date_label",
    "glob_to_like",
    "has_value",
    "joined",
    "kb_to_mb",
    "micros",
    "nth_field",
    "remove_every",
    "slot_of",
    "span_text",
    "squeeze",
    "strip_all_space",
    "words_of",
]
