"""Expressions that cut an ordered column into slots of fixed width."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

Width = timedelta | int


def whole_micros(span: timedelta) -> int:
    """The span in microseconds."""
    return span // timedelta(microseconds=1)


def span_text(span: timedelta) -> str:
    """The span as Spark's window functions and watermarks take it."""
    return f"{whole_micros(span)} microseconds"


def micros(ts: Column) -> Column:
    """Microseconds since 1970; a zone-less timestamp is read in the session zone, which must be UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def slot_of(position: Column, width: Width) -> Column:
    """Number of the half-open slot holding `position`, rounded down, also below zero.

    A `timedelta` width cuts a timestamp column, an `int` width a whole-number column. The number depends on the
    value alone, so it is the same in every task and after every retry.
    """
    value = micros(position) if isinstance(width, timedelta) else position.cast("bigint")
    step = F.lit(whole_micros(width) if isinstance(width, timedelta) else width).cast("bigint")
    return F.call_function("div", value - F.pmod(value, step), step)
