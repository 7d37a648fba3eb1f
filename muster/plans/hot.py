"""Finding hot keys by counting, and joins that do not send a hot key to one task.

Bytes say little about rows: a table of one repeated row takes almost none. So rows are counted. A table of at most
`ROWS_PER_TASK` rows has no hot key; of a larger one the rows per key are counted, which combines before it shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.session import written

# A key with more rows is hot. In a table so large that more than MAX_HOT keys could be, the limit is higher: the table's
# rows divided by MAX_HOT. So the table of hot keys, which is broadcast, has at most MAX_HOT rows.
ROWS_PER_TASK = 10_000_000
MAX_HOT = 100_000
ROWS = "_rows"


@dataclass(frozen=True)
class HotKeys:
    """The hot keys of a table with their rows, the limit above which a key is hot, and the rows of all of them."""

    table: DataFrame
    limit: int
    rows: int

    def parts(self) -> int:
        """How many tasks the rows of hot keys are for."""
        return max(2, -(-self.rows // self.limit))


def hot_keys(df: DataFrame, keys: Sequence[str]) -> HotKeys | None:
    """The keys with too many rows for one task; NULL is a key like any other. Runs one or two jobs."""
    rows = df.count()
    if rows <= ROWS_PER_TASK:
        return None
    limit = max(ROWS_PER_TASK, rows // MAX_HOT)
    counts = df.groupBy(*keys).agg(F.count("*").alias(ROWS)).filter(F.col(ROWS) > limit)
    table = written(counts, "hot-keys")
    total = table.agg(F.sum(ROWS)).first()[0]
    return HotKeys(table, limit, total) if total else None


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], renamed: str = "_hot_") -> Column:
    """The NULL-safe condition that joins `keys` of one side to their renamed copies on the other."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[f"{renamed}{key}"])
    return condition


def flagged(df: DataFrame, keys: Sequence[str], hot: HotKeys) -> DataFrame:
    """Add `_rows`, NULL for rows of keys that are not hot."""
    # At most MAX_HOT rows.
    side = F.broadcast(hot.table.withColumnsRenamed({key: f"_hot_{key}" for key in keys}))
    return df.join(side, same_keys(df, side, keys), "left").drop(*[f"_hot_{key}" for key in keys])


def lookup(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join with a table that has few rows per key, such as one.

    Rows of a hot key are dealt to as many tasks as their number asks for, and the other side's rows of that key are
    copied to each of them. Which task a row goes to follows from its place in its partition, so a retried task deals
    the same.
    """
    on = list(on)
    comparable = all(left.schema[key].dataType == right.schema[key].dataType for key in on)
    hot = hot_keys(left, on) if comparable and not left.isStreaming else None
    if hot is None:
        return left.join(right, on, how)
    salts = F.coalesce(F.ceil(F.col(ROWS) / hot.limit), F.lit(1)).cast("int")
    dealt = flagged(left, on, hot).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), salts).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), salts - 1))
    copied = flagged(right, on, hot).withColumn("_salt", copies)
    return dealt.drop(ROWS).join(copied.drop(ROWS), [*on, "_salt"], how).drop("_salt")
