"""Ordered histories: overlay, newest row, last rows, changes and state as of an event.

`slices` says how the rows of a key are divided among tasks; see `muster.plans.slots`.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.plans.slots import AUTO, Slices, fill_forward, keep_last

KEEP_ROWS = 50_000


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The whole row with the greatest `order` per key; the first row of each task's share is all that is shuffled."""
    others = [name for name in df.columns if name not in keys]
    if not others:
        return df.dropDuplicates()
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return newest.select(*keys, "_row.*").select(*df.columns)


def overlay_layers(
    df: DataFrame,
    keys: Sequence[str] = ("installation_id", "path"),
    layer: str = "layer",
    path: str | None = "path",
    target: int = 0,
    tie: Sequence[str] = (),
) -> DataFrame:
    """The row of the highest layer per key. Outside the target layer, top-level hidden paths are not copied.

    `path` is relative to its layer; None skips the rule on hidden paths. `tie` picks the greatest of several rows of
    one layer.
    """
    copied = df
    if path is not None:
        copied = df.filter((F.col(layer) == target) | ~F.col(path).startswith("."))
    return latest_per_key(copied, keys, [layer, *tie])


def retain_last_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = KEEP_ROWS, slices: Slices = AUTO
) -> DataFrame:
    """The last `n` rows per key in the order of `order`, which must be unique within a key."""
    return keep_last(df, keys, order, n, slices)


def state_changes(
    states: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    state: str = "state",
    slices: Slices = AUTO,
) -> DataFrame:
    """Rows whose state differs from the one before, and the first of each key, with the earlier one in `previous`.

    `order` must be unique within a key, so it ends with something that tells states of equal time apart.
    """
    value = F.struct(F.col(state).alias("state"))
    rows = fill_forward(states, keys, order, value, "_before", inclusive=False, slices=slices)
    changed = F.col("_before").isNull() | ~F.col(state).eqNullSafe(F.col("_before.state"))
    return rows.filter(changed).withColumn("previous", F.col("_before.state")).drop("_before")


def asof_guard(
    events: DataFrame,
    states: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: Sequence[str],
    tie: Sequence[str] = (),
    max_age: timedelta | None = None,
    slices: Slices = AUTO,
    name: str = "state",
) -> DataFrame:
    """Events with `name`: the `value` columns and time of the newest state at or before the event, NULL if none.

    A state at the time of the event counts. `tie` orders states of equal time and must then exist on both sides. States
    older than `max_age` do not count.
    """
    seen = F.struct(*value, F.col(ts))
    tagged = states.select(*keys, ts, *tie, seen.alias("_seen"), F.lit(0).alias("_side"))
    both = events.withColumn("_side", F.lit(1)).unionByName(tagged, allowMissingColumns=True)
    filled = fill_forward(both, keys, [ts, "_side", *tie], F.col("_seen"), name, slices=slices)
    found = filled.filter(F.col("_side") == 1).drop("_side", "_seen")
    if max_age is None:
        return found
    fresh = F.col(ts) - F.lit(max_age) <= F.col(f"{name}.{ts}")
    return found.withColumn(name, F.when(fresh, F.col(name)))


def conversation_list(
    turns: DataFrame,
    keys: Sequence[str] = ("conv_id",),
    turn: str = "turn",
    title: str = "text",
    role: str = "role",
) -> DataFrame:
    """One row per conversation: number of turns, first and last turn, opening text and who spoke last."""
    return turns.groupBy(*keys).agg(
        F.count("*").alias("n_turns"),
        F.min(turn).alias("first_turn"),
        F.max(turn).alias("last_turn"),
        F.min_by(title, turn).alias("opening"),
        F.max_by(role, turn).alias("last_role"),
    )


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first `n` rows in the given order."""
    return df.orderBy(*order).limit(n)
