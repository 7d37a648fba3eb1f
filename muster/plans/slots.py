"""Ordered per-key logic without a task that owns a hot key.

A window over a key puts all rows of that key into one task. That is the cheapest plan as long as no key has very many
rows, and impossible when one key holds a large part of the table. So hot keys are looked for first. Rows of other keys
go through the plain window. Rows of hot keys are grouped by key *and slot*; only one summary row per occupied slot is
handled per hot key, and what the earlier slots contribute is put back as one seed row in front of each slot.

Rows of hot keys are cut into ranges of about equal size in the order of key and all ordering columns, as many as their
number asks for. Ranges are drawn from a sample, so these rows are written once to keep their cut fixed. A caller that
knows its data may ask for slots of fixed width of the first ordering column instead, which follow from the value alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.functions.timeline import Width, slot_of
from muster.plans import hot
from muster.session import checkpointed

SLOT, SEED, VALUE = "_slot", "_seed", "_value"


@dataclass(frozen=True)
class Slicing:
    """How rows of a key are divided: by slots of `width`, or by ranges where it is None.

    `hot` tells the keys this applies to, None for all.
    """

    width: Width | None = None
    hot: hot.HotKeys | None = None


# Keys are not divided; or rows are counted first, and only hot keys are divided.
WHOLE = "whole"
AUTO = "auto"
Slices = Slicing | str


def choose_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: Slices = AUTO) -> Slices:
    """What AUTO stands for.

    Counts rows, and if there are many rows per key, in jobs that read only the key columns. A caller with several steps
    over the same rows asks once and passes the answer on.
    """
    if slices != AUTO:
        return slices
    found = hot.hot_keys(df, keys)
    return WHOLE if found is None else Slicing(None, found)


def with_slot(df: DataFrame, keys: Sequence[str], order: Sequence[str], slicing: Slicing) -> DataFrame:
    """Add the slot or range of each row, NULL for keys that are not divided.

    Within a key the number grows with the ordering columns.
    """
    if slicing.hot is None:
        divided, others = df, None
    else:
        marked = hot.flagged(df, keys, slicing.hot)
        divided = marked.filter(F.col(hot.ROWS).isNotNull()).drop(hot.ROWS)
        others = marked.filter(F.col(hot.ROWS).isNull()).drop(hot.ROWS)
    if slicing.width is not None:
        rows = divided.withColumn(SLOT, slot_of(F.col(order[0]), slicing.width))
    else:
        default = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        count = default if slicing.hot is None else slicing.hot.parts()
        ranges = divided.repartitionByRange(count, *keys, *order)
        rows = checkpointed(ranges.withColumn(SLOT, F.spark_partition_id().cast("bigint")))
    if others is None:
        return rows
    return others.withColumn(SLOT, F.lit(None).cast("bigint")).unionByName(rows)


def earlier_slots(keys: Sequence[str]):
    """All earlier occupied slots of the key."""
    return Window.partitionBy(*keys).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)


def later_slots(keys: Sequence[str]):
    """All later occupied slots of the key."""
    return Window.partitionBy(*keys).orderBy(F.col(SLOT).desc()).rowsBetween(Window.unboundedPreceding, -1)


def fill_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    inclusive: bool = True,
    slices: Slices = AUTO,
) -> DataFrame:
    """Add `name`: the last non-NULL `value` of the key so far, with or without the row's own.

    `order` must be unique within a key.
    """
    slicing = choose_slices(df, keys, order, slices)
    end = Window.currentRow if inclusive else -1
    if slicing == WHOLE:
        sofar = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        return df.withColumn(name, F.last(value, ignorenulls=True).over(sofar))
    rows = with_slot(df, keys, order, slicing).withColumn(VALUE, value).withColumn(SEED, F.lit(False))
    last = F.max_by(VALUE, F.when(F.col(VALUE).isNotNull(), F.struct(*order)))
    before = F.last(VALUE, ignorenulls=True).over(earlier_slots(keys))
    seeds = (
        rows.filter(F.col(SLOT).isNotNull())
        .groupBy(*keys, SLOT)
        .agg(last.alias(VALUE))
        .select(*keys, SLOT, before.alias(VALUE), F.lit(True).alias(SEED))
        .filter(F.col(VALUE).isNotNull())
    )
    sofar = Window.partitionBy(*keys, SLOT).orderBy(F.col(SEED).desc(), *order)
    return (
        rows.unionByName(seeds, allowMissingColumns=True)
        .withColumn(name, F.last(VALUE, ignorenulls=True).over(sofar.rowsBetween(Window.unboundedPreceding, end)))
        .filter(~F.col(SEED))
        .drop(SLOT, SEED, VALUE)
    )


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, slices: Slices = AUTO) -> DataFrame:
    """The last `n` rows of each key. `order` must be unique within a key.

    Of a hot key, slots behind which `n` rows follow are dropped before the rows are shuffled.
    """
    newest_first = [F.col(name).desc() for name in order]
    slicing = choose_slices(df, keys, order, slices)
    if slicing == WHOLE:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first))
        return df.withColumn(VALUE, rank).filter(F.col(VALUE) <= n).drop(VALUE)
    rows = with_slot(df, keys, order, slicing)
    newer = F.coalesce(F.sum(VALUE).over(later_slots(keys)), F.lit(0))
    slots = (
        rows.filter(F.col(SLOT).isNotNull())
        .groupBy(*keys, SLOT)
        .agg(F.count("*").alias(VALUE))
        .select(*keys, SLOT, newer.alias(VALUE))
        .filter(F.col(VALUE) < n)
    )
    oldest = slots.groupBy(*keys).agg(F.min(SLOT).alias("_oldest"))
    oldest = oldest.withColumnsRenamed({key: f"_hot_{key}" for key in keys})
    # One row per hot key.
    side = oldest if slicing.hot is None else F.broadcast(oldest)
    kept = rows.join(side, hot.same_keys(rows, oldest, keys), "left").filter(F.col(SLOT).isNull() | (F.col(SLOT) >= F.col("_oldest")))
    seeded = kept.select(*rows.columns, F.lit(False).alias(SEED)).unionByName(
        slots.withColumn(SEED, F.lit(True)), allowMissingColumns=True
    )
    window = Window.partitionBy(*keys, SLOT).orderBy(F.col(SEED).desc(), *newest_first)
    sofar = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rank = F.coalesce(F.first(VALUE, ignorenulls=True).over(sofar), F.lit(0)) + F.count_if(~F.col(SEED)).over(sofar)
    return (
        seeded.withColumn(VALUE, rank)
        .filter(~F.col(SEED) & (F.col(VALUE) <= n))
        .drop(SLOT, SEED, VALUE)
    )
