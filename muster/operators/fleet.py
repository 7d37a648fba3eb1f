"""Fleet-wide counts and averages."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.functions.timeline import span_text, whole_micros
from muster.schemas import LEVELS

DELAY = timedelta(hours=1)


def package_prevalence(
    packages: DataFrame,
    dimensions: Sequence[str] = ("arch", "kind", "package"),
    installation: str = "installation_id",
    approx: bool = False,
    cube: bool = False,
) -> DataFrame:
    """Installations per dimension with subtotals, `level` telling which dimensions are summed over.

    Rows are reduced before they are multiplied by the subtotals: to one per finest group and installation, or with
    `approx` to one sketch of fixed size per finest group, which subtotals unite.
    """
    if approx:
        sketch = F.hll_sketch_agg(installation).alias("_sketch")
        finest = packages.filter(F.col(installation).isNotNull()).groupBy(*dimensions).agg(sketch)
        count = F.hll_sketch_estimate(F.hll_union_agg("_sketch"))
    else:
        finest = packages.select(*dimensions, installation).distinct()
        count = F.count_distinct(F.col(installation))
    grouped = finest.cube(*dimensions) if cube else finest.rollup(*dimensions)
    return grouped.agg(count.alias("installations"), F.grouping_id().alias("level"))


def severity_counts(
    logs: DataFrame, keys: Sequence[str], level: str = "level", levels: Sequence[str] = LEVELS
) -> DataFrame:
    """Number of lines per key, one column per level and `other` for the rest, 0 where there are none.

    Lines without a level, such as those that did not match their pattern, are among the rest.
    """
    listed = F.coalesce(F.col(level).isin(*levels), F.lit(False))
    return logs.groupBy(*keys).agg(
        *[F.count_if(F.col(level) == name).alias(name) for name in levels], F.count_if(~listed).alias("other")
    )


def severity_counts_stream(
    lines: DataFrame,
    window: timedelta,
    keys: Sequence[str] = (),
    ts: str = "ts",
    level: str = "level",
    delay: timedelta = DELAY,
) -> DataFrame:
    """Number of lines per window, key and level. Works on a table, and on a stream in append mode."""
    timed = lines.withColumn("_ts", F.col(ts).cast("timestamp"))
    if lines.isStreaming:
        timed = timed.withWatermark("_ts", span_text(delay))
    counts = timed.groupBy(F.window("_ts", span_text(window)).alias("_window"), *keys, level).count()
    return counts.select(
        F.col("_window.start").alias("window_start"), *keys, level, F.col("count").alias("n_lines")
    )


def average_states(
    states: DataFrame,
    groups: Sequence[str],
    window: timedelta,
    slide: timedelta | None = None,
    ts: str = "ts",
    state: str = "state",
    delay: timedelta = DELAY,
) -> DataFrame:
    """Average of the numeric states per group and window, also on a stream; a state that is no number is left out.

    Windows that overlap share their panes, as wide as the largest span that divides window and slide: states are summed up
    per pane first, and only these sums are copied to the windows they belong to.
    """
    timed = states.withColumn("_ts", F.col(ts).cast("timestamp"))
    if states.isStreaming:
        timed = timed.withWatermark("_ts", span_text(delay))
    number = F.col(state).try_cast("double")
    overlapping = slide is not None and slide != window
    pane = timedelta(microseconds=gcd(whole_micros(window), whole_micros(slide))) if overlapping else window
    found = timed.groupBy(F.window("_ts", span_text(pane)).alias("_window"), *groups).agg(
        F.sum(number).alias("_sum"), F.count(number).alias("n_states")
    )
    if overlapping:
        bounds = F.window("_window", span_text(window), span_text(slide))
        found = found.groupBy(bounds.alias("_windows"), *groups).agg(F.sum("_sum").alias("_sum"), F.sum("n_states").alias("n_states"))
        found = found.withColumnRenamed("_windows", "_window")
    average = F.when(F.col("n_states") > 0, F.col("_sum") / F.col("n_states"))
    return found.select(F.col("_window.start").alias("window_start"), *groups, average.alias("average"), "n_states")


def installation_sketches(
    packages: DataFrame, dimensions: Sequence[str] = ("kind", "package"), installation: str = "installation_id", size: int = 14
) -> DataFrame:
    """`sketch` per dimension: the set of installations in at most 2^`size` numbers, however many there are.

    With a day among the dimensions, the sketches of further days are added to those that are stored.
    """
    given = packages.filter(F.col(installation).isNotNull())
    return given.groupBy(*dimensions).agg(F.theta_sketch_agg(installation, size).alias("sketch"))


def compare_sets(
    sketches: DataFrame, pairs: DataFrame, dimension: str = "package", left: str = "first", right: str = "second", size: int = 14
) -> DataFrame:
    """For each pair of members of a dimension, about how many installations have both, only the first, or either one.

    `sketches` may hold several for a member, such as one per day: they are united first. A member without installations
    counts as an empty set. Counts below 2^`size` are exact.
    """
    united = sketches.groupBy(dimension).agg(F.theta_union_agg("sketch", size).alias("_set"))

    def side(name: str, sketch: str) -> DataFrame:
        return united.select(F.col(dimension).alias(name), F.col("_set").alias(sketch))

    joined = pairs.join(side(left, "_one"), left, "left").join(side(right, "_two"), right, "left")
    one, two = F.col("_one"), F.col("_two")

    def count(sketch: Column) -> Column:
        return F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0)).cast("bigint")

    missing = one.isNull() | two.isNull()
    both = F.when(missing, F.lit(0)).otherwise(count(F.theta_intersection(one, two)))
    only = F.when(missing, count(one)).otherwise(count(F.theta_difference(one, two)))
    either = F.when(missing, count(one) + count(two)).otherwise(count(F.theta_union(one, two, size)))
    return joined.select(*pairs.columns, both.alias("both"), only.alias("only_first"), either.alias("either"))
