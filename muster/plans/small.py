"""Small literal tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muster.plans.hot import lookup

MAX_ROWS = 10_000


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table whose rows are part of the plan.

    Catalyst knows its exact size, so joins against it are broadcast by Spark's own size check, without a hint. More
    than `MAX_ROWS` rows are refused: such a table belongs in storage.
    """
    if len(rows) > MAX_ROWS:
        raise ValueError(f"{len(rows)} literal rows; the limit is {MAX_ROWS}, pass a DataFrame instead")
    fields = T.StructType.fromDDL(schema).fields
    if not rows:
        empty = [F.lit(None).cast(field.dataType).alias(field.name) for field in fields]
        return spark.range(0).select(*empty)
    records = F.array(
        *[
            F.struct(*[F.lit(value).cast(field.dataType).alias(field.name) for value, field in zip(row, fields)])
            for row in rows
        ]
    )
    return spark.range(1).select(F.inline(records))


def join_rules(
    df: DataFrame, rules: DataFrame | Sequence[tuple], schema: str, names: Mapping[str, str], on: str
) -> DataFrame:
    """Left join with rules of one row per key, given as literal rows or as a DataFrame, with columns renamed."""
    if isinstance(rules, DataFrame):
        return lookup(df, rules.withColumnsRenamed(dict(names)), [on])
    return df.join(literal_table(df.sparkSession, rules, schema).withColumnsRenamed(dict(names)), on, "left")
