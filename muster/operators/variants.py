"""Reshaping JSON replies without a declared schema: paths into variant values, and a schema found in the data."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Fields = Mapping[str, tuple[str, str]]


def path_of(path: str) -> str:
    return path if path.startswith("$") else f"$.{path}"


def value_at(value: Column, path: str, kind: str) -> Column:
    """The value at a path, NULL where there is none or it is not of that kind."""
    return F.try_variant_get(value, path_of(path), kind)


def replies_as_variants(df: DataFrame, endpoint: str, endpoint_col: str, payload: str) -> DataFrame:
    return df.filter(F.col(endpoint_col) == endpoint).withColumn("_reply", F.try_parse_json(F.col(payload)))


def project_paths(
    df: DataFrame,
    endpoint: str,
    fields: Fields,
    keys: Sequence[str] = ("installation_id", "observed_at"),
    endpoint_col: str = "endpoint",
    payload: str = "payload",
) -> DataFrame:
    """`project_fields` for an endpoint without a schema: `fields` maps each output to a path and a type.

    One row per reply; NULL for an absent field, for a value that is not of its type, and for a payload that is no JSON.
    """
    replies = replies_as_variants(df, endpoint, endpoint_col, payload)
    return replies.select(*keys, *[value_at(F.col("_reply"), *at).alias(name) for name, at in fields.items()])


def explode_paths(
    df: DataFrame,
    endpoint: str,
    array: str,
    fields: Fields,
    keys: Sequence[str] = ("installation_id", "observed_at"),
    outer: bool = False,
    endpoint_col: str = "endpoint",
    payload: str = "payload",
) -> DataFrame:
    """`explode_records` for an endpoint without a schema: one row per element of the array at a path."""
    replies = replies_as_variants(df, endpoint, endpoint_col, payload)
    explode = F.explode_outer if outer else F.explode
    records = replies.select(*keys, explode(value_at(F.col("_reply"), array, "array<variant>")).alias("_record"))
    return records.select(*keys, *[value_at(F.col("_record"), *at).alias(name) for name, at in fields.items()])


def first_path(
    df: DataFrame,
    endpoint: str,
    array: str,
    fields: Fields,
    keys: Sequence[str] = ("installation_id", "observed_at"),
    endpoint_col: str = "endpoint",
    payload: str = "payload",
) -> DataFrame:
    """`first_record` for an endpoint without a schema: fields of the first element, NULLs when there is none."""
    paths = {name: (f"{path_of(array)}[0].{path}", kind) for name, (path, kind) in fields.items()}
    return project_paths(df, endpoint, paths, keys, endpoint_col, payload)


def schema_of_replies(df: DataFrame, endpoint: str, endpoint_col: str = "endpoint", payload: str = "payload") -> str | None:
    """The schema that all replies of an endpoint fit, merged over every reply before it is brought together.

    In the form that `project_fields` and `explode_records` take; a key whose value is always null is text. None if no
    reply is a JSON object.
    """
    replies = replies_as_variants(df, endpoint, endpoint_col, payload)
    found = replies.agg(F.schema_of_variant_agg("_reply").alias("schema")).first()["schema"]
    if not found or not found.startswith("OBJECT<"):
        return None
    return re.sub(r"\bVOID\b", "STRING", re.sub(r"\bOBJECT<", "STRUCT<", found))
