"""Reshaping JSON replies.

Replies are filtered by endpoint before their payload is parsed, because nothing can be pushed below the parse.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.functions.text import glob_to_like
from muster.schemas import ENDPOINTS

Fields = Sequence[str] | Mapping[str, str]


def as_paths(fields: Fields) -> dict[str, str]:
    """Output name to path; a plain list names each output after the path's last part."""
    if isinstance(fields, Mapping):
        return dict(fields)
    return {path.rsplit(".", 1)[-1]: path for path in fields}


def replies_of(df: DataFrame, endpoint: str, schema: str | None, endpoint_col: str, payload: str) -> DataFrame:
    """The replies of one endpoint with the parsed payload in `_reply`."""
    parsed = F.from_json(F.col(payload), schema or ENDPOINTS[endpoint])
    return df.filter(F.col(endpoint_col) == endpoint).withColumn("_reply", parsed)


def project_fields(
    df: DataFrame,
    endpoint: str,
    fields: Fields,
    keys: Sequence[str] = ("installation_id", "observed_at"),
    schema: str | None = None,
    endpoint_col: str = "endpoint",
    payload: str = "payload",
) -> DataFrame:
    """Chosen fields of each reply, one row per reply; an absent field is NULL."""
    replies = replies_of(df, endpoint, schema, endpoint_col, payload)
    return replies.select(*keys, *[F.col(f"_reply.{path}").alias(name) for name, path in as_paths(fields).items()])


def explode_records(
    df: DataFrame,
    endpoint: str,
    array: str,
    fields: Fields,
    keys: Sequence[str] = ("installation_id", "observed_at"),
    outer: bool = False,
    schema: str | None = None,
    endpoint_col: str = "endpoint",
    payload: str = "payload",
) -> DataFrame:
    """Chosen fields of each element of an array in the reply, one row per element.

    With `outer`, a reply without elements keeps one row of NULLs.
    """
    replies = replies_of(df, endpoint, schema, endpoint_col, payload)
    explode = F.explode_outer if outer else F.explode
    records = replies.select(*keys, explode(F.col(f"_reply.{array}")).alias("_record"))
    return records.select(*keys, *[F.col(f"_record.{path}").alias(name) for name, path in as_paths(fields).items()])


def first_record(
    df: DataFrame,
    endpoint: str,
    array: str,
    fields: Fields,
    keys: Sequence[str] = ("installation_id", "observed_at"),
    schema: str | None = None,
    endpoint_col: str = "endpoint",
    payload: str = "payload",
) -> DataFrame:
    """Chosen fields of the first element of an array in the reply; NULLs when there is none."""
    replies = replies_of(df, endpoint, schema, endpoint_col, payload)
    records = replies.select(*keys, first_element(F.col(f"_reply.{array}")).alias("_record"))
    return records.select(*keys, *[F.col(f"_record.{path}").alias(name) for name, path in as_paths(fields).items()])


def first_element(array: Column) -> Column:
    """The first element, NULL for an empty array."""
    return F.get(array, F.lit(0))


def passthrough(df: DataFrame, payload: str = "payload", name: str = "document") -> DataFrame:
    """The payload as it is, and beside it in `name` the same as a variant value.

    The value is NULL where the text is not JSON, or has a key twice, and may write numbers in another way; the text is
    what was received.
    """
    return df.withColumn(name, F.try_parse_json(F.col(payload)))


def any_of(conditions: Sequence[Column]) -> Column:
    """True if one of the conditions holds; a NULL condition does not."""
    result = F.lit(False)
    for condition in conditions:
        result = result | F.coalesce(condition, F.lit(False))
    return result


def match_any(
    df: DataFrame,
    col: str,
    include: Sequence[str],
    exclude: Sequence[str] = (),
    ignore_case: bool = False,
) -> DataFrame:
    """Rows whose text matches one of the `include` globs and none of the `exclude` globs.

    A glob is a pattern for the whole text; `*word*` finds a word anywhere.
    """
    def like(glob: str) -> Column:
        pattern = glob_to_like(glob)
        return F.col(col).ilike(pattern) if ignore_case else F.col(col).like(pattern)

    return df.filter(any_of([like(glob) for glob in include]) & ~any_of([like(glob) for glob in exclude]))
