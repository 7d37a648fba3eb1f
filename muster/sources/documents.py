"""JSON documents: declared options and recorded packages.

One row holds one document as text. Missing file, missing key, NULL and empty list all end up as an empty list; a
document that does not parse also does, but keeps its text in `_corrupt_record`, so that it can be set aside and is
never written back.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muster.schemas import CORRUPT, OPTION_KEYS, STATE_KEYS

PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}


KEYS = "installation_id STRING"


def read_documents(spark: SparkSession, path: str, per_line: bool = False, keys: str = KEYS) -> DataFrame:
    """One row per file, or per line, with its text in `raw`; directories like `installation_id=a` become columns.

    `keys` declares those columns and their types, "" for none. A path that does not exist has no documents. Very many
    small files are slow to list and open; land documents as lines of large files where possible.
    """
    columns = T.StructType.fromDDL(keys).fields if keys else []
    try:
        rows = spark.read.text(path, wholetext=not per_line)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T.StructType([T.StructField("raw", T.StringType()), *columns]))
    named = [F.col(column.name).cast(column.dataType).alias(column.name) for column in columns if column.name in rows.columns]
    return rows.select(F.col("value").alias("raw"), *named)


def parsed(raw: Column, schema: str) -> Column:
    """The document as a struct, with its text in `_corrupt_record` if any part of it did not fit."""
    return F.from_json(raw, f"{schema}, {CORRUPT} STRING", PERMISSIVE)


def list_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.array().cast("array<string>"))


def parse_package_state(documents: DataFrame, raw: str = "raw") -> DataFrame:
    """Replace `raw` by one array column per package kind and `_corrupt_record`."""
    schema = ", ".join(f"{key} ARRAY<STRING>" for key in STATE_KEYS.values())
    others = [name for name in documents.columns if name != raw]
    return documents.withColumn("_document", parsed(F.col(raw), schema)).select(
        *others,
        *[list_or_empty(F.col(f"_document.{key}")).alias(key) for key in STATE_KEYS.values()],
        F.col(f"_document.{CORRUPT}").alias(CORRUPT),
    )


def parse_options(documents: DataFrame, launch_key: str, raw: str = "raw") -> DataFrame:
    """Replace `raw` by `auto_launch`, one array column per package kind and `_corrupt_record`.

    `launch_key` names the document's launch option. Its value is compared as text: `true` or missing means true, any
    other value false.
    """
    schema = ", ".join([f"`{launch_key}` STRING", *[f"{key} ARRAY<STRING>" for key in OPTION_KEYS.values()]])
    others = [name for name in documents.columns if name != raw]
    launch = F.coalesce(F.col(f"_document.`{launch_key}`"), F.lit("true")) == "true"
    return documents.withColumn("_document", parsed(F.col(raw), schema)).select(
        *others,
        launch.alias("auto_launch"),
        *[list_or_empty(F.col(f"_document.{key}")).alias(key) for key in OPTION_KEYS.values()],
        F.col(f"_document.{CORRUPT}").alias(CORRUPT),
    )


def read_package_state(spark: SparkSession, path: str, per_line: bool = False, keys: str = KEYS) -> DataFrame:
    """Recorded packages, one row per document below `path`; none if there is no such path."""
    return parse_package_state(read_documents(spark, path, per_line, keys))


def read_options(
    spark: SparkSession, path: str, launch_key: str, per_line: bool = False, keys: str = KEYS
) -> DataFrame:
    """Declared options, one row per document below `path`; none if there is no such path."""
    return parse_options(read_documents(spark, path, per_line, keys), launch_key)


def corrupt_documents(parsed_documents: DataFrame) -> DataFrame:
    """The rows whose document did not parse as declared."""
    return parsed_documents.filter(F.col(CORRUPT).isNotNull())
