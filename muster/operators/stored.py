"""Recorded packages stored by buckets of their names, so that requests come to them and they stay where they are.

Each version is a bucketed table in a folder of its own, which says how many buckets it has. Rows carry the name under which
a package is looked up, and are spread by key, kind and that name: a key with very many packages is in all buckets. Joining
requests on these columns shuffles the requests only, into as many partitions as there are buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muster.operators.declared import KEYS, MATCH, matched
from muster.schemas import FOLDED_KINDS
from muster.sources.versions import finished_folders, version_of


def bucketed_path(path: str, buckets: int | str, version: int | str) -> str:
    return f"{path}/buckets={buckets}/version={version}"


def table_name(folder: str) -> str:
    return f"stored_{hashlib.md5(folder.encode()).hexdigest()}"


def names(columns: Sequence[str]) -> str:
    return ", ".join(f"`{column}`" for column in columns)


def store_packages(
    state: DataFrame,
    path: str,
    version: int,
    keys: Sequence[str] = KEYS,
    folded: Sequence[str] = FOLDED_KINDS,
    buckets: int | None = None,
) -> None:
    """Write recorded packages in row form as a version below `path`. A finished version is an error.

    `buckets` is the number of partitions that later joins have: about the bytes of the state divided by those that suit
    one task, and by default the session's shuffle partitions. With fewer, Spark shuffles both sides after all.
    """
    spark = state.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if finished_folders(spark, bucketed_path(path, "*", version)):
        raise FileExistsError(f"version {version} below {path} already exists")
    on, folder = [*keys, "kind", MATCH], bucketed_path(path, buckets, version)
    rows = matched(state, folded).repartition(buckets, *on)
    table = table_name(folder)
    rows.write.mode("overwrite").bucketBy(buckets, *on).sortBy(*on).option("path", folder).saveAsTable(table)
    # The catalog forgets the table, its files stay: readers, in this session too, take it from the folder.
    spark.sql(f"DROP TABLE {table}")


def stored_packages(
    spark: SparkSession,
    path: str,
    version: int | None = None,
    keys: Sequence[str] = KEYS,
    schema: str = "installation_id STRING, kind STRING, package STRING",
) -> DataFrame:
    """A version of the stored packages, by default the newest, with the name they are looked up by in `_match`.

    A path without versions has no packages; its columns are those of `schema`.
    """
    found = {version_of(folder): folder for folder in finished_folders(spark, bucketed_path(path, "*", "*" if version is None else version))}
    if not found:
        if version is not None:
            raise FileNotFoundError(f"no finished version {version} below {path}")
        columns = T.StructType.fromDDL(schema).add(MATCH, T.StringType())
        return spark.createDataFrame([], columns)
    folder = found[max(found)]
    buckets, on = int(folder.split("buckets=")[1].split("/")[0]), names([*keys, "kind", MATCH])
    table = table_name(folder)
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(folder).schema.fields)
        spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet LOCATION '{folder}' "
            f"CLUSTERED BY ({on}) SORTED BY ({on}) INTO {buckets} BUCKETS"
        )
    return spark.table(table)


def remove_stored(
    state: DataFrame, removals: DataFrame, keys: Sequence[str] = KEYS, folded: Sequence[str] = FOLDED_KINDS
) -> DataFrame:
    """`remove_packages` of stored packages: rows that no removal names exactly, found by the name they are stored by.

    The spellings that are removed come as one list per name.
    """
    on = [*keys, "kind", MATCH]
    spellings = matched(removals, folded).groupBy(*on).agg(F.collect_set("package").alias("_removed"))
    gone = F.coalesce(F.array_contains("_removed", F.col("package")), F.lit(False))
    return state.join(spellings, on, "left").filter(~gone).select(*state.columns)
