"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings the operators count on. Sizes (memory, cores, shuffle partitions) belong to the cluster and are not set here.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Sessions of one key are merged inside each input partition before they are shuffled, so that a key with very
    # many events sends few rows to the task that owns it.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(app_name: str = "muster", **extra: str) -> SparkSession:
    """A session with the settings above; `extra` adds or replaces some."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the same settings on a session somebody else built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


# Applications whose tasks have this package.
SHARED: set[str] = set()


def share_package(spark: SparkSession) -> None:
    """Give Python tasks this package, unless they find it where the driver does: Spark hands its archive to executors."""
    root, context = pathlib.Path(__file__).resolve().parents[1], spark.sparkContext
    known = str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if known or context.applicationId in SHARED or not root.is_dir():
        return
    archive = pathlib.Path(tempfile.mkdtemp(prefix="muster-")) / "muster-package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((root / "muster").rglob("*.py")):
            if "llm" not in path.relative_to(root).parts:
                out.write(path, path.relative_to(root))
    context.addPyFile(str(archive))
    SHARED.add(context.applicationId)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`, or where that is unset one below the warehouse, shared too."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return (configured or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch").rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/muster/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written below the shared folder and read from there, of a size that Spark then knows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read from there, so that they outlive any executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{scratch_root(df.sparkSession)}/checkpoints")
    return df.checkpoint()
