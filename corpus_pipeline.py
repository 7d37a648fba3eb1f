"""A corpus cleaned and packed: each stage works on all rows its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm import decontamination, line_dedup, near_copies, packing, toxicity
from muster.llm.common import fresh, saved

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def names(docs: DataFrame) -> list:
    """The columns as they are named, dots included."""
    return [F.col(f"`{name}`") for name in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. What is learned comes from the labels of documents that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = fresh("_score", docs.columns)
    scored = toxicity.score(docs, toxicity.learn(docs, labels), name=score)
    return scored.filter(F.col(score) < 0.5).select(names(docs))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least ten documents share go from all documents; every document stays, with its new length."""
    counts = (fresh("_n_lines", docs.columns), fresh("_n_dropped", docs.columns))
    kept = line_dedup.drop_frequent_lines(docs, counts=counts)
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(names(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return near_copies.one_of_each(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    name = fresh("_items", docs.columns)
    found = decontamination.with_items(docs, items, name=name)
    return found.filter(F.size(name) == 0).select(names(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its place in a sequence."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack_documents(docs, ranks, public_tokenizers.PATTERN, special=packing.SPECIAL)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark_copies),
    ("packing", pack),
]
# A learned score, fingerprints, ranked search and packing are not SQL; every stage is tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after all stages, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
