"""Host readings, thresholds and check results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.plans.small import join_rules
from muster.schemas import CHECK_RULES, CHECK_RULES_SCHEMA, HOST_LIMITS, HOST_MARKERS

LIMITS_SCHEMA = "metric STRING, lower_limit DOUBLE, severity STRING"


def unpivot_readings(readings: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per key and metric from one column per metric."""
    return readings.unpivot(list(keys), list(metrics), "metric", "value")


def threshold_flags(
    readings: DataFrame,
    rules: DataFrame | Sequence[tuple] = HOST_LIMITS,
    metric: str = "metric",
    value: str = "value",
) -> DataFrame:
    """Add `severity`: that of the metric's rule if the value is below its limit, else `info`.

    `rules` is `(metric, lower_limit, severity)`; a metric without a rule and a missing value are `info`.
    """
    below = F.col(value) < F.col("lower_limit")
    return (
        join_rules(readings, rules, LIMITS_SCHEMA, {"metric": metric, "severity": "_severity"}, metric)
        .withColumn("severity", F.when(below, F.col("_severity")).otherwise("info"))
        .drop("lower_limit", "_severity")
    )


def attach_severity(
    results: DataFrame, rules: DataFrame | Sequence[tuple] = CHECK_RULES, probe: str = "probe", failed: str = "failed"
) -> DataFrame:
    """Add the check a probe belongs to, its severity (`info` unless failed) and whether the failure counts."""
    names = {"probe": probe, "severity": "_severity", "counts_as_failure": "_counts"}
    hit = F.coalesce(F.col(failed), F.lit(False))
    return (
        join_rules(results, rules, CHECK_RULES_SCHEMA, names, probe)
        .withColumn("severity", F.when(hit, F.col("_severity")).otherwise("info"))
        .withColumn("counts_as_failure", hit & F.coalesce(F.col("_counts"), F.lit(False)))
        .drop("_severity", "_counts")
    )


def error_count(
    results: DataFrame,
    rules: DataFrame | Sequence[tuple] = CHECK_RULES,
    keys: Sequence[str] = ("installation_id", "run_id"),
    probe: str = "probe",
    failed: str = "failed",
) -> DataFrame:
    """Failed checks per run; several failed probes of one check count once."""
    checks = (
        attach_severity(results, rules, probe, failed)
        .groupBy(*keys, "check_name")
        .agg(F.bool_or("counts_as_failure").alias("_failed"))
    )
    return checks.groupBy(*keys).agg(F.count_if("_failed").alias("errors"))


def verdict_text(errors: Column) -> Column:
    """`passed`, or how many checks failed."""
    return F.when(errors == 0, "passed").otherwise(F.concat(errors.cast("string"), F.lit(" check(s) failed")))


def verdict(counts: DataFrame, errors: str = "errors") -> DataFrame:
    """Add the verdict text of an error count."""
    return counts.withColumn("verdict", verdict_text(F.col(errors)))


def any_true(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Per key, whether `col` is true in some row; false if it is NULL in all."""
    return df.groupBy(*keys).agg(F.coalesce(F.bool_or(col), F.lit(False)).alias(col))


def classify_environment(
    lines: DataFrame, keys: Sequence[str] = ("installation_id",), source: str = "source", line: str = "line"
) -> DataFrame:
    """Per key, one flag per host marker and the `environment` they show."""
    flags = lines.groupBy(*keys).agg(
        *[
            F.bool_or((F.col(source) == file) & F.coalesce(F.col(line).contains(text), F.lit(False))).alias(name)
            for name, (file, text) in HOST_MARKERS.items()
        ]
    )
    label = F.lit("other")
    for name in reversed(HOST_MARKERS):
        label = F.when(F.col(name), name).otherwise(label)
    return flags.withColumn("environment", label)
