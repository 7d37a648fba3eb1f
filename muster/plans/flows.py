"""The end-to-end flows: packages at start, a package command, an API report, a health report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.operators.declared import (
    apply_requests,
    declared_packages,
    package_line,
    package_rows,
    remove_packages,
    request_outcome,
    valid_requests,
    validate_requests,
)
from muster.operators.health import classify_environment, error_count, threshold_flags, unpivot_readings, verdict
from muster.operators.shape import explode_records, first_record, project_fields
from muster.plans.hot import lookup
from muster.schemas import OPTION_KEYS, STATE_KEYS

KEYS = ("installation_id",)


def startup_packages(options: DataFrame, state: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The package line per installation and kind from parsed options and parsed package state."""
    configured = package_rows(options, OPTION_KEYS, keys)
    recorded = package_rows(state, STATE_KEYS, keys)
    return package_line(declared_packages(configured, recorded, keys), keys)


def run_command(state: DataFrame, requests: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """State after one kind of command, and a report on every request.

    The additions of `requests` are applied before its removals; a log in which their order matters goes to
    `replay_commands`. The report has each request with its `reason` if it was rejected and its `outcome` if it was
    an addition that was carried out.
    """
    accepted = valid_requests(requests)
    additions = accepted.filter(F.col("op") == "add")
    removals = accepted.filter(F.col("op") == "remove")
    after = remove_packages(apply_requests(state, additions, keys), removals, keys)
    done = request_outcome(additions, state, keys).select(*keys, "request_seq", "pos", "outcome")
    report = validate_requests(requests).join(done, [*keys, "request_seq", "pos"], "left")
    return after, report


def api_report(snapshots: DataFrame) -> dict[str, DataFrame]:
    """The four fixed views of the API replies."""
    return {
        "self": project_fields(snapshots, "addons/self/info", ["data.name", "data.version", "data.state"]),
        "host": project_fields(snapshots, "core/info", ["data.version", "data.machine", "data.operating_system"]),
        "addons": explode_records(snapshots, "addons", "data.addons", ["name", "slug", "version", "state"]),
        "network": first_record(
            snapshots, "network/info", "data.interfaces", {"interface": "interface", "ip_address": "ipv4.address"}
        ),
    }


def health_report(
    results: DataFrame, host_lines: DataFrame, keys: Sequence[str] = ("installation_id", "run_id")
) -> DataFrame:
    """Error count and verdict per run, with the kind of host for runs that failed only."""
    counts = verdict(error_count(results, keys=keys))
    hosts = classify_environment(host_lines, keys[:1]).select(keys[0], "environment")
    known = F.when(F.col("errors") > 0, F.col("environment"))
    return lookup(counts, hosts, keys[:1]).withColumn("environment", known)


def resource_flags(memory: DataFrame, disk: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Severity per host reading from parsed memory and disk tables."""
    readings = memory.join(disk, list(keys), "full")
    return threshold_flags(unpivot_readings(readings, keys, ["memory_available", "disk_free"]))
