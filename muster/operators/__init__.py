"""Operators: functions from DataFrame to DataFrame, without actions inside."""

from muster.operators.declared import (
    apply_requests,
    declared_packages,
    distinct_packages,
    empty_groups,
    list_packages,
    match_name,
    package_documents,
    package_line,
    package_rows,
    recorded_rows,
    remove_packages,
    replay_commands,
    request_outcome,
    requests_missing,
    valid_requests,
    validate_requests,
)
from muster.operators.fleet import (
    average_states,
    compare_sets,
    installation_sketches,
    package_prevalence,
    severity_counts,
    severity_counts_stream,
)
from muster.operators.health import (
    any_true,
    attach_severity,
    classify_environment,
    error_count,
    threshold_flags,
    unpivot_readings,
    verdict,
    verdict_text,
)
from muster.operators.history import (
    asof_guard,
    conversation_list,
    latest_per_key,
    overlay_layers,
    retain_last_n,
    state_changes,
    top_n,
)
from muster.operators.sessions import (
    default_answer,
    explicit_sessions,
    gap_sessions,
    has_live_session,
    live_sessions,
    normalize_answer,
    resolve_answers,
    resolve_code,
    resolve_launch_mode,
    session_starts,
    silent_keys,
    summarize_sessions,
    validate_domain,
)
from muster.operators.shape import (
    any_of,
    explode_records,
    first_element,
    first_record,
    match_any,
    passthrough,
    project_fields,
)
from muster.operators.stored import remove_stored, store_packages, stored_packages
from muster.operators.variants import explode_paths, first_path, project_paths, schema_of_replies

__all__ = [
    "any_of",
    "any_true",
    "apply_requests",
    "asof_guard",
    "attach_severity",
    "average_states",
    "classify_environment",
    "compare_sets",
    "conversation_list",
    "declared_packages",
    "default_answer",
    "distinct_packages",
    "empty_groups",
    "error_count",
    "explicit_sessions",
    "explode_paths",
    "explode_records",
    "first_element",
    "first_path",
    "first_record",
    "gap_sessions",
    "has_live_session",
    "installation_sketches",
    "latest_per_key",
    "list_packages",
    "live_sessions",
    "match_any",
    "match_name",
    "normalize_answer",
    "overlay_layers",
    "package_documents",
    "package_line",
    "package_prevalence",
    "package_rows",
    "passthrough",
    "project_fields",
    "project_paths",
    "recorded_rows",
    "remove_packages",
    "remove_stored",
    "replay_commands",
    "request_outcome",
    "requests_missing",
    "resolve_answers",
    "resolve_code",
    "resolve_launch_mode",
    "retain_last_n",
    "schema_of_replies",
    "session_starts",
    "severity_counts",
    "severity_counts_stream",
    "silent_keys",
    "state_changes",
    "store_packages",
    "stored_packages",
    "summarize_sessions",
    "threshold_flags",
    "top_n",
    "unpivot_readings",
    "valid_requests",
    "validate_domain",
    "validate_requests",
    "verdict",
    "verdict_text",
]
