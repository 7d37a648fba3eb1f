"""Readers and writers."""

from muster.sources.documents import (
    corrupt_documents,
    parse_options,
    parse_package_state,
    read_documents,
    read_options,
    read_package_state,
)
from muster.sources.feeds import read_api_snapshots, stream_entity_states
from muster.sources.host import parse_df, parse_meminfo, read_host_lines
from muster.sources.logs import parse_log_lines, read_log_lines
from muster.sources.versions import (
    latest_version,
    read_package_versions,
    read_version,
    write_package_state,
    write_version,
)

__all__ = [
    "corrupt_documents",
    "latest_version",
    "parse_df",
    "parse_log_lines",
    "parse_meminfo",
    "parse_options",
    "parse_package_state",
    "read_api_snapshots",
    "read_documents",
    "read_host_lines",
    "read_log_lines",
    "read_options",
    "read_package_state",
    "read_package_versions",
    "read_version",
    "stream_entity_states",
    "write_package_state",
    "write_version",
]
