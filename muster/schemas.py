"""Schemas and fixed vocabularies."""

from __future__ import annotations

CORRUPT = "_corrupt_record"

# Keys of the documents and replies that are read.
KINDS = ("apk", "pip")
FOLDED_KINDS = ("pip",)
STATE_KEYS = {"apk": "apk_packages", "pip": "pip_packages"}
OPTION_KEYS = {"apk": "persistent_apk_packages", "pip": "persistent_pip_packages"}
ENDPOINTS = {
    "addons/self/info": "data STRUCT<name: STRING, version: STRING, state: STRING>",
    "core/info": "data STRUCT<version: STRING, machine: STRING, operating_system: STRING>",
    "addons": "data STRUCT<addons: ARRAY<STRUCT<name: STRING, slug: STRING, version: STRING, state: STRING>>>",
    "network/info": "data STRUCT<interfaces: ARRAY<STRUCT<interface: STRING, ipv4: STRUCT<address: VARIANT>>>>",
}

# Commands of a package request; a missing command asks for help.
DEFAULT_COMMAND = "help"
COMMANDS = ("add", "list", "remove", "help")
HELP_OPTIONS = ("--help", "-h")

# Limits of the host readings in megabytes; a reading below its limit is an error.
HOST_LIMITS = [
    ("memory_available", 256.0, "error"),
    ("disk_free", 100.0, "error"),
]

# Severity of a failed probe, and whether it makes its check count as failed.
CHECK_RULES = [
    ("memory_available", "system resources", "error", False),
    ("disk_free", "system resources", "error", False),
    ("data_writable", "permissions", "error", True),
    ("data_mkdir", "permissions", "error", True),
    ("node", "node", "error", True),
    ("npm", "node", "error", True),
    ("cli_executable", "cli", "error", True),
    ("cli_found", "cli", "error", True),
    ("dns", "network", "error", False),
    ("npm_registry", "network", "warning", False),
    ("container_registry", "network", "error", False),
    ("vendor_api", "network", "warning", False),
]
CHECK_RULES_SCHEMA = "probe STRING, check_name STRING, severity STRING, counts_as_failure BOOLEAN"

# Text that shows a virtualised host.
HOST_MARKERS = {"virtualbox": ("modules", "vboxguest"), "virtual": ("cpuinfo", "QEMU Virtual CPU")}

# Menu answers and what each does.
MENU_CODES = [
    ("0", "reconnect"),
    ("1", "new"),
    ("2", "continue"),
    ("3", "resume"),
    ("4", "custom"),
    ("5", "auth_helper"),
    ("6", "shell"),
    ("7", "exit"),
]
MENU_CODES_SCHEMA = "answer STRING, action STRING"

# Session actions: REPLACING ends a live session and starts the next, JOINING starts one only if none is live,
# ENDED leaves none. Every other action leaves the session as it is.
REPLACING = ("new", "continue", "resume", "custom")
JOINING = "attach_or_create"
ENDED = "ended"

LEVELS = ("info", "warning", "error")

API_SNAPSHOT_SCHEMA = (
    "installation_id STRING, observed_at TIMESTAMP, endpoint STRING, method STRING, payload STRING"
)
ENTITY_STATE_SCHEMA = "installation_id STRING, ts TIMESTAMP, entity_id STRING, state STRING"
