"""Every operator applied to the given tables, each with the SQL that must give the same rows."""

from bindings import declared, fleet, health, history, sessions, shape, streams
from bindings.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "declared", "fleet", "health", "history", "sessions", "shape", "streams"]
