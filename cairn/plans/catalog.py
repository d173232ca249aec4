"""All core queries with the SQL that states their result."""

from __future__ import annotations

from cairn.plans import feed, retrieval, stated
from cairn.session import tidy

MODULES = [retrieval, stated, feed]


def queries() -> dict:
    """By name; each deletes the intermediate tables that its result does not read."""
    return {k: tidy(f) for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
