"""All queries of the core, by name."""

from __future__ import annotations

from lexisift.plans import cases, delivery, detection, review

MODULES = (delivery, detection, review, cases)


def core_queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def core_oracle() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}


def core_without_sql() -> dict[str, str]:
    """Why a query has no SQL."""
    return {k: s for m in MODULES for k, s in getattr(m, "NO_SQL", {}).items()}
