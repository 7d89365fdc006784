"""Named queries over the driver's tables, with equivalent SQL where there is one."""

from __future__ import annotations

from . import dependencies, files, fixpoints, identities, lanes, matching, records, registry, scoring, sequences, spans

_OWN = (records.query, lanes.query, registry.query, dependencies.query, fixpoints.query, spans.query, files.query)


def queries() -> dict:
    found = matching.QUERIES | scoring.QUERIES | sequences.QUERIES | identities.QUERIES
    for catalogue in _OWN:
        found |= catalogue.queries
    return found


def oracle_sql() -> dict[str, str]:
    found = matching.SQL | scoring.SQL | sequences.SQL | identities.SQL
    for catalogue in _OWN:
        found |= catalogue.sql
    return found
