"""The registered queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from tessera.plans import audit, contracts, learning, models, pairing, records, sources

FLAGSHIP = "documents_manifest"
_MODULES = (audit, pairing, contracts, learning, sources, models, records)


def queries() -> dict[str, Callable]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
