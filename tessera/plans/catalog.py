"""How a module of queries registers them."""

from __future__ import annotations

from collections.abc import Callable


def catalog() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """(queries, their SQL, a decorator that adds to both) of one module."""
    queries: dict[str, Callable] = {}
    texts: dict[str, str] = {}

    def query(name: str, sql: str | None = None) -> Callable:
        def keep(f: Callable) -> Callable:
            queries[name] = f
            if sql:
                texts[name] = sql
            return f

        return keep

    return queries, texts, query
