"""Registration of queries with their oracles."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    """(queries, oracle SQL, decorator): the decorator takes the SQL, or nothing where SQL can't express the query."""
    queries: dict = {}
    oracle: dict = {}

    def query(sql: str | None = None) -> Callable:
        def register(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return register

    return queries, oracle, query
