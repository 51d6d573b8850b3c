"""A module's registry of queries."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    queries: dict = {}
    sql: dict = {}

    def query(name: str, oracle: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            queries[name] = f
            if oracle:
                sql[name] = oracle
            return f

        return add

    return queries, sql, query
