"""What the modules of queries share."""

from __future__ import annotations

from collections.abc import Callable


def registrar() -> tuple[dict, dict[str, str], Callable]:
    """Queries by name, SQL by name, and the decorator that puts a query and its SQL there."""
    queries: dict = {}
    sql: dict[str, str] = {}

    def register(name: str, text: str | None = None):
        def add(f):
            queries[name] = f
            if text:
                sql[name] = text
            return f

        return add

    return queries, sql, register
