"""A small table of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable


def register(queries: dict, oracles: dict, name: str, sql: str | None = None) -> Callable:
    """Decorator: the function becomes query ``name``, the text its counterpart."""

    def put(f: Callable) -> Callable:
        queries[name] = f
        if sql is not None:
            oracles[name] = sql
        return f

    return put
