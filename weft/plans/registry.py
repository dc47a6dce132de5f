"""Registration of queries: a name is taken once."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    """(queries, oracles, the decorator that adds a query and its SQL to them) of a module."""
    queries: dict[str, Callable] = {}
    oracles: dict[str, str] = {}

    def query(oracle: str | None = None):
        def add(f):
            if f.__name__ in queries:
                raise ValueError(f"query {f.__name__} is there already")
            queries[f.__name__] = f
            if oracle:
                oracles[f.__name__] = oracle
            return f

        return add

    return queries, oracles, query


def merged(*modules) -> tuple[dict, dict]:
    """Queries and oracles of all modules; a name that two of them have is an error."""
    queries: dict[str, Callable] = {}
    oracles: dict[str, str] = {}
    for module in modules:
        if again := queries.keys() & module.QUERIES.keys():
            raise ValueError(f"queries registered twice: {sorted(again)}")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
