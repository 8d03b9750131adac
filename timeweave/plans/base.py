"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from timeweave.sources.fixtures import with_fixtures


def registrar() -> tuple[dict, dict[str, str], Callable]:
    """(queries, oracles, decorator): the decorator takes the SQL, empty for none, and the derived tables it uses."""
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(sql: str, *names: str):
        def put(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = with_fixtures(sql, *names) if names else sql
            return f

        return put

    return queries, oracles, query
