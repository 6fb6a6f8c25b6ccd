"""Queries over the given tables, by name, and the same queries in SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of (session, folder) and the SQL that says the same."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


from . import q_archive, q_curation, q_extract, q_feed, q_intervals, q_keys, q_layouts, q_more, q_reads, q_routing, q_state, q_store, q_streams, q_verify  # noqa: E402, F401
