"""Registered queries: each runs one operator (or a job) over the driver's tables
through the bindings, paired with an ANSI SQL twin for the DuckDB oracle when the
operator is SQL-expressible. Names describe what the query computes."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def load_all() -> None:
    from . import history, hooks, instruct, metrics, molecules, nested, splits, texts  # noqa: F401
