"""Registration of queries with their oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bindings import views

_QUERIES: dict[str, Callable[[views.Tables], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
_SHARED: dict[str, str] = {}


def shared(name: str, sql: str) -> None:
    """A CTE that several oracle queries read."""
    _SHARED[name] = sql


def query(key: str, sql: str | None = None):
    """Register fn(tables) under a key, with the SQL that must give the same rows."""

    def register(fn):
        assert key not in _QUERIES, key
        _QUERIES[key] = fn
        if sql is not None:
            _ORACLES[key] = sql
        return fn

    return register


def _expand(sql: str) -> str:
    known = {**{n: views.cte(n) for n in views.names()}, **_SHARED}
    order: list[str] = []

    def visit(text: str, inside: tuple[str, ...]) -> None:
        for name in known:
            if name not in inside and name not in order and re.search(rf"\b{name}\b", text):
                visit(known[name], inside + (name,))
                order.append(name)

    visit(sql, ())
    ctes = ",\n".join(f"{n} as ({known[n]})" for n in order)
    recursive = re.match(r"\s*with recursive ", sql)
    if recursive:
        return f"with recursive {ctes},\n{sql[recursive.end():]}"
    plain = re.match(r"\s*with ", sql)
    if plain:
        return f"with {ctes},\n{sql[plain.end():]}"
    return f"with {ctes}\n{sql}"


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(views.Tables(spark, sf_dir))

    return {key: bind(fn) for key, fn in _QUERIES.items()}


def oracle_queries() -> dict[str, str]:
    return {key: _expand(sql) for key, sql in _ORACLES.items()}
