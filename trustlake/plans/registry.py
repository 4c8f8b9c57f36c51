"""Registry of runnable queries and, beside each, the same question in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trustlake.plans.fixtures import DUCK_VIEWS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _views_in(sql: str, found: dict[str, str]) -> None:
    for name, body in DUCK_VIEWS.items():
        if name not in found and re.search(rf"\b{name}\b", sql):
            _views_in(body, found)
            found[name] = body


def with_views(sql: str) -> str:
    """Put the views a statement mentions in front of it as common table expressions."""
    found: dict[str, str] = {}
    _views_in(sql, found)
    if not found:
        return sql
    ctes = ",\n".join(f"{name} as materialized (\n{body}\n)" for name, body in found.items())
    body = sql.strip()
    for opening in ("with recursive", "with"):
        if body.lower().startswith(opening):
            return f"{opening} {ctes},\n{body[len(opening):].lstrip()}"
    return f"with {ctes}\n{body}"


def query(name: str, oracle: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return register
