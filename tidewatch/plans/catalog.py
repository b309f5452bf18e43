"""Registry of named queries, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")
        REGISTRY[name] = Entry(fn, sql)
        return fn

    return add


def rounded(column: str | Column, digits: int = 6, name: str | None = None) -> Column:
    """Engines add floats in different orders, so compared values are rounded."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.round(c.cast("double"), digits)
    return out.alias(name or column) if (name or isinstance(column, str)) else out


def all_queries() -> dict[str, Entry]:
    from tidewatch.plans import (  # noqa: F401  (importing registers)
        queries_alerts, queries_data, queries_features, queries_metrics, queries_models, queries_views,
    )

    return dict(REGISTRY)
