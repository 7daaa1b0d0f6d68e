"""All queries over the driver's tables, and their DuckDB equivalents."""

from __future__ import annotations

from tidewater.queries import products, sites, tables, texts
from tidewater.queries.base import Query
from tidewater.queries.products import flagship

GROUPS = (products.group, texts.group, tables.group, sites.group)


def queries() -> dict[str, Query]:
    return {name: f for g in GROUPS for name, f in g.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for g in GROUPS for name, sql in g.oracles.items()}


__all__ = ["flagship", "oracle_sql", "queries"]
