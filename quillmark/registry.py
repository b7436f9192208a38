"""Queries of the catalogue engine and their SQL oracles."""

from __future__ import annotations

from . import edit_queries, index_queries, pixel_queries, store_queries  # noqa: F401 - register their queries
from . import queries as _queries


def queries() -> dict:
    return dict(_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_queries.ORACLES)
