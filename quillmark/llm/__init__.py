"""Operators for large training corpora, with their queries and SQL oracles."""

from __future__ import annotations

from importlib import import_module

MODULES = ("langid", "dartminhash", "htmltext", "winnow", "linededup", "pfair", "topk", "chat", "pieces", "suffixdedup", "merkle", "cobuckets", "urlfilter")


def _parts() -> list:
    return [import_module(f"{__name__}.{name}") for name in MODULES]


def queries() -> dict:
    return {name: query for part in _parts() for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _parts() for name, sql in part.ORACLES.items()}
