"""Every registered query of the catalogue engine against DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from quillmark import registry

from .conftest import DATA
from .oracle import rows_of_duckdb, rows_of_spark


#: Queries that have no row on the smallest tables.
EMPTY = {"injection_literal", "exact_duplicates_scoped", "near_scoped"}


@pytest.fixture(scope="module")
def db():
    with duckdb.connect() as connection:
        yield connection


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_equals_sql(spark, db, name):
    want = rows_of_duckdb(db, DATA, registry.oracle_sql()[name])
    got = rows_of_spark(registry.queries()[name](spark, DATA))
    assert got == want
    assert got[1] or name in EMPTY
