"""Every query of the subpackage that SQL expresses, against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from quillmark import llm

from ..conftest import DATA
from ..oracle import rows_of_duckdb, rows_of_spark


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_equals_sql(spark, name):
    with duckdb.connect() as db:
        want = rows_of_duckdb(db, DATA, llm.oracle_sql()[name])
    assert rows_of_spark(llm.queries()[name](spark, DATA)) == want


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.oracle_sql())))
def test_runs_on_whole_tables(spark, name):
    assert llm.queries()[name](spark, DATA).count() > 0
