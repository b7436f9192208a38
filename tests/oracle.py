"""Rows of Spark and DuckDB results in one comparable form."""

from __future__ import annotations

import datetime
import decimal
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 9)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, dict):
        return tuple(plain(x) for x in value.values())
    return value


def ordered(names, rows):
    by_name = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in by_name], sorted((tuple(plain(r[i]) for i in by_name) for r in rows), key=repr)


def rows_of_spark(df):
    return ordered(df.columns, [tuple(r) for r in df.collect()])


def rows_of_duckdb(db, sf_dir: str, sql: str):
    for table in TABLES:
        if Path(f"{sf_dir}/{table}.parquet").exists():
            db.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    done = db.execute(sql)
    return ordered([d[0] for d in done.description], done.fetchall())
