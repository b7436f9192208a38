"""Small catalogues for tests."""

from __future__ import annotations

from quillmark.operators import annotate
from quillmark.sources.catalog import Catalog, empty
from quillmark.sources.schema import SCHEMAS


def record(path, content_hash=None, **values):
    base = dict(id=None, path=path, content_hash=content_hash or "h" + path, phash=None, size=100, mtime=42, width=None, height=None, format=None, date_taken=None, camera=None, orientation=None, indexed_at=1, missing=False)
    return base | values


def files(spark, *records) -> Catalog:
    rows = [tuple((r | {"id": r["id"] or i}).values()) for i, r in enumerate(records, 1)]
    return empty(spark).with_tables(files=spark.createDataFrame(rows, SCHEMAS["files"]))


def tagged(catalog: Catalog, **tags) -> Catalog:
    for name, hashes in tags.items():
        catalog = annotate.apply_tag(catalog, name, hashes)
    return catalog


def paths(df) -> list[str]:
    return [r["path"] for r in df.collect()]


def pairs(df, *columns) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
