"""The catalogue: ten tables, read from and committed to immutable snapshots.

A snapshot's tables are manifests of sorted segments (``segments``); ``_log/<n>.json`` names those of
version n and is created exclusively, so that of two writers who start from one version exactly one
commits. Readers pin a version when they open it. Nothing is overwritten. A commit writes what changed:
tables that no transition touched keep their manifest, and of a touched one only the segments that own a
changed key are written again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..plans.components import written
from . import segments
from .schema import CURRENT_VERSION, SCHEMAS, SORT_KEYS, conform, tables_at
from .segments import Segment
from .versions import CommitConflict, Versioned


__all__ = ["Catalog", "CommitConflict", "Store", "empty", "from_testdata", "migrated"]

#: Tables of one commit that are written at a time: most of a small one's time is waiting for its jobs.
WRITERS = 4

Table = DataFrame | Callable[[], DataFrame]


@dataclass(frozen=True)
class Catalog:
    """Tables by name. A table may be given as a function: it is planned when it is first used.

    origin is the store that the catalogue was opened from. changed has the tables that differ from that
    version: the keys (as DataFrames of one column) that may differ, or None for the whole table.
    """

    spark: SparkSession
    tables: dict[str, Table] = field(default_factory=dict)
    version: int = 0
    origin: str | None = None
    changed: dict[str, list[DataFrame] | None] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        found = self.tables[name]
        if not isinstance(found, DataFrame):
            found = self.tables[name] = conform(found(), name)
        return found

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMAS:
            return self.table(name)
        raise AttributeError(name)

    def with_tables(self, **tables: Table) -> Catalog:
        made = {n: conform(t, n) if isinstance(t, DataFrame) else t for n, t in tables.items()}
        return replace(self, tables=self.tables | made, changed=self.changed | dict.fromkeys(tables))

    def with_rows(self, table: str, rows: DataFrame, keys: DataFrame) -> Catalog:
        """The table after a change of no other rows than those of the keys (of its sort key, one column)."""
        known = self.changed.get(table, [])
        name = SORT_KEYS[table]
        keys = keys.toDF(name).select(F.col(name).cast(SCHEMAS[table][name].dataType))
        return replace(self, tables=self.tables | {table: conform(rows, table)}, changed=self.changed | {table: None if known is None else [*known, keys]})

    def meta_value(self, key: str) -> str | None:
        row = self.meta.filter(F.col("key") == key).select("value").first()
        return row["value"] if row else None

    def schema_version(self) -> int:
        return int(self.meta_value("schema_version") or CURRENT_VERSION)


def empty(spark: SparkSession) -> Catalog:
    return Catalog(spark, {name: partial(spark.createDataFrame, [], schema) for name, schema in SCHEMAS.items()})


def migrated(catalog: Catalog, tables: dict[str, Table], version: int) -> Catalog:
    """A catalogue from tables of an older version: later tables are empty, later columns defaulted."""
    if version > CURRENT_VERSION:
        raise ValueError(f"schema version {version} is newer than {CURRENT_VERSION}")
    known = set(tables_at(version))
    kept = {n: conform(t, n) if isinstance(t, DataFrame) else t for n, t in tables.items() if n in known}
    return replace(catalog, tables=empty(catalog.spark).tables | kept)


class Store(Versioned):
    """A folder of snapshots."""

    def __init__(self, spark: SparkSession, root: str, per_file: int = segments.SEGMENT_ROWS):
        super().__init__(spark, root)
        self.per_file = per_file

    def manifest(self, name: str) -> list[Segment]:
        return [Segment(**s) for s in self._json(name)]

    def _table(self, name: str, path: str) -> DataFrame:
        if not path.endswith(".json"):
            return self.spark.read.parquet(f"{self.root}/{path}")
        return segments.read(self.spark, self.manifest(path), SCHEMAS[name], self.root)

    def open(self, version: int | None = None) -> Catalog:
        """The latest (or a given) version; an empty catalogue if nothing was committed."""
        found = self.versions()
        if not found and version in (None, 0):
            return empty(self.spark)
        number = found[-1] if version is None else version
        entry = self.entry(number)
        read = {n: partial(self._table, n, p) for n, p in entry["tables"].items()}
        return replace(migrated(empty(self.spark), read, entry["schema"]), version=number, origin=self.root, changed={})

    def _written(self, catalog: Catalog, name: str, before: str | None) -> str:
        """The manifest of a table in the next version; before: its manifest in the one that the catalogue came from."""
        keys = catalog.changed.get(name, [])
        if before and not keys and keys is not None:
            return before
        folder, key = f"data/{name}", SORT_KEYS[name]
        if before and keys is not None:
            found = segments.rewrite(self.manifest(before), catalog.table(name), key, reduce(DataFrame.unionByName, keys), self.root, folder, self.per_file)
        else:
            found = segments.write(catalog.table(name), key, f"{folder}/{uuid.uuid4().hex}", self.root, self.per_file)
        path = f"{folder}/{uuid.uuid4().hex}.json"
        self._put(path, [s.to_json() for s in found])
        return path

    def commit(self, catalog: Catalog) -> Catalog:
        """Write a new version on top of the one that the catalogue came from."""
        number = catalog.version + 1
        old = self.entry(catalog.version)["tables"] if catalog.origin == self.root and catalog.version else {}
        one = lambda n: self._written(catalog, n, p if (p := old.get(n, "")).endswith(".json") else None)
        with ThreadPoolExecutor(WRITERS) as pool:
            paths = {n: pool.submit(inheritable_thread_target(self.spark)(partial(one, n))) for n in SCHEMAS}
        # Published once every table is written; what failed is raised here.
        self.publish(number, {"schema": CURRENT_VERSION, "tables": {n: path.result() for n, path in paths.items()}})
        return self.open(number)

    def backup_to(self, destination: str, version: int | None = None) -> Catalog:
        """A compact copy of one version in a store of its own."""
        copy = Store(self.spark, destination)
        if copy.versions():
            raise FileExistsError(destination)
        source = self.open(version)
        return copy.commit(replace(source, version=0))


def from_testdata(spark: SparkSession, sf_dir: str, once: bool = False) -> Catalog:
    """The catalogue that the queries run on, derived from documents and labels.

    once: texts are read and hashed once, into a written table, for those who read many of its tables.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5("text").alias("h"), "lang", "source", "n_chars")
    if once:
        docs = written(docs, "hashed")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    i = F.col("doc_id")
    seen = i % 7 != 0
    hexed = F.conv(F.substring(F.md5((F.col("n_chars") % 97).cast("string")), 1, 15), 16, 10).cast("bigint")
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("n_chars") % 61).cast("int")) - 1
    enriched = {
        "phash": hexed.bitwiseXOR(mask),
        "width": F.when(i % 13 == 0, 0).otherwise(i % 50 + 100),
        "height": F.when(i % 13 == 0, 0).otherwise(i % 30 + 80),
        "format": F.col("lang"),
        "date_taken": F.when(i % 3 != 0, (i * 86399) % 200000000 + 1500000000),
        "camera": F.when(i % 5 != 0, F.concat(F.lit("CAM "), (i % 4).cast("string"))),
        "orientation": i % 8 + 1,
    }
    own = docs.select("doc_id", (i + 1).alias("id"), F.concat(F.lit("/lib/"), "source", F.lit("/"), "lang", F.lit("/"), i.cast("string"), F.lit(".txt")).alias("path"), F.col("h").alias("content_hash"), F.col("n_chars").alias("size"), ((i * 37) % 100000 + 1700000000).alias("mtime"), *[F.when(seen, e).alias(n) for n, e in enriched.items()], (i % 10 + 1700100000).alias("indexed_at"), (i % 11 == 0).alias("missing"))
    alias = own.filter(i % 10 == 3).withColumns({"id": F.col("id") + 1000000, "path": F.concat(F.lit("/run/user/1000/doc/"), F.substring("content_hash", 1, 8), F.lit("/"), i.cast("string"), F.lit(".txt")), "missing": F.lit(False)})
    labelled = docs.select("doc_id", "h").join(labels, "doc_id")
    by_hash = lambda rows, **agg: rows.groupBy(F.col("h").alias("content_hash")).agg(*[e.alias(n) for n, e in agg.items()])
    items = lambda number, rows, down: rows.groupBy("h").agg(F.min("doc_id").alias("d")).select(F.lit(number).alias("collection_id"), F.col("h").alias("content_hash"), (-F.col("d") if down else F.col("d")).alias("position"))
    made = [(1, "Trip", "catalog", None, 0), (2, "best", "catalog", None, 0), (3, "Top rated", "smart", '{"rating_min":4}', 0), (4, "beach or sunset", "smart", '{"tags_any":["BEACH","sunset"],"sort":"DateTaken","direction":"Desc"}', 0)]

    def file_tags() -> DataFrame:
        marks = [labelled.filter("quality = 1").select("h", F.lit(1).alias("t")), labelled.filter("toxic = 1").select("h", F.lit(2).alias("t")), docs.filter(i % 4 == 0).select("h", F.lit(3).alias("t")), docs.filter(i % 6 == 0).select("h", F.lit(4).alias("t"))]
        return reduce(DataFrame.union, marks).distinct().select(F.col("h").alias("content_hash"), F.col("t").alias("tag_id"))

    return empty(spark).with_tables(
        files=lambda: own.unionByName(alias),
        tags=lambda: spark.createDataFrame([(1, "Keeper"), (2, "toxic"), (3, "Beach"), (4, "sunset"), (5, "Unused")], SCHEMAS["tags"]),
        file_tags=file_tags,
        ratings=lambda: by_hash(docs.filter(i % 3 != 0), rating=F.max(i % 6)),
        comments=lambda: by_hash(docs.filter(i % 9 == 0), body=F.concat(F.lit("note <"), F.min("doc_id").cast("string"), F.lit("> & more"))),
        orientations=lambda: by_hash(docs.filter(i % 8 == 0), orientation=F.min("doc_id") % 7 + 2),
        crops=lambda: by_hash(docs.filter(i % 8 == 4), x=F.lit(0.25), y=F.lit(0.0), w=F.lit(0.5), h=F.lit(1.0)),
        collections=lambda: spark.createDataFrame(made, SCHEMAS["collections"]),
        collection_items=lambda: items(1, docs.filter(i % 15 == 0), False).union(items(2, docs.filter(i % 10 == 3), True)),
    )
