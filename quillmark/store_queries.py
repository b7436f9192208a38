"""Registered queries over stores: commits, enrichment and the operation log, each against SQL on the derived tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from .edit_queries import _OPS_STATE, _header_bytes, _ops, op_state
from .operators import annotate
from .plans.components import shared_folder
from .queries import register
from .sources import walk
from .sources.catalog import Catalog, Store
from .sources.schema import SCHEMAS
from .sources.shared_files import write_files
from .streaming import oplog


def fresh_store(c: Catalog) -> tuple[Store, Catalog]:
    """A new store that holds the catalogue."""
    store = Store(c.spark, f"{shared_folder(c.spark)}/stores/{uuid4().hex}")
    return store, store.commit(c)


_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("files", "tags", "file_tags", "ratings", "collections", "collection_items", "comments", "orientations", "crops"))


@register("commit_writes", f", counted AS ({_COUNTS} UNION ALL SELECT 'meta', 0) SELECT name, name IN ('ratings', 'tags', 'file_tags') AS written, n + CASE name WHEN 'tags' THEN 1 WHEN 'file_tags' THEN 1 WHEN 'ratings' THEN (SELECT count(*) FILTER (c = 0) FROM (SELECT count(*) AS c FROM ratings WHERE content_hash = (SELECT min(content_hash) FROM own))) ELSE 0 END AS rows FROM counted", once=True)
def _commit(c):
    """After one rating and one tag: which tables were written at all, and what the manifests count."""
    store, c = fresh_store(c)
    one = c.files.filter("path LIKE '/lib/%'").agg(F.min("content_hash").alias("h")).first()["h"]
    after = store.commit(annotate.apply_tag(annotate.set_rating(c, one, 5), "a new tag", [one]))
    old, new = (store.entry(v)["tables"] for v in (c.version, after.version))
    told = [(t, old[t] != new[t], sum(s.rows for s in store.manifest(new[t]))) for t in SCHEMAS]
    return c.spark.createDataFrame(told, "name string, written boolean, rows long")


_KIND = "regexp_extract(path, '([0-9]+)[.]txt$', 1)::BIGINT"


@register("enrichment_run", f", read AS (SELECT path, width, height, format, width IS NULL AND NOT missing AS waits, {_KIND} AS d FROM files) SELECT path, CASE WHEN NOT waits THEN format WHEN d % 4 = 0 THEN 'PNG' WHEN d % 4 = 1 THEN 'GIF' WHEN d % 4 = 2 THEN 'BMP' END AS format, CASE WHEN NOT waits THEN width WHEN d % 4 = 3 THEN 0 ELSE 1 + d % 200 END AS width, CASE WHEN NOT waits THEN height WHEN d % 4 = 3 THEN 0 ELSE 1 + d % 100 END AS height FROM read", once=True)
def _enrich(c):
    """All files that wait are decoded into a store, a snapshot for each segment's worth of them."""
    store, _ = fresh_store(c)
    number = F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("long")
    oplog.run_enrichment(store, contents=lambda paths: paths.select("path", _header_bytes(number).alias("content")))
    return store.open().files.select("path", "format", "width", "height")


@register("oplog_run", _OPS_STATE, once=True)
def _oplog(c):
    """The log in three parts, each appended to a folder and folded into the store by a streaming query."""
    store, _ = fresh_store(c)
    root = f"{shared_folder(c.spark)}/logs/{uuid4().hex}"
    ops = _ops(c)
    cuts = ops.agg(F.expr("percentile_approx(seq, array(0.33, 0.66))").alias("at")).first()["at"] or [0, 0]
    for part in (F.col("seq") <= cuts[0], (F.col("seq") > cuts[0]) & (F.col("seq") <= cuts[1]), F.col("seq") > cuts[1]):
        oplog.accepted(f"{root}/ops", ops.filter(part))
        oplog.run_oplog(c.spark, f"{root}/ops", store, f"{root}/state").awaitTermination()
    return op_state(store.open())


@register("folder_walk", "SELECT substr(path, 6) || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '.JPG' END AS name, md5(path) AS hash, length(path)::BIGINT AS size FROM own WHERE doc_id % 5 <> 0")
def _walk(c):
    """A folder tree with a file for each path of the catalogue, written by tasks and walked by others."""
    root = f"{shared_folder(c.spark)}/trees/{uuid4().hex}"
    own = c.files.filter("path LIKE '/lib/%'")
    name = F.concat(F.lit(root), F.substring("path", 5, 1000), F.when((F.col("id") - 1) % 5 == 0, "").otherwise(".JPG"))
    write_files(own.select(name.alias("path"), F.encode("path", "UTF-8").alias("content"))).count()
    local = "/" + root.removeprefix("file:").lstrip("/")
    found = walk.with_hashes(walk.walk_images(c.spark, local, listed=200, asked=100), "md5")
    return found.select(F.substring("path", len(local) + 2, 1000).alias("name"), F.col("content_hash").alias("hash"), "size")


@register("fresh_catalog", "SELECT path, content_hash, row_number() OVER (ORDER BY path) AS id FROM files", once=True)
def _fresh(c):
    """All files in a store that was empty: ids follow the paths."""
    store = Store(c.spark, f"{shared_folder(c.spark)}/stores/{uuid4().hex}")
    after = store.commit(annotate.upsert_files(store.open(), c.files))
    return after.files.select("path", "content_hash", "id")


@register("meta_stored", "SELECT 'files' AS key, count(*)::VARCHAR AS value FROM files UNION ALL SELECT 'last', max(path) FROM files UNION ALL SELECT 'versions', '3'", once=True)
def _meta(c):
    """What a library notes of itself, replaced and read again from the store."""
    store, c = fresh_store(c)
    facts = c.files.agg(F.count(F.lit(1)).alias("n"), F.max("path").alias("last")).first()
    c = store.commit(annotate.set_meta(annotate.set_meta(c, "files", "0"), "last", facts["last"] or ""))
    c = store.commit(annotate.set_meta(annotate.set_meta(c, "files", str(facts["n"])), "versions", str(c.version + 1)))
    return c.meta.select("key", "value")
