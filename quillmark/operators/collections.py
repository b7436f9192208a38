"""Collections: smart ones are stored queries, catalogs are ordered lists of contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ascii_fold, is_portal_document, looks_like_portal
from ..plans.components import written
from ..sources.catalog import Catalog
from ..sources.schema import FILE_COLUMNS
from .query import Query, filtered, hashes_with_any, matches, order_of, present, run


def representatives(catalog: Catalog) -> DataFrame:
    """One present file for each content: outside of a sandbox first, then by path."""
    best = F.min_by(F.struct(*FILE_COLUMNS), F.struct(looks_like_portal("path"), "path"))
    return present(catalog).groupBy(F.col("content_hash").alias("_content")).agg(best.alias("file")).select("file.*")


def durable_paths(files: DataFrame) -> DataFrame:
    """Without the sandbox views of contents that also have a file outside."""
    own = files.filter(~is_portal_document("path"))
    # Only sandbox views are compared, with contents: no window gathers the files of one content.
    views = files.filter(is_portal_document("path"))
    return own.unionByName(views.join(own.select("content_hash").distinct(), "content_hash", "left_anti").select(*files.columns))


def catalog_files(catalog: Catalog, collection_id: int) -> DataFrame:
    """A catalog's files with their positions, one for each content, in order."""
    items = catalog.collection_items.filter(F.col("collection_id") == collection_id).select("content_hash", "position")
    # The few items narrow the files before one is chosen for each content.
    held = catalog.with_tables(files=catalog.files.join(items, "content_hash", "left_semi"))
    return representatives(held).join(items, "content_hash").select(*FILE_COLUMNS, "position").orderBy("position", "content_hash")


def stored_query(catalog: Catalog, collection_id: int) -> Query | None:
    """The predicate of a smart collection; None for catalogs."""
    row = catalog.collections.filter(F.col("id") == collection_id).select("kind", "query").first()
    if row is None:
        raise LookupError(f"no collection {collection_id}")
    return Query.from_json(row["query"] or "{}") if row["kind"] == "smart" else None


def collection_files(catalog: Catalog, collection_id: int) -> DataFrame:
    """Membership as of now: smart collections are recomputed at every read."""
    query = stored_query(catalog, collection_id)
    if query is not None:
        return run(catalog, query)
    return catalog_files(catalog, collection_id).select(*FILE_COLUMNS)


def _smart_counts(catalog: Catalog, smart: list[tuple[int, Query]]) -> DataFrame:
    """(collection_id, n) of smart collections: one scan of the files, a conditional count for each."""
    names = sorted({n for _, q in smart for n in [*q.tags_all, *q.tags_any]})
    rows = present(catalog)
    if names:
        # At most as many tags for a content as the predicates name.
        tags = hashes_with_any(catalog, names).groupBy("content_hash").agg(F.collect_set("tag").alias("_tags"))
        rows = rows.join(tags, "content_hash", "left")
    if any(q.rating_min is not None for _, q in smart):
        rows = rows.join(catalog.ratings.select("content_hash", F.col("rating").alias("_rating")), "content_hash", "left")
    counted = rows.agg(*[F.count(F.when(matches(q), 1)).alias(f"c{i}") for i, (_, q) in enumerate(smart)])

    def shown(i: int, query: Query):
        n = F.col(f"c{i}")
        return F.least(n, F.lit(query.limit)) if query.limit is not None and query.limit >= 0 else n

    each = F.array(*[F.struct(F.lit(number).cast("bigint").alias("collection_id"), shown(i, q).cast("bigint").alias("n")) for i, (number, q) in enumerate(smart)])
    return counted.select(F.inline(each))


def list_collections(catalog: Catalog) -> DataFrame:
    """id, name, kind and number of files (smart) or of contents with a file (catalogs)."""
    listed = catalog.files.filter(~F.col("missing")).select("content_hash").distinct()
    counts = catalog.collection_items.join(listed, "content_hash", "left_semi").groupBy("collection_id").agg(F.count(F.lit(1)).alias("n"))
    # Predicates are a listed few, read on the driver; one pass over the files counts all of them.
    smart = [(r["id"], Query.from_json(r["query"] or "{}")) for r in catalog.collections.filter("kind = 'smart'").select("id", "query").collect()]
    if smart:
        counts = counts.unionByName(_smart_counts(catalog, smart))
    joined = catalog.collections.join(counts, F.col("id") == F.col("collection_id"), "left")
    return joined.select("id", "name", "kind", F.coalesce("n", F.lit(0)).alias("n")).orderBy(ascii_fold("name"), "name", "id")


def _opened(catalog: Catalog, rows: DataFrame, snapshot: DataFrame | None) -> DataFrame:
    """Rows by durable path, those that a fresh listing still has (if one is given), with ratings."""
    rows = durable_paths(rows)
    if snapshot is not None:
        rows = rows.join(snapshot.select("path").distinct(), "path", "left_semi")
    return rows.join(catalog.ratings.select("content_hash", "rating"), "content_hash", "left").withColumn("rating", F.coalesce("rating", F.lit(0)).cast("bigint"))


def tag_browse(catalog: Catalog, tag: str, snapshot: DataFrame | None = None) -> DataFrame:
    """Files with a tag, by durable path, with their ratings; snapshot (path) tells which can be reached."""
    rows = filtered(catalog, Query(tags_any=[tag]))
    return _opened(catalog, rows, snapshot).select("path", "content_hash", "rating").orderBy("path")


def open_collection(catalog: Catalog, collection_id: int, snapshot: DataFrame | None = None) -> DataFrame:
    """A collection's files in its order, durable and reachable ones only, with their ratings."""
    query = stored_query(catalog, collection_id)
    if query is None:
        return _opened(catalog, catalog_files(catalog, collection_id), snapshot).orderBy("position", "content_hash").select("path", "content_hash", "rating")
    rows = filtered(catalog, query)
    if query.limit is not None and query.limit >= 0:
        rows = rows.orderBy(*order_of(query)).limit(query.limit)
    return _opened(catalog, rows, snapshot).orderBy(*order_of(query)).select("path", "content_hash", "rating")


def resolve_drop(catalog: Catalog, dropped: DataFrame) -> DataFrame:
    """Contents of dropped files, once each, in drop order.

    dropped: ord, path and hash (of the bytes, null if unreadable). A path that is indexed gives its
    content; else the hash does if a present file has it. outcome: by_path, by_hash, unhashable, unknown.
    """
    known = catalog.files.select("path", F.col("content_hash").alias("indexed"))
    there = catalog.files.filter(~F.col("missing")).select(F.col("content_hash").alias("hash")).distinct().withColumn("there", F.lit(True))
    found = dropped.join(known, "path", "left").join(there, "hash", "left")
    by_path = F.col("indexed").isNotNull() & (F.col("indexed") != "")
    outcome = F.when(by_path, "by_path").when(F.col("hash").isNull(), "unhashable").when(F.col("there"), "by_hash").otherwise("unknown")
    content = F.when(by_path, F.col("indexed")).when(F.col("there"), F.col("hash"))
    told = found.select("ord", "path", content.alias("content_hash"), outcome.alias("outcome"))
    # What has no content is a group of its own each, not one large group.
    group = F.coalesce(F.col("content_hash"), F.concat(F.lit("none "), F.col("ord").cast("string")))
    told = written(told.withColumn("_group", group), "dropped")
    # Partial minima: a content that is dropped many times is one row of them.
    first = told.groupBy("_group").agg(F.min("ord").alias("_first"))
    kept = F.col("content_hash").isNotNull() & (F.col("ord") == F.col("_first"))
    return told.join(first, "_group").withColumn("kept", kept).drop("_group", "_first")


def drop_totals(resolved: DataFrame) -> DataFrame:
    """How many dropped files went each way, and how many contents are kept."""
    counts = [F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in ("by_path", "by_hash", "unhashable", "unknown")]
    return resolved.agg(*counts, F.count(F.when(F.col("kept"), 1)).alias("kept"))
