"""State transitions: each takes a catalogue and returns the next one; committing is the store's.

Values are clamped and trimmed before they are merged. Merges are joins on the key with the new side
first, so a batch of changes costs one pass whatever its size.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ascii_fold, clamp_rating, trimmed
from ..plans.ranking import ranked
from ..sources.catalog import Catalog
from ..sources.schema import ENRICHMENT_COLUMNS, KEYS, SCHEMAS, conform
from .query import Query


class UniqueViolation(ValueError):
    """A change would give two rows one unique value."""


def merged(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """old with new's rows in place of those of equal keys; columns in keep stay as they were.

    Written as a union, so that a filter on the keys reaches the scans of both.
    """
    names = old.columns
    stay = old.join(new.select(*keys), keys, "left_anti")
    if keep:
        had = old.select(*keys, *[F.col(c).alias(f"o_{c}") for c in keep], F.lit(True).alias("o_is"))
        pick = lambda c: F.when(F.col("o_is"), F.col(f"o_{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c)
        new = new.join(had, keys, "left").select(*[pick(c) for c in names])
    return stay.select(*names).unionByName(new.select(*names))


def latest(ops: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last operation of every key: a maximum with partial results, so a hot key is no hot task."""
    last = ops.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in ops.columns if c not in keys]), seq).alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_last.{c}") for c in ops.columns])


def next_ids(old: DataFrame, new: DataFrame, *order: Column) -> DataFrame:
    """new with ids after the largest of old, in order."""
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    return ranked(new, *order, name="_n").withColumn("id", F.col("_n") + top).drop("_n")


def _ordered(catalog: Catalog, hashes: list[str] | DataFrame) -> DataFrame:
    """content_hash and its first place: of a list, or of rows (ord, content_hash)."""
    if not isinstance(hashes, DataFrame):
        hashes = catalog.spark.createDataFrame([(i, h) for i, h in enumerate(hashes)], "ord long, content_hash string")
    return hashes.groupBy("content_hash").agg(F.min("ord").alias("ord"))


def _values(catalog: Catalog, hashes: list[str] | DataFrame) -> DataFrame:
    if isinstance(hashes, DataFrame):
        return hashes.select("content_hash")
    return catalog.spark.createDataFrame([(h,) for h in hashes], "content_hash string")


# --- files ---------------------------------------------------------------------------------


def upsert_files(catalog: Catalog, records: DataFrame) -> Catalog:
    """Insert or overwrite by path; ids stay, everything else (so enrichment too) is replaced."""
    records = conform(records.drop("id"), "files")
    fresh = records.join(catalog.files.select("path"), "path", "left_anti").select(*SCHEMAS["files"].names)
    known = records.join(catalog.files.select("path"), "path", "left_semi").select(*SCHEMAS["files"].names)
    fresh = next_ids(catalog.files, fresh.drop("id"), F.col("path"))
    return catalog.with_rows("files", merged(catalog.files, known, ["path"], keep=["id"]).unionByName(conform(fresh, "files")), records.select("path"))


def relink_paths(catalog: Catalog, moves: DataFrame) -> Catalog:
    """moves: old, new, mtime. The row keeps its id, content and enrichment, and is present again."""
    taken = moves.join(catalog.files.select(F.col("path").alias("new")), "new", "left_semi")
    if not taken.isEmpty():
        raise UniqueViolation("a new path is taken")
    m = moves.select(F.col("old").alias("m_old"), F.col("new").alias("m_new"), F.col("mtime").alias("m_mtime"))
    files, hit = catalog.files, F.col("path") == F.col("m_old")
    moved = files.join(m, hit).withColumns({"path": F.col("m_new"), "mtime": F.col("m_mtime"), "missing": F.lit(False)}).select(*files.columns)
    return catalog.with_rows("files", files.join(m, hit, "left_anti").unionByName(moved), moves.select("old").union(moves.select("new")))


def mark_missing(catalog: Catalog, paths: DataFrame) -> Catalog:
    gone = paths.select("path").distinct().withColumn("gone", F.lit(True))
    files = catalog.files.join(gone, "path", "left").withColumn("missing", F.col("missing") | F.coalesce("gone", F.lit(False)))
    return catalog.with_rows("files", files, paths.select("path"))


def set_enrichment(catalog: Catalog, enriched: DataFrame) -> Catalog:
    """enriched: path and the decode-derived columns; paths that are not indexed are ignored."""
    new = enriched.select(F.col("path").alias("e_path"), *[F.col(c).alias(f"e_{c}") for c in ENRICHMENT_COLUMNS])
    joined = catalog.files.join(new, F.col("path") == F.col("e_path"), "left")
    hit = F.col("e_path").isNotNull()
    return catalog.with_rows("files", joined.withColumns({c: F.when(hit, F.col(f"e_{c}")).otherwise(F.col(c)) for c in ENRICHMENT_COLUMNS}), enriched.select("path"))


# --- tags ----------------------------------------------------------------------------------


def ensure_tags(catalog: Catalog, names: list[str] | DataFrame, trim: bool = True) -> Catalog:
    """Insert the names (a list, or rows of seq and name) that no tag has, ASCII letters of either case
    being equal; the first spelling wins."""
    if not isinstance(names, DataFrame):
        rows = [(i, n.strip() if trim else n) for i, n in enumerate(names)]
        names = catalog.spark.createDataFrame(rows, "seq long, name string")
    new = names.groupBy(ascii_fold("name").alias("fold")).agg(F.min(F.struct("seq", "name")).alias("one")).select("fold", "one.*")
    new = new.join(catalog.tags.select(ascii_fold("name").alias("fold")), "fold", "left_anti")
    added = next_ids(catalog.tags, new.select("seq", "name"), F.col("seq")).select("id", "name")
    return catalog.with_rows("tags", catalog.tags.unionByName(added), added.select("id"))


def _tag_id(catalog: Catalog, name: str) -> DataFrame:
    return catalog.tags.filter(ascii_fold("name") == ascii_fold(F.lit(name))).select(F.col("id").alias("tag_id"))


def apply_tag(catalog: Catalog, name: str, hashes: list[str] | DataFrame, now: int = 0) -> Catalog:
    """Tag contents; what is tagged already stays as it is."""
    catalog = ensure_tags(catalog, [name])
    new = _values(catalog, hashes).distinct().crossJoin(F.broadcast(_tag_id(catalog, name.strip())))
    new = conform(new.withColumn("created_at", F.lit(now)), "file_tags").join(catalog.file_tags, ["content_hash", "tag_id"], "left_anti")
    return catalog.with_rows("file_tags", catalog.file_tags.unionByName(conform(new, "file_tags")), _values(catalog, hashes))


def remove_tag(catalog: Catalog, name: str, hashes: list[str] | DataFrame) -> Catalog:
    gone = _values(catalog, hashes).crossJoin(F.broadcast(_tag_id(catalog, name.strip())))
    return catalog.with_rows("file_tags", catalog.file_tags.join(gone, ["content_hash", "tag_id"], "left_anti"), gone.select("content_hash"))


def change_tags(catalog: Catalog, changes: DataFrame, now: int = 0) -> Catalog:
    """Tag and untag many contents by many names at once.

    changes: seq, content_hash, name (trimmed), applied (false: taken off). The last change of each
    content and name counts; names that were applied become tags. One pass, whatever the vocabulary.
    """
    folded = changes.withColumn("fold", ascii_fold("name"))
    catalog = ensure_tags(catalog, folded.filter("applied").select("seq", "name"))
    ids = catalog.tags.select(ascii_fold("name").alias("fold"), F.col("id").alias("tag_id"))
    last = latest(folded, ["content_hash", "fold"]).join(ids, "fold").select("content_hash", "tag_id", "applied")
    kept = catalog.file_tags.join(last.filter(~F.col("applied")), ["content_hash", "tag_id"], "left_anti")
    new = last.filter("applied").join(catalog.file_tags, ["content_hash", "tag_id"], "left_anti").withColumn("created_at", F.lit(now))
    return catalog.with_rows("file_tags", kept.unionByName(conform(new, "file_tags")), last.select("content_hash"))


def delete_tag(catalog: Catalog, name: str) -> Catalog:
    """The tag (by its untrimmed name) and all its uses go."""
    gone = _tag_id(catalog, name)
    return catalog.with_tables(tags=catalog.tags.join(gone, F.col("id") == F.col("tag_id"), "left_anti"), file_tags=catalog.file_tags.join(gone, "tag_id", "left_anti"))


def rename_tag(catalog: Catalog, old: str, new: str) -> Catalog:
    """Old is matched untrimmed, new is trimmed; a change of case only is allowed."""
    new = new.strip()
    mine = ascii_fold("name") == ascii_fold(F.lit(old))
    if catalog.tags.filter(mine).isEmpty():
        return catalog
    if not catalog.tags.filter((ascii_fold("name") == ascii_fold(F.lit(new))) & ~mine).isEmpty():
        raise UniqueViolation(new)
    return catalog.with_tables(tags=catalog.tags.withColumn("name", F.when(mine, F.lit(new)).otherwise(F.col("name"))))


# --- ratings, comments, edit instructions --------------------------------------------------


def apply_changes(catalog: Catalog, table: str, changes: DataFrame) -> Catalog:
    """changes: seq, content_hash and the table's value columns; a null value clears.

    The last change of each content wins. Ratings are clamped to 0..5, comments trimmed (empty ones
    clear), orientations clamped to 8 (1 and less clear); a crop is cleared unless all parts are set.
    """
    values = {"ratings": ["rating"], "comments": ["body"], "orientations": ["orientation"], "crops": ["x", "y", "w", "h"]}[table]
    if table == "ratings":
        changes = changes.withColumn("rating", F.when(F.col("rating").isNotNull(), clamp_rating("rating")))
    elif table == "comments":
        changes = changes.withColumn("body", F.nullif(trimmed("body"), F.lit("")))
    elif table == "orientations":
        changes = changes.withColumn("orientation", F.when(F.col("orientation") > 1, F.least("orientation", F.lit(8))))
    last = latest(changes, ["content_hash"])
    present = F.lit(True)
    for v in values:
        present = present & F.col(v).isNotNull()
    kept = catalog.table(table).join(last.select("content_hash"), "content_hash", "left_anti")
    return catalog.with_rows(table, kept.unionByName(conform(last.filter(present), table)), last.select("content_hash"))


def _one(catalog: Catalog, table: str, content_hash: str, now: int, **values) -> Catalog:
    types = {f.name: f.dataType.simpleString() for f in SCHEMAS[table]}
    ddl = "seq long, content_hash string, updated_at long, " + ", ".join(f"{k} {types[k]}" for k in values)
    return apply_changes(catalog, table, catalog.spark.createDataFrame([(0, content_hash, now, *values.values())], ddl))


def set_rating(catalog: Catalog, content_hash: str, rating: int | None, now: int = 0) -> Catalog:
    return _one(catalog, "ratings", content_hash, now, rating=rating)


def rate_selection(catalog: Catalog, hashes: list[str] | DataFrame, rating: int, now: int = 0) -> Catalog:
    """Zero clears; items without a content hash are skipped."""
    chosen = _values(catalog, hashes).filter(F.col("content_hash") != "").distinct()
    value = F.lit(rating or None).cast("bigint").alias("rating")
    return apply_changes(catalog, "ratings", chosen.select(F.lit(0).alias("seq"), "content_hash", F.lit(now).cast("bigint").alias("updated_at"), value))


def set_comment(catalog: Catalog, content_hash: str, body: str | None, now: int = 0) -> Catalog:
    return _one(catalog, "comments", content_hash, now, body=body)


def set_orientation(catalog: Catalog, content_hash: str, orientation: int | None, now: int = 0) -> Catalog:
    return _one(catalog, "orientations", content_hash, now, orientation=orientation)


def set_crop(catalog: Catalog, content_hash: str, rect: tuple[float, float, float, float] | None, now: int = 0) -> Catalog:
    x, y, w, h = rect or (None,) * 4
    return _one(catalog, "crops", content_hash, now, x=x, y=y, w=w, h=h)


def rekey(catalog: Catalog, old: str, new: str) -> Catalog:
    """Annotations follow rewritten content; where both have a value the old content's wins.

    Orientation and crop of the old content go: they are part of the new pixels.
    """
    both = catalog.spark.createDataFrame([(old,), (new,)], "content_hash string")
    for table in ("orientations", "crops"):
        catalog = catalog.with_rows(table, catalog.table(table).filter(F.col("content_hash") != old), both)
    if old == new:
        return catalog
    for table in ("ratings", "comments", "file_tags", "collection_items"):
        rows, others = catalog.table(table), [k for k in KEYS[table] if k != "content_hash"]
        moved = rows.filter(F.col("content_hash") == old).withColumn("content_hash", F.lit(new))
        stay = rows.filter(F.col("content_hash") != old)
        # Only rows of the new content can be displaced; of their sizes the optimizer knows best.
        gone = moved.select("content_hash", *others)
        catalog = catalog.with_rows(table, stay.join(gone, ["content_hash", *others], "left_anti").unionByName(moved), both)
    return catalog


# --- collections ---------------------------------------------------------------------------


def _append_collection(catalog: Catalog, name: str, kind: str, query: str | None, now: int) -> Catalog:
    row = catalog.spark.createDataFrame([(name, kind, query, now)], "name string, kind string, query string, created_at long")
    added = conform(next_ids(catalog.collections, row, F.col("name")), "collections")
    return catalog.with_rows("collections", catalog.collections.unionByName(added), added.select("id"))


def create_smart_collection(catalog: Catalog, name: str, query: Query, now: int = 0) -> Catalog:
    return _append_collection(catalog, name, "smart", query.to_json(), now)


def create_catalog(catalog: Catalog, name: str, now: int = 0) -> Catalog:
    return _append_collection(catalog, name, "catalog", None, now)


def rename_collection(catalog: Catalog, collection_id: int, name: str) -> Catalog:
    rows = catalog.collections.withColumn("name", F.when(F.col("id") == collection_id, F.lit(name)).otherwise(F.col("name")))
    return catalog.with_rows("collections", rows, catalog.spark.createDataFrame([(collection_id,)], "id long"))


def delete_collection(catalog: Catalog, collection_id: int) -> Catalog:
    return catalog.with_tables(collections=catalog.collections.filter(F.col("id") != collection_id), collection_items=catalog.collection_items.filter(F.col("collection_id") != collection_id))


def add_to_catalog(catalog: Catalog, collection_id: int, hashes: list[str] | DataFrame) -> Catalog:
    """Append contents (a list, or rows of ord and content_hash) that are not in it yet, in order,
    after its largest position."""
    mine = catalog.collection_items.filter(F.col("collection_id") == collection_id)
    new = _ordered(catalog, hashes).join(mine, "content_hash", "left_anti")
    top = mine.agg(F.coalesce(F.max("position") + 1, F.lit(0)).alias("top")).first()["top"]
    placed = ranked(new, F.col("ord"), F.col("content_hash"), name="n")
    added = placed.select(F.lit(collection_id).alias("collection_id"), "content_hash", (F.col("n") + (top - 1)).alias("position"))
    return catalog.with_rows("collection_items", catalog.collection_items.unionByName(conform(added, "collection_items")), _values(catalog, hashes))


def remove_from_catalog(catalog: Catalog, collection_id: int, hashes: list[str] | DataFrame) -> Catalog:
    """Positions are not closed up; files and annotations stay."""
    gone = _values(catalog, hashes).distinct().withColumn("collection_id", F.lit(collection_id).cast("bigint"))
    return catalog.with_rows("collection_items", catalog.collection_items.join(gone, ["collection_id", "content_hash"], "left_anti"), gone.select("content_hash"))


def set_catalog_order(catalog: Catalog, collection_id: int, hashes: list[str] | DataFrame) -> Catalog:
    """Listed contents (a list without repeats, or rows of ord from 0 and content_hash) get their places
    as positions; the others keep theirs, which may tie with new ones."""
    places = _ordered(catalog, hashes).withColumnRenamed("ord", "new")
    joined = catalog.collection_items.join(places, "content_hash", "left")
    rows = joined.withColumn("position", F.when(F.col("collection_id") == collection_id, F.coalesce("new", "position")).otherwise(F.col("position")))
    return catalog.with_rows("collection_items", rows, places.select("content_hash"))


def set_meta(catalog: Catalog, key: str, value: str) -> Catalog:
    new = catalog.spark.createDataFrame([(key, value)], SCHEMAS["meta"])
    return catalog.with_rows("meta", merged(catalog.meta, new, ["key"]), new.select("key"))


def trash_others(catalog: Catalog, clusters: DataFrame, trashed: DataFrame) -> Catalog:
    """Of clusters' members other than keepers, those that were moved to the trash turn missing."""
    others = clusters.filter("rank > 1").select("path").join(trashed.select("path"), "path", "left_semi")
    return mark_missing(catalog, others)


def trashed_view(view: DataFrame, trashed: DataFrame) -> DataFrame:
    """The view without the selected files that were moved to the trash (path).

    What could not be moved stays, and the index learns of it at the next scan only.
    """
    return view.join(trashed.select("path").distinct(), "path", "left_anti").select(*view.columns)


def save_in_place(catalog: Catalog, record: DataFrame, old_hash: str) -> Catalog:
    """A file was rewritten: its row is replaced, and annotations follow to the new content.

    record: one row of files with the new content_hash. Other files of the old content lose the
    annotations, as these belong to one content.
    """
    new_hash = record.select("content_hash").first()["content_hash"]
    return rekey(upsert_files(catalog, record), old_hash, new_hash)


def delete_or_remove(catalog: Catalog, collection_id: int | None, hashes: list[str] | DataFrame, trashed: DataFrame | None = None) -> Catalog:
    """In a catalog the contents leave it; elsewhere the paths that were moved to the trash turn missing."""
    if collection_id is not None:
        return remove_from_catalog(catalog, collection_id, hashes)
    return mark_missing(catalog, trashed) if trashed is not None else catalog


class EditHistory:
    """Undo and redo of one item's edits: a list with a cursor; a new edit cuts off what was undone."""

    def __init__(self, first=None):
        self.states, self.at = [first], 0

    def commit(self, state) -> None:
        self.states[self.at + 1 :] = [state]
        self.at += 1

    def undo(self):
        self.at = max(0, self.at - 1)
        return self.states[self.at]

    def redo(self):
        self.at = min(len(self.states) - 1, self.at + 1)
        return self.states[self.at]

    def to_json(self) -> str:
        return json.dumps({"states": self.states, "at": self.at})
