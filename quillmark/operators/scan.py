"""Change detection between a scanned folder tree and the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import in_subtree
from ..plans.components import written
from ..plans.ranking import numbered
from ..sources.catalog import Catalog, Store
from ..sources.walk import readable, walk_images, with_hashes
from . import annotate
from .query import paths_under


def classify(catalog: Catalog, scanned: DataFrame) -> DataFrame:
    """scanned (path, size, mtime, ...) with change: New, Unchanged or Modified.

    A file that was missing is Modified even if it looks the same.
    """
    known = catalog.files.select("path", F.col("size").alias("k_size"), F.col("mtime").alias("k_mtime"), F.col("missing").alias("k_missing"))
    same = ~F.col("k_missing") & (F.col("size") == F.col("k_size")) & (F.col("mtime") == F.col("k_mtime"))
    change = F.when(F.col("k_missing").isNull(), "New").when(same, "Unchanged").otherwise("Modified")
    return scanned.join(known, "path", "left").withColumn("change", change).drop("k_size", "k_mtime", "k_missing")


def deleted(catalog: Catalog, scanned: DataFrame, root: str) -> DataFrame:
    """Present paths below the root that the scan has not seen."""
    return paths_under(catalog, root).join(scanned.select("path"), "path", "left_anti")


def changes(catalog: Catalog, scanned: DataFrame, root: str, readable: bool = True) -> DataFrame:
    """path, change, old_path, content_hash, size, mtime: everything that a scan tells.

    scanned: path, size, mtime, content_hash (null: unreadable, such files are skipped unless they are
    unchanged). A new path whose content belongs to a missing file, or to one that this scan finds
    deleted, is Moved: one to one, in order of paths, from anywhere in the index. Paths that
    reappear are no sources of moves. An unreadable root deletes nothing.
    """
    told = classify(catalog, scanned.filter(in_subtree("path", root)))
    told = told.filter((F.col("change") == "Unchanged") | F.col("content_hash").isNotNull())
    gone = deleted(catalog, scanned, root) if readable else catalog.files.select("path").limit(0)
    lost = catalog.files.filter("missing").select("path").unionByName(gone).join(scanned.select("path"), "path", "left_anti")
    sources = catalog.files.join(lost, "path", "left_semi").filter("content_hash != ''").select("content_hash", F.col("path").alias("old_path"))
    new = told.filter("change = 'New'")
    # Only contents of both sides are numbered; empty files may be most of a folder.
    both = lambda rows, other: numbered(rows.join(other.select("content_hash").distinct(), "content_hash", "left_semi"), "content_hash", F.col(rows.columns[-1]))
    sources = written(sources, "move-sources")
    pairs = both(new.select("content_hash", "path"), sources).join(both(sources, new), ["content_hash", "n"]).select("path", "old_path")
    moved = new.join(pairs, "path", "left")
    columns = ["path", "change", "old_path", "content_hash", "size", "mtime"]
    arrived = moved.withColumn("change", F.when(F.col("old_path").isNotNull(), "Moved").otherwise("New")).select(*columns)
    others = told.filter("change != 'New'").withColumn("old_path", F.lit(None).cast("string")).select(*columns)
    nothing = {"old_path": "string", "content_hash": "string", "size": "bigint", "mtime": "bigint"}
    vanished = gone.join(arrived.select(F.col("old_path").alias("path")).filter("path IS NOT NULL"), "path", "left_anti")
    vanished = vanished.select("path", F.lit("Deleted").alias("change"), *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    return arrived.unionByName(others).unionByName(vanished)


def apply_scan(catalog: Catalog, told: DataFrame, now: int = 0) -> Catalog:
    """Deletions first, then moves, then upserts of new and modified files."""
    told = written(told, "scan-told")
    catalog = annotate.mark_missing(catalog, told.filter("change = 'Deleted'"))
    moves = told.filter("change = 'Moved'").select(F.col("old_path").alias("old"), F.col("path").alias("new"), "mtime")
    catalog = annotate.relink_paths(catalog, moves)
    fresh = told.filter("change IN ('New', 'Modified')").select("path", "content_hash", "size", "mtime", F.lit(now).alias("indexed_at"), F.lit(None).cast("long").alias("id"))
    return annotate.upsert_files(catalog, fresh)


def totals(told: DataFrame) -> DataFrame:
    """Files seen, added (new, modified or moved) and flagged missing."""
    return told.agg(F.count(F.when(F.col("change") != "Deleted", 1)).alias("total"), F.count(F.when(F.col("change").isin("New", "Modified", "Moved"), 1)).alias("added"), F.count(F.when(F.col("change") == "Deleted", 1)).alias("flagged"))


def rescan(store: Store, roots: list[str], method: str = "blake3", now: int = 0) -> dict[str, tuple[int, int, int]]:
    """Scan every root and commit a snapshot for each that changed; totals by root.

    Only files that are new or look modified are read. Run by a scheduler, or at start.
    """
    found = {}
    for root in roots:
        catalog = store.open()
        seen = classify(catalog, walk_images(store.spark, root))
        hashed = with_hashes(seen.filter("change != 'Unchanged'"), method).select("path", "size", "mtime", "content_hash")
        same = seen.filter("change = 'Unchanged'").select("path", "size", "mtime", F.lit(None).cast("string").alias("content_hash"))
        told = written(changes(catalog, hashed.unionByName(same), root, readable(root)), "scan")
        row = totals(told).first()
        found[root] = (row["total"], row["added"], row["flagged"])
        if row["added"] or row["flagged"]:
            store.commit(apply_scan(catalog, told, now))
    return found


def reachable(rows: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Rows whose file a fresh listing has; the missing flag is not touched."""
    return rows.join(snapshot.select("path").distinct(), "path", "left_semi").select(*rows.columns)
