"""Streams into the catalogue: an operation log folded into snapshots, and arriving files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import clamp_rating, is_image_path
from ..operators import annotate
from ..operators.query import paths_needing_enrichment
from ..plans.components import written
from ..sources.catalog import Catalog, CommitConflict, Store
from ..sources.images import enriched, with_contents

#: seq orders operations; op: rate, comment, orient, tag, untag; value: null or '' clears.
OPS = "seq long, op string, content_hash string, value string"


#: Columns of Spark's binaryFile source.
BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def latest_per_key(ops: DataFrame, keys: list[str]) -> DataFrame:
    """Later operations on a key replace earlier ones."""
    return annotate.latest(ops, keys)


def apply_ops(catalog: Catalog, ops: DataFrame) -> Catalog:
    """Fold a batch of operations into a catalogue.

    Operations on one content's rating, comment or orientation are folded to the last; tags are folded
    for each (content, tag). Folding is by key, so the order of rows does not matter, only seq does.
    """
    number = F.expr("try_cast(value AS BIGINT)")
    for op, table, column, value in (("rate", "ratings", "rating", F.when(number > 0, clamp_rating(number))), ("comment", "comments", "body", F.col("value")), ("orient", "orientations", "orientation", number)):
        catalog = annotate.apply_changes(catalog, table, ops.filter(F.col("op") == op).select("seq", "content_hash", value.alias(column), F.col("seq").alias("updated_at")))
    tags = ops.filter("op IN ('tag', 'untag')").select("seq", "content_hash", annotate.trimmed("value").alias("name"), (F.col("op") == "tag").alias("applied"))
    return annotate.change_tags(catalog, tags)


def accepted(folder: str, ops: DataFrame) -> int:
    """Append operations to the folder that run_oplog reads; how many were taken.

    Returning means that the operations are stored and will be applied once, not that they have been.
    """
    before = ops.count()
    ops.write.mode("append").parquet(folder)
    return before


def run_enrichment(store: Store, size: int | None = None, contents: Callable[[DataFrame], DataFrame] = with_contents) -> int:
    """Decode files that wait for it, up to ``size`` (a segment's rows) of them in a snapshot, until none is left.

    Returns how many were done. What cannot be decoded is marked with 0 x 0 and does not come back. Files
    are taken in the order of their paths, so a snapshot rewrites the segments of neighbouring files only,
    and each segment about once. contents gives (path, content) of rows with a path.
    """
    done = 0
    while True:
        catalog = store.open()
        waiting = paths_needing_enrichment(catalog).select("path")
        names = written(waiting.orderBy("path").limit(size or store.per_file), "enrichment")
        n = names.count()
        if not n:
            return done
        # Written first: the commit asks for keys and rows, and each file is decoded once.
        store.commit(annotate.set_enrichment(catalog, written(enriched(contents(names)), "enriched")))
        done += n


def run_oplog(spark: SparkSession, source: str, store: Store, checkpoint: str, files: int = 1000) -> StreamingQuery:
    """Apply operations that arrive as Parquet files, a snapshot for each micro-batch of at most ``files``.

    A batch that was committed before a failure is recognised by its number in meta and skipped:
    every operation takes effect once.
    """

    def batch(ops: DataFrame, number: int) -> None:
        while True:
            catalog = store.open()
            if int(catalog.meta_value("oplog_batch") or -1) >= number:
                return
            ops = ops.persist()
            try:
                store.commit(annotate.set_meta(apply_ops(catalog, ops), "oplog_batch", str(number)))
                return
            except CommitConflict:
                continue  # another writer was first: fold onto its version
            finally:
                ops.unpersist()

    stream = spark.readStream.schema(OPS).option("maxFilesPerTrigger", files).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arriving_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of new image files (path, size, mtime, content_hash); deletions need a scan."""
    found = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", True).load(folder)
    path = F.regexp_replace("path", "^file:/*", "/")
    return found.select(path.alias("path"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"), F.sha2("content", 256).alias("content_hash")).filter(is_image_path("path"))
