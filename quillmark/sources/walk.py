"""Folder trees as tables."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import file_name, is_image_path
from ..functions.hashing import hash_file
from ..plans.components import written

SCANNED = "path string, size long, mtime long"
#: Names that a task lists before it hands the folders that it has not opened to others.
LISTED = 20_000
#: Files that a task asks for their size and time.
ASKED = 2_000


def _listed(folder: str, recursive: bool, most: int) -> Iterator[tuple[str, bool]]:
    """(path, is_folder) of image files below a folder by their names, and of folders that are left to others.

    No file is asked for more than its kind. Links are not followed, what cannot be read is skipped.
    """
    waiting, seen = [folder], 0
    while waiting and seen < most:
        try:
            with os.scandir(waiting.pop()) as found:
                for entry in found:
                    seen += 1
                    try:
                        if entry.is_file(follow_symlinks=False):
                            yield entry.path, False
                        elif recursive and entry.is_dir(follow_symlinks=False):
                            waiting.append(entry.path)
                    except OSError:
                        continue
        except OSError:
            continue
    for left in waiting:
        yield left, True


def walk_images(spark: SparkSession, root: str, recursive: bool = True, listed: int = LISTED, asked: int = ASKED) -> DataFrame:
    """path, size and mtime of the image files below a folder that all executors see.

    The driver opens nothing. Tasks list names; one that has listed many hands the folders that are left to
    the next round, where each is a row that any task may take. The files found are dealt out evenly and
    asked for size and time then, so one flat folder is many tasks too. Hidden files count, links do not;
    files from before 1970 are skipped.
    """

    def names(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for folder in frame["folder"]:
                found = _listed(folder, recursive, listed)
                while part := list(islice(found, 10_000)):
                    yield pd.DataFrame(part, columns=["path", "is_folder"])

    def facts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path in frame["path"]:
                try:
                    info = os.stat(path, follow_symlinks=False)
                except OSError:
                    continue
                if stat.S_ISREG(info.st_mode) and info.st_mtime >= 0:
                    out.append((path, info.st_size, int(info.st_mtime)))
            yield pd.DataFrame(out, columns=["path", "size", "mtime"])

    folders = spark.createDataFrame([(root.rstrip("/") or "/",)], "folder string")
    files, waiting = [], 1
    while waiting:
        found = written(folders.repartition(min(waiting, 1000)).mapInPandas(names, "path string, is_folder boolean"), "walk", "is_folder")
        files.append(found.filter("NOT is_folder").filter(is_image_path("path")).select("path"))
        folders = found.filter("is_folder").select(F.col("path").alias("folder"))
        waiting = folders.count()
    paths = written(reduce(DataFrame.unionByName, files), "walk-files")
    tasks = max(1, -(-paths.count() // asked))
    return paths.repartition(tasks).mapInPandas(facts, SCANNED)


def collect_images(spark: SparkSession, folder: str) -> DataFrame:
    """One level, by lower-case name."""
    rows = walk_images(spark, folder, recursive=False)
    return rows.withColumn("name", file_name("path")).orderBy(F.lower("name"), "path")


def with_hashes(scanned: DataFrame, method: str = "blake3") -> DataFrame:
    """scanned with content_hash of the files' bytes, null for unreadable ones; hashed where they are listed."""

    @F.pandas_udf("string")
    def hashed(paths):
        def one(path):
            try:
                return hash_file(path, method)
            except OSError:
                return None

        return paths.map(one)

    return scanned.withColumn("content_hash", hashed("path"))


def readable(root: str) -> bool:
    """Whether a scan of the root may tell deletions."""
    return os.path.isdir(root) and os.access(root, os.R_OK | os.X_OK)
