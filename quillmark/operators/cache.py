"""Thumbnail caches: what is stored, looked up, touched and evicted."""

from __future__ import annotations

import os
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import BUCKETS, bucket_pixels, cache_key, is_current, is_shareable, thumbnail_path
from ..functions.pixels import add_text_chunks, encode_png, raster, resize
from ..plans.ranking import running_total
from ..sources.shared_files import write_files

#: A thumbnail that was used is marked so at most once in so many seconds.
TOUCH_AFTER = 6 * 3600


def evictions(entries: DataFrame, cap: int) -> DataFrame:
    """Entries (ord, size, last_used) that go, oldest first, until the rest fits the cap.

    An entry goes if what it and all newer entries hold exceeds the cap: the running sum from the
    newest entry on is enough, and it is taken range by range, however many entries one moment has.
    """
    summed = running_total(entries, "size", F.desc("last_used"), F.desc("ord"), name="_held")
    return summed.filter(F.col("_held") > cap).select(*entries.columns)


def private_evictions(listing: DataFrame, budget_mb: int) -> DataFrame:
    """Files of a private cache that go to keep its budget.

    listing: path, size, mtime of everything below the cache; only PNG files that lie directly in a
    bucket's folder count, the least recently used go first, and a budget of 0 empties the cache.
    """
    folders = "|".join(name for _, name in BUCKETS)
    held = listing.filter(F.col("path").rlike(rf"/({folders})/[^/]+\.png$"))
    entries = held.select(F.col("path").alias("ord"), "size", F.col("mtime").alias("last_used"))
    return evictions(entries, budget_mb * 1_000_000).select(F.col("ord").alias("path"), "size", F.col("last_used").alias("mtime"))


def cached_thumbnails(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Where each file's thumbnail is current: shared cache, then private cache, else to be decoded.

    files: uri, path, mtime; listing: cache ('shared' or 'private'), key, thumb_mtime.
    """
    keyed = files.withColumn("key", cache_key("uri"))
    for name in ("shared", "private"):
        side = listing.filter(F.col("cache") == name).groupBy("key").agg(F.max("thumb_mtime").alias(f"{name}_mtime"))
        keyed = keyed.join(side, "key", "left")
    shared = is_shareable("path") & is_current("shared_mtime", "mtime")
    place = F.when(F.coalesce(shared, F.lit(False)), "shared").when(F.coalesce(is_current("private_mtime", "mtime"), F.lit(False)), "private").otherwise("decode")
    return keyed.select(*files.columns, place.alias("found_in"))


def thumbnails(rasters: DataFrame, private: str, shared: str) -> DataFrame:
    """(path, content) of the thumbnail files of rasters (uri, path, mtime, target, data, width, height).

    A thumbnail is a PNG no longer than its bucket's edge that tells its source and the source's time. It
    goes to the private cache, and to the shared one if its source may be seen there; malformed rasters
    give none.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                image = None if r.data is None else raster(bytes(r.data), int(r.width), int(r.height))
                if image is not None:
                    png = encode_png(np.ascontiguousarray(resize(image, int(r.pixels))))
                    out.append((r.place, bool(r.shareable), add_text_chunks(png, [("Thumb::URI", r.uri), ("Thumb::MTime", str(int(r.mtime)))])))
            yield pd.DataFrame(out, columns=["place", "shareable", "content"])

    given = rasters.select("uri", "mtime", "data", "width", "height", bucket_pixels("target").cast("long").alias("pixels"), thumbnail_path("uri", F.col("target")).alias("place"), F.coalesce(is_shareable("path"), F.lit(False)).alias("shareable"))
    made = given.mapInPandas(run, "place string, shareable boolean, content binary")
    roots = F.filter(F.array(F.struct(F.lit(True).alias("to"), F.lit(private).alias("root")), F.struct(F.col("shareable").alias("to"), F.lit(shared).alias("root"))), lambda r: r["to"])
    return made.select("place", "content", F.explode(roots).alias("r")).select(F.concat("r.root", F.lit("/"), "place").alias("path"), "content")


def store_thumbnails(rasters: DataFrame, private: str, shared: str) -> int:
    """Write the thumbnails of rasters; how many files were written. A thumbnail is there as a whole or not at all."""
    return write_files(thumbnails(rasters, private, shared)).filter("written").count()


def read_thumbnails(files: DataFrame, private: str, shared: str, now: int | None = None) -> DataFrame:
    """(uri, found_in, content) of files (uri, path, mtime, target): the shared cache's thumbnail, else the private one's.

    A thumbnail counts if it is not older than its source. With ``now`` the private one's time becomes now
    if it was last used TOUCH_AFTER before: evictions go by it. Null where the source must be decoded. The
    caches are folders that executors see.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                found, content = None, None
                for name, root, allowed in (("shared", shared, r.shareable), ("private", private, True)):
                    path = f"{root}/{r.place}"
                    try:
                        if not allowed or (seen := int(os.stat(path).st_mtime)) < r.mtime:
                            continue
                        with open(path, "rb") as file:
                            content = file.read()
                    except OSError:
                        continue
                    if name == "private" and now is not None and seen < now - TOUCH_AFTER:
                        os.utime(path, (now, now))
                    found = name
                    break
                out.append((r.uri, found, content))
            yield pd.DataFrame(out, columns=["uri", "found_in", "content"])

    given = files.select("uri", "mtime", thumbnail_path("uri", F.col("target")).alias("place"), F.coalesce(is_shareable("path"), F.lit(False)).alias("shareable"))
    return given.mapInPandas(run, "uri string, found_in string, content binary")


class SizedLru:
    """A byte-bounded LRU for driver-side lookups; the newest entry stays even if it is too large."""

    def __init__(self, capacity: int):
        self.capacity, self.held = capacity, 0
        self._entries: OrderedDict = OrderedDict()

    def get(self, key):
        if key not in self._entries:
            return None
        self._entries.move_to_end(key)
        return self._entries[key][0]

    def put(self, key, value, size: int) -> None:
        self.remove(key)
        self._entries[key] = (value, size)
        self.held += size
        self._shrink()

    def remove(self, key) -> None:
        found = self._entries.pop(key, None)
        self.held -= found[1] if found else 0

    def clear(self) -> None:
        self._entries.clear()
        self.held = 0

    def set_capacity(self, capacity: int) -> None:
        self.capacity = capacity
        self._shrink()

    def _shrink(self) -> None:
        while self.held > self.capacity and len(self._entries) > 1:
            _, (_, size) = self._entries.popitem(last=False)
            self.held -= size

    def __len__(self) -> int:
        return len(self._entries)
