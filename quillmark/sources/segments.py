"""Tables as sorted segments: files of consecutive keys, of which a change rewrites only those that it touches.

A manifest lists a table's segments in the order of their keys: folder, files, smallest and largest key,
rows. Segment i owns the keys from its smallest up to the next one's; the first owns all smaller keys and
null, the last all larger ones. Files that share a key at their border are one segment.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a file. A table's changed keys cost about a file each, or the table if they touch most of it.
SEGMENT_ROWS = 1 << 16
#: A change that touches more separate runs of segments rewrites the whole table.
MAX_RUNS = 256


@dataclass(frozen=True)
class Segment:
    folder: str
    files: list[str]
    low: str | int | None
    high: str | int | None
    rows: int
    #: Segments of the folder when it was written.
    of: int = 0

    def to_json(self) -> dict:
        return asdict(self)


def touched(segments: list[Segment], keys: DataFrame) -> list[int]:
    """Numbers of the segments that own any of the keys (one column)."""
    if len(segments) < 2:
        return [] if not segments or keys.isEmpty() else [0]
    (name,) = keys.columns
    text = isinstance(segments[-1].low, str)
    lows = np.array(["" if s.low is None else s.low for s in segments[1:]], object) if text else np.array([s.low for s in segments[1:]], np.int64)

    def numbers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for frame in frames:
            own = frame[name].dropna()
            own = own.to_numpy(object) if text else own.to_numpy(np.int64)
            seen.update(np.unique(np.searchsorted(lows, own, side="right")).tolist() if len(own) else [])
            if len(own) < len(frame):
                seen.add(0)
        yield pd.DataFrame({"segment": sorted(seen)})

    # A row for each segment and task at most.
    return sorted(r["segment"] for r in keys.mapInPandas(numbers, "segment int").distinct().collect())


def runs_of(numbers: list[int]) -> list[tuple[int, int]]:
    """Consecutive numbers as (first, last)."""
    out: list[tuple[int, int]] = []
    for n in numbers:
        if out and n == out[-1][1] + 1:
            out[-1] = (out[-1][0], n)
        else:
            out.append((n, n))
    return out


def owned(segments: list[Segment], run: tuple[int, int], key: Column) -> Column:
    """Whether a key belongs to a run of segments."""
    first, last = run
    low = key >= F.lit(segments[first].low) if first else F.lit(True)
    high = key < F.lit(segments[last + 1].low) if last + 1 < len(segments) else F.lit(True)
    return (low & high) | (key.isNull() if first == 0 else F.lit(False))


def write(rows: DataFrame, key: str, folder: str, root: str, per_file: int = SEGMENT_ROWS) -> list[Segment]:
    """rows, sorted by key into files below root/folder; their segments in the order of keys."""
    path = f"{root}/{folder}"
    rows.repartitionByRange(key).sortWithinPartitions(key).write.option("maxRecordsPerFile", per_file).parquet(path)
    spark = rows.sparkSession
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    found = spark.read.schema(rows.schema).parquet(path).select(name.alias("file"), F.col(key).alias("key")).groupBy("file").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("rows")).collect()
    # Null keys sort first; a file of nulls only has neither a smallest nor a largest key.
    out: list[Segment] = []
    for r in sorted(found, key=lambda r: (r["low"] is not None, r["low"], r["file"]) if r["low"] is not None else (False,)):
        if out and (out[-1].high is None or out[-1].high == r["low"]):
            out[-1] = Segment(folder, [*out[-1].files, r["file"]], out[-1].low if out[-1].low is not None else r["low"], r["high"], out[-1].rows + r["rows"])
        else:
            out.append(Segment(folder, [r["file"]], r["low"], r["high"], r["rows"]))
    return [replace(s, of=len(out)) for s in out]


def rewrite(segments: list[Segment], rows: DataFrame, key: str, keys: DataFrame, root: str, folder: str, per_file: int = SEGMENT_ROWS) -> list[Segment]:
    """The segments after a change: rows is the whole new table, keys (one column) all that may have changed.

    Only what the touched segments own is read from rows and written.
    """
    runs = runs_of(touched(segments, keys))
    if not segments or len(runs) > MAX_RUNS or sum(b - a + 1 for a, b in runs) * 2 > len(segments) > 2:
        return write(rows, key, f"{folder}/{uuid.uuid4().hex}", root, per_file)
    out = list(segments)
    for run in reversed(runs):
        new = write(rows.filter(owned(segments, run, F.col(key))), key, f"{folder}/{uuid.uuid4().hex}", root, per_file)
        out[run[0] : run[1] + 1] = new
    return out


def read(spark: SparkSession, segments: list[Segment], schema, root: str) -> DataFrame:
    """The table of the segments; a folder of which all files are live is read as a folder."""
    if not segments:
        return spark.createDataFrame([], schema)
    live = Counter(s.folder for s in segments)
    whole = {s.folder for s in segments if live[s.folder] == s.of}
    files = [f"{root}/{s.folder}/{f}" for s in segments if s.folder not in whole for f in s.files]
    return spark.read.schema(schema).parquet(*[f"{root}/{f}" for f in sorted(whole)], *files)
