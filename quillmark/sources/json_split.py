"""One JSON document in many tasks: the objects of its top-level lists, found by byte ranges.

What a byte means depends on all bytes before it only through two sums: whether the number of quotes is
odd, and how many brackets are open. A first pass counts both for each range, the brackets for either
parity; sums over the ranges (a row for each) give every range its start; a second pass finds the objects
that begin in its range, and reads on where one ends behind it. Memory is a range and the longest object.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared_files import read_range, size_of

RANGE_BYTES = 1 << 22
#: Bytes before a list's bracket in which its key is looked for.
KEY_BYTES = 1 << 12
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$')
QUOTE, BACKSLASH = ord('"'), ord("\\")
ENTRIES = "section string, ord long, entry string"


def _steps(data: np.ndarray) -> np.ndarray:
    """+1 and -1 for opening and closing brackets."""
    return np.isin(data, list(b"{[")).astype(np.int64) - np.isin(data, list(b"}]"))


def _quotes(data: np.ndarray, carried: int) -> np.ndarray:
    """Whether each byte is a quote that no backslash escapes; carried: the backslashes just before the data."""
    at = np.arange(len(data))
    last = np.maximum.accumulate(np.where(data != BACKSLASH, at, -1 - carried)) if len(data) else at
    before = np.r_[-1 - carried, last[:-1]] if len(data) else at
    return (data == QUOTE) & ((at - 1 - before) % 2 == 0)


def _carried(path: str, start: int) -> int:
    """Backslashes just before a place of the file."""
    count = 0
    while start > 0:
        size = min(start, 64)
        part = read_range(path, start - size, size)
        run = len(part) - len(part.rstrip(b"\\"))
        count += run
        if run < size:
            break
        start -= size
    return count


def _outside(data: np.ndarray, carried: int, parity: int) -> np.ndarray:
    return (np.cumsum(_quotes(data, carried)) + parity) % 2 == 0


def summary(data: np.ndarray, carried: int) -> tuple[int, int, int, int, int]:
    """Quotes; brackets opened less those closed, and the least of this on the way, if the data starts outside
    of a string; the same if it starts inside."""
    out = [int(_quotes(data, carried).sum())]
    for parity in (0, 1):
        open_ = np.cumsum(_steps(data) * _outside(data, carried, parity))
        out += [int(open_[-1]), int(open_.min())] if len(data) else [0, 0]
    return tuple(out)


def _lists(data: np.ndarray, outside: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Places where a value of the document itself opens a bracket."""
    return np.flatnonzero(outside & (depth == 2) & (_steps(data) > 0))


def split_range(path: str, start: int, size: int, parity: int, depth: int) -> Iterator[tuple[str, int, str]]:
    """(kind, place, text) of what begins in a range: 'list' with its key (empty for an object), and 'entry'."""
    raw = read_range(path, start, size)
    data = np.frombuffer(raw, np.uint8)
    carried = _carried(path, start)
    outside = _outside(data, carried, parity)
    depths = depth + np.cumsum(_steps(data) * outside)
    for at in _lists(data, outside, depths).tolist():
        place = start + at
        key = _KEY.search(read_range(path, max(0, place - KEY_BYTES), min(place, KEY_BYTES))) if raw[at : at + 1] == b"[" else None
        yield "list", place, key[1].decode() if key else ""
    opened = np.flatnonzero(outside & (depths == 3) & (data == ord("{")))
    closed = np.flatnonzero(outside & (depths == 2) & (data == ord("}")))
    for at in opened.tolist():
        end = np.searchsorted(closed, at)
        if end < len(closed):
            yield "entry", start + at, raw[at : closed[end] + 1].decode()
        else:
            rest = _rest(path, start + len(raw), size, int(outside[-1]) ^ 1, int(depths[-1]))
            yield "entry", start + at, (raw[at:] + rest).decode()


def _rest(path: str, start: int, size: int, parity: int, depth: int) -> bytes:
    """From a place inside of an entry to its end."""
    out = []
    while raw := read_range(path, start, size):
        data = np.frombuffer(raw, np.uint8)
        outside = _outside(data, _carried(path, start), parity)
        depths = depth + np.cumsum(_steps(data) * outside)
        closed = np.flatnonzero(outside & (depths == 2) & (data == ord("}")))
        if len(closed):
            return b"".join([*out, raw[: closed[0] + 1]])
        out.append(raw)
        start, parity, depth = start + len(raw), int(outside[-1]) ^ 1, int(depths[-1])
    raise ValueError("the document ends inside of an object")


def entries(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(section, ord, entry) of every object in a list of the document: the list's key, a place, the object's text.

    The file must be seen by driver and executors alike. Lists and objects of other depths, and other
    values, give no row. Raises ValueError unless quotes and brackets are balanced.
    """
    total = size_of(path)
    starts = spark.range(0, max(total, 1), range_bytes, numPartitions=max(1, -(-total // range_bytes)))

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(s, *summary(np.frombuffer(read_range(path, s, range_bytes), np.uint8), _carried(path, s))) for s in frame["id"].tolist()]
            yield pd.DataFrame(rows, columns=["start", "quotes", "outside", "low_outside", "inside", "low_inside"])

    sums = sorted(starts.mapInPandas(counted, "start long, quotes long, outside long, low_outside long, inside long, low_inside long").collect())
    parities = list(accumulate((r["quotes"] % 2 for r in sums), lambda a, b: a ^ b, initial=0))
    depths = list(accumulate(((r["inside"] if p else r["outside"]) for r, p in zip(sums, parities, strict=False)), initial=0))
    lows = [d + (r["low_inside"] if p else r["low_outside"]) for r, p, d in zip(sums, parities, depths, strict=False)]
    if parities[-1] or depths[-1] or min(lows) < 0:
        raise ValueError(f"{path} is no complete JSON document")
    given = spark.createDataFrame([(i, r["start"], p, d) for i, (r, p, d) in enumerate(zip(sums, parities, depths, strict=False))], "at int, start long, parity int, depth int")

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                held, size = [], 0
                for row in split_range(path, int(r.start), range_bytes, int(r.parity), int(r.depth)):
                    held.append(row)
                    size += len(row[2])
                    if size > RANGE_BYTES:
                        yield pd.DataFrame(held, columns=["kind", "ord", "text"])
                        held, size = [], 0
                yield pd.DataFrame(held, columns=["kind", "ord", "text"])

    from ..plans.components import written

    found = written(given.repartitionById(len(sums), "at").mapInPandas(split, "kind string, ord long, text string"), "json-entries", "kind")
    lists = sorted((r["ord"], r["text"]) for r in found.filter("kind = 'list'").select("ord", "text").collect())
    section = F.lit(None).cast("string")
    for place, key in lists:  # as many as the document has keys
        section = F.when(F.col("ord") > place, F.lit(key or None)).otherwise(section)
    rows = found.filter("kind = 'entry'").select(section.alias("section"), "ord", F.col("text").alias("entry"))
    return rows.filter("section IS NOT NULL")
