"""What the large-corpus operators share: the shared folder, hashing, bounded batches."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.components import written

#: Bytes of text that a Python step holds at once (a single longer text is held alone).
BLOCK_BYTES = 1 << 21


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write df to the folder that driver and executors share, and read it again.

    Cuts the lineage so that a lost executor costs only its own tasks, and gives later joins
    plain scans below their exchanges, which adaptive execution can split where a key is hot.
    """
    return written(df, name, *by)


#: Rows of an Arrow batch: long texts make a batch of Spark's default size too large.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of at most BATCH_ROWS rows (a setting of the session).

    Python workers live on between tasks: what a task has freed goes back to the system at its end.
    """

    def released(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    conf = df.sparkSession.conf
    rows = int(conf.get(_BATCH, "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        conf.set(_BATCH, str(BATCH_ROWS))
    return df.mapInArrow(released, schema)


def blocks(rows: Iterable[tuple], size_of, limit: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """Consecutive rows in lists of about limit bytes."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size_of(row)
        if total >= limit:
            yield held
            held, total = [], 0
    if held:
        yield held


def rows_of(batches: Iterable[pa.RecordBatch], *columns: str, step: int = 512) -> Iterator[tuple]:
    """Rows of Arrow batches, converted a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield from zip(*(part.column(c).to_pylist() for c in columns), strict=True)


def internal(df: DataFrame, *used: str) -> tuple[DataFrame, dict[str, str]]:
    """df with every column but those used under an internal name, and these names by the old ones.

    Helper columns of an operator cannot clash with what the caller's table holds besides.
    """
    names = {c: c if c in used else f"_c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


#: 64-bit words of the bitmap that marks keys: its size is fixed, whatever the input.
BITMAP_WORDS = 1 << 18


def marked(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """rows with ``maybe``: false only if the BIGINT key is not among wanted's (a column of that name).

    Spares rows without a partner the shuffle of a join. The broadcast side has at most BITMAP_WORDS
    rows; with more keys than bits it merely marks more rows.
    """
    word = F.pmod(F.col(key), F.lit(BITMAP_WORDS)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(key), F.lit(64)).cast("int"))
    bitmap = wanted.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    found = rows.join(F.broadcast(bitmap), word == F.col("_word"), "left")
    return found.withColumn("maybe", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_bits")


# --- 64-bit hashing in numpy -------------------------------------------------------------

#: Fixed values of the splitmix64 finaliser.
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
GOLDEN = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser, elementwise, on a copy."""
    x = x.astype(np.uint64) + np.uint64(GOLDEN * (seed + 1) % (1 << 64))
    x ^= x >> np.uint64(30)
    x *= MIX[0]
    x ^= x >> np.uint64(27)
    x *= MIX[1]
    x ^= x >> np.uint64(31)
    return x


class SpanHasher:
    """Rolling polynomial hashes (modulo 2**64) of any span of a byte buffer.

    prefix[i] sums table[byte j] * base**j over j < i; a span's hash is its difference times
    base**-start, so equal strings hash equally wherever they stand.
    """

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(7919 * seed)
        table = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        base = int(rng.integers(1, 1 << 62)) * 4 + 3
        up, self.down = self._grown(base, len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[: len(data)], out=self.prefix[1:])

    @classmethod
    def _grown(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers.get(base)
        if have is None or len(have[0]) < n:
            size = max(n, 1 << 16)
            inverse = pow(base, -1, 1 << 64)
            have = tuple(cls._raised(b, size) for b in (base, inverse))
            if size <= 1 << 23:
                cls._powers[base] = have
        return have

    @staticmethod
    def _raised(base: int, n: int) -> np.ndarray:
        powers = np.full(n, base & (2**64 - 1), np.uint64)
        powers[0] = 1
        return np.cumprod(powers, dtype=np.uint64)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.down[start]
