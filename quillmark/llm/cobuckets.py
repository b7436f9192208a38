"""Two tables of one key in buckets: a numbered file for each table and bucket, sorted, ready for joins without shuffles.

1. Starting files. Each table is dealt into numbered files by a rule of its own.
2. A Bloom filter of the first table's keys, SLOTS bits whatever the table, is built by ``treeAggregate``
   from the bitmaps of its partitions. Rows of the second table whose key it does not know are orphans,
   told where they stand. The keys that it knows are verified exactly: their counts meet the first
   table's counts in a join on bucket and key, which also tells how many rows a bucket's join has. The
   known keys without a partner, a small share as long as the filter is sparse, mark further orphans.
   However full the filter is, the result is exact; it only leaves more to the join.
3. Rows go to their buckets by number (``repartitionById``), are sorted there and streamed to one file for
   each number. Files above HOT times the mean are cut into sorted ranges, which tasks of their own sort
   and write; one more task then streams these ranges, in order, into the file that the contract wants
   whole. No task holds more than a batch of rows, or sorts more than a range.
4. Starting files with exactly a final file's rows stay; all others are deleted when the final ones are
   there. Files are written under a temporary name and renamed when complete: a task that is run again
   leaves one whole file.

What reaches the driver are a row for each file, at most BUCKETS + 2 of a table, and a bitmap of fixed size.

Defined results: a null key of either table has bucket BUCKETS + 1 and joins nothing; a key that the
first table lacks has bucket BUCKETS in the second. Repeated rows stay, and repeated keys of the first
table multiply the join's rows. Equal rows, which no order tells apart, are cut into ranges by where they
stood. An empty table has no file. All columns of both tables are written, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.components import shared_folder
from .common import documents, map_arrow, materialize, mix64

BUCKETS = 600
#: Bits of the Bloom filter, a power of two, and how many each key sets.
SLOTS, PROBES = 1 << 23, 4
#: Bitmaps that treeAggregate merges in a step: about as many reach the driver, whatever the partitions.
FAN_IN = 4
#: Files with so many times the rows of a mean file, and at least HOT_ROWS, are sorted in ranges; so is
#: any file of more than RANGE_ROWS.
HOT, HOT_ROWS, RANGE_ROWS = 4, 20_000, 4_000_000
#: Rows of a row group.
GROUP_ROWS = 1 << 16


def bucket(key: Column) -> Column:
    """The bucket of a key, if the first table has it."""
    return F.coalesce(F.crc32(F.concat(F.lit("s"), key.cast("string")).cast("binary")) % BUCKETS, F.lit(BUCKETS + 1)).cast("int")


def sales_file(key: Column) -> Column:
    """The number of a sale's starting file."""
    own = bucket(key)
    return F.when(own % 4 == 1, own - 1).otherwise(own)


def lines_file(item: Column) -> Column:
    """The number of a line's starting file."""
    return F.coalesce(F.crc32(item.cast("string").cast("binary")) % BUCKETS, F.lit(0)).cast("int")


# --- Bloom filter ----------------------------------------------------------------------------------


def _slots(keys: np.ndarray) -> np.ndarray:
    """PROBES x keys places in the filter."""
    first, second = mix64(keys, 3), mix64(keys, 4) | np.uint64(1)
    return (first[None, :] + np.arange(PROBES, dtype=np.uint64)[:, None] * second[None, :]) & np.uint64(SLOTS - 1)


def _keys(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _bits(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8)


def bloom(table: DataFrame, key: str) -> np.ndarray:
    """The filter's bits as bytes: one bitmap for each partition, merged by treeAggregate."""

    def bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(SLOTS, bool)
        for batch in batches:
            bits[_slots(_keys(batch.column(0))).ravel()] = True
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    def merged(a: bytes | None, b: bytes | None) -> bytes | None:
        return a or b if a is None or b is None else (_bits(a) | _bits(b)).tobytes()

    maps = map_arrow(table.select(F.col(key).cast("long").alias("key")), bitmap, "bits binary").rdd.map(lambda r: bytes(r["bits"]))
    parts = maps.getNumPartitions()
    found = maps.treeAggregate(None, merged, merged, max(2, math.ceil(math.log(parts, FAN_IN)))) if parts else None
    return np.zeros(SLOTS // 8, np.uint8) if found is None else _bits(found)


def might_hold(spark: SparkSession, bits: np.ndarray, key: Column) -> Column:
    """Whether the filter knows a key; false for null. The filter is broadcast: its size is fixed."""
    sent = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def known(keys: pd.Series) -> pd.Series:
        bits = sent.value
        out = np.zeros(len(keys), bool)
        there = keys.notna().to_numpy()
        slots = _slots(keys[there].astype("int64").to_numpy().view(np.uint64))
        out[there] = ((bits[slots >> np.uint64(3)] >> (np.uint64(7) - (slots & np.uint64(7))).astype(np.uint8)) & 1).all(axis=0)
        return pd.Series(out)

    return known(key.cast("long"))


def verified(table: DataFrame, key: str, other: DataFrame, other_key: str, maybe: str) -> tuple[DataFrame, dict[int, int]]:
    """Of the keys in rows of other that the filter knows (column ``maybe``): those that table lacks, and each bucket's joined rows.

    Both sides are counts by bucket and key, so a hot key is one row of either.
    """
    counted = lambda df, key, name: df.filter(key.isNotNull()).groupBy(bucket(key).alias("bucket"), key.alias("_key")).agg(F.count(F.lit(1)).alias(name))
    met = materialize(counted(other.filter(maybe), F.col(other_key), "many").join(counted(table, F.col(key), "own"), ["bucket", "_key"], "left"), "bucket-keys")
    joined = met.filter("own IS NOT NULL").groupBy("bucket").agg(F.sum(F.col("many") * F.col("own")).alias("n")).collect()
    return met.filter("own IS NULL").select("_key"), {r["bucket"]: r["n"] for r in joined}


# --- numbered files --------------------------------------------------------------------------------


def _file_system(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder that driver and executors share, and the folder's path in it."""
    return pa.fs.FileSystem.from_uri(folder)


class _Writer:
    """Streams rows to one Parquet file, and digests a column's values as comma-joined decimals."""

    def __init__(self, folder: str, name: str, schema: pa.Schema, key: str):
        self.fs, base = _file_system(folder)
        self.fs.create_dir(base, recursive=True)
        self.path, self.name = f"{base}/{name}", name
        self.temporary = f"{base}/_{name}.{uuid.uuid4().hex}"
        self.writer = pq.ParquetWriter(self.temporary, schema, filesystem=self.fs)
        self.schema, self.key, self.rows, self.digest = schema, key, 0, hashlib.sha256()
        self.held: list[pa.RecordBatch] = []

    def write(self, batch: pa.RecordBatch) -> None:
        ids = ",".join("" if v is None else str(v) for v in batch.column(self.key).to_pylist())
        self.digest.update(((("," if self.rows else "") + ids)).encode())
        self.rows += batch.num_rows
        self.held.append(batch)
        if sum(b.num_rows for b in self.held) >= GROUP_ROWS:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            self.writer.write_table(pa.Table.from_batches(self.held, self.schema))
            self.held = []

    def close(self) -> tuple[str, int, str]:
        self._flush()
        self.writer.close()
        self.fs.move(self.temporary, self.path)
        return self.name, self.rows, self.digest.hexdigest()

    def abort(self) -> None:
        self.writer.close()
        self.fs.delete_file(self.temporary)


_FILES = "number int, name string, n_rows long, ids_sha256 string"


def _streamed(batches: Iterator[pa.RecordBatch], folder: str, key: str, name_of: Callable[[int], str]) -> Iterator[pa.RecordBatch]:
    """Rows that come sorted by their first column, a number, to a file for each number."""
    number, out, done = None, None, []
    try:
        for batch in batches:
            numbers = batch.column(0).to_numpy(zero_copy_only=False)
            rows = pa.RecordBatch.from_arrays(batch.columns[1:], schema=pa.schema(list(batch.schema)[1:]))
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    if numbers[a] != number:
                        if out is not None:
                            done.append((number, *out.close()))
                        number = int(numbers[a])
                        out = _Writer(folder, name_of(number), rows.schema, key)
                    out.write(rows.slice(a, b - a))
        if out is not None:
            done.append((number, *out.close()))
    except BaseException:
        if out is not None:
            out.abort()
        raise
    columns = list(zip(*done, strict=True)) if done else [[]] * 4
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.string())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["number", "name", "n_rows", "ids_sha256"])


def _file_name(number: int) -> str:
    return f"{number:05d}.parquet"


def _ranged(batches: Iterator[pa.RecordBatch], folder: str, key: str) -> Iterator[pa.RecordBatch]:
    """One sorted range of hot numbers (_number, columns, _range) to a file for each number and range."""
    first = next((b for b in batches if b.num_rows), None)
    if first is None:
        return
    at = first.column("_range")[0].as_py()
    yield from _streamed((b.drop_columns(["_range"]) for b in itertools.chain([first], batches)), folder, key, lambda n: f"{n:05d}-{at:08d}.parquet")


def _joined(frames: Iterator[pd.DataFrame], parts: str, folder: str, key: str) -> Iterator[pd.DataFrame]:
    """The ranges of a number, in their order, to its file; a batch at a time."""
    fs, base = _file_system(parts)
    for frame in frames:
        for number, files in zip(frame["number"].tolist(), frame["files"], strict=True):
            out = None
            for file in files:
                with fs.open_input_file(f"{base}/{file}") as raw, pq.ParquetFile(raw) as source:
                    for batch in source.iter_batches(GROUP_ROWS // 4):
                        out = out or _Writer(folder, _file_name(number), batch.schema, key)
                        out.write(batch)
            yield pd.DataFrame([(number, *out.close())], columns=["number", "name", "n_rows", "ids_sha256"])


def write_numbered(rows: DataFrame, columns: list[str], key: str, folder: str, counts: dict[int, int]) -> dict[int, dict]:
    """Rows (_number, c0, c1, ..) to a file for each number, with ``columns`` as the names of c0, c1 and so on.

    Files are sorted by key, then the columns from left to right, nulls first. counts: the rows of each
    number, of which there are few. Returns path, n_rows and ids_sha256 (of the key column, in file order)
    by number.
    """
    if not counts:
        return {}
    spark = rows.sparkSession
    inner = [f"c{i}" for i in range(len(columns))]
    first = inner[columns.index(key)]
    order = ["_number", first, *[c for c in inner if c != first]]
    limit = min(RANGE_ROWS, max(HOT_ROWS, HOT * -(-sum(counts.values()) // len(counts))))
    hot = sorted(n for n, many in counts.items() if many > limit)
    tasks = max(1, min(len(counts), int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def named(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.rename_columns(["_number", *columns, *batch.schema.names[1 + len(columns) :]])

    calm = rows.filter(~F.col("_number").isin(hot)) if hot else rows
    # Neighbouring numbers share a task, whatever numbers a table has.
    deal = F.floor(F.col("_number") * tasks / (max(counts) + 1)).cast("int")
    dealt = calm.repartitionById(tasks, deal).sortWithinPartitions(*order)
    done = map_arrow(dealt, lambda batches: _streamed(map(named, batches), folder, key, _file_name), _FILES).collect()
    if hot:
        parts = f"{folder}/_ranges"
        apart = rows.filter(F.col("_number").isin(hot)).withColumn("_copy", F.monotonically_increasing_id())
        ranges = max(tasks, 2 * sum(counts[n] for n in hot) // limit)
        laid = apart.repartitionByRange(ranges, *order, "_copy").sortWithinPartitions(*order).drop("_copy").withColumn("_range", F.spark_partition_id())
        pieces = map_arrow(laid, lambda batches: _ranged(map(named, batches), parts, key), _FILES).collect()
        jobs = [(i, n, sorted(r["name"] for r in pieces if r["number"] == n)) for i, n in enumerate(hot)]
        each = spark.createDataFrame(jobs, "at int, number int, files array<string>").repartitionById(len(hot), "at")
        done += each.mapInPandas(lambda frames: _joined(frames, parts, folder, key), _FILES).collect()
        delete(spark, [parts])
    return {r["number"]: {"path": f"{folder}/{r['name']}", "n_rows": r["n_rows"], "ids_sha256": r["ids_sha256"]} for r in done}


def delete(spark: SparkSession, paths: list[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


# --- the pair of tables ----------------------------------------------------------------------------


class Numbered:
    """A table in a folder of numbered files, with names of its own for the table's columns."""

    def __init__(self, name: str, table: DataFrame, key: str, start: Column, folder: str):
        self.name, self.columns, self.key = name, table.columns, key
        self.spark, self.folder = table.sparkSession, folder
        self.inner = f"c{self.columns.index(key)}"
        rows = self._inside(table, start)
        counts = {r["_number"]: r["n"] for r in rows.groupBy("_number").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.files = write_numbered(rows, self.columns, key, f"{folder}/{name}/start", counts)
        self.schema, self.start = table.schema, start

    def _inside(self, table: DataFrame, number: Column) -> DataFrame:
        return table.select(number.cast("int").alias("_number"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(self.columns)])

    def rows(self) -> DataFrame:
        """(_number, c0, c1, ..) of the starting files."""
        if not self.files:
            return self._inside(self.spark.createDataFrame([], self.schema), self.start)
        return self._inside(self.spark.read.schema(self.schema).parquet(f"{self.folder}/{self.name}/start"), self.start)

    def rewrite(self, rows: DataFrame, joined: dict[int, int]) -> list[tuple]:
        """Starting files to final ones, from rows with their bucket (_to); a row for each final file."""
        pairs = materialize(rows.groupBy("_number", "_to").agg(F.count(F.lit(1)).alias("n")), "bucket-pairs")
        targets = pairs.groupBy("_number").agg(F.count(F.lit(1)).alias("targets"))
        parts = F.transform(F.sort_array(F.collect_list(F.struct("_number", "n"))), lambda p: F.concat(p["_number"].cast("string"), F.lit(":"), p["n"].cast("string")))
        told = pairs.join(targets, "_number").groupBy("_to").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sources"), F.min("_number").alias("source"), F.max("targets").alias("targets"), F.sha2(F.array_join(parts, ","), 256).alias("lineage")).collect()
        stay = {r["_to"]: r["source"] for r in told if r["sources"] == 1 and r["targets"] == 1}
        moved = rows.filter(~F.col("_to").isin([*stay])) if stay else rows
        inner = [f"c{i}" for i in range(len(self.columns))]
        counts = {r["_to"]: r["n"] for r in told if r["_to"] not in stay}
        final = write_numbered(moved.select(F.col("_to").alias("_number"), *inner), self.columns, self.key, f"{self.folder}/{self.name}/final", counts)
        final |= {b: self.files[s] for b, s in stay.items()}
        gone = [f["path"] for s, f in self.files.items() if s not in stay.values()]
        delete(self.spark, gone if stay else [f"{self.folder}/{self.name}/start"])
        return [(self.name, r["_to"], _shown(final[r["_to"]]["path"]), final[r["_to"]]["n_rows"], ",".join(self.columns), final[r["_to"]]["ids_sha256"], r["lineage"], joined.get(r["_to"], 0), r["_to"] not in stay) for r in told]


def _shown(path: str) -> str:
    """A local file's plain path; any other with its scheme."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


FILES = "table_name string, bucket long, path string, n_rows long, columns string, ids_sha256 string, lineage_sha256 string, n_joined long, rewritten boolean"


def cobucketed(first: Numbered, second: Numbered) -> DataFrame:
    """Both tables from their starting files to one file for each bucket; a row for each final file."""
    spark = first.spark
    own = first.rows().withColumn("_to", bucket(F.col(first.inner)))
    bits = bloom(own, first.inner)
    key = F.col(second.inner)
    asked = second.rows().withColumn("_maybe", might_hold(spark, bits, key))
    lacking, joined = verified(own, first.inner, asked, second.inner, "_maybe")
    met = asked.join(lacking.withColumn("_lacks", F.lit(True)), key == F.col("_key"), "left")
    to = F.when(key.isNull(), BUCKETS + 1).when(F.col("_maybe") & F.col("_lacks").isNull(), bucket(key)).otherwise(BUCKETS)
    many = materialize(met.withColumn("_to", to.cast("int")).drop("_maybe", "_key", "_lacks"), "bucket-rows")
    rows = first.rewrite(own, joined) + second.rewrite(many, joined)
    return spark.createDataFrame(rows, FILES)


def op12_cobuckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/quillmark/cobuckets-{uuid.uuid4().hex}"
    sales, lines = documents(spark, sf_dir, "sales"), documents(spark, sf_dir, "sale_lines")
    first = Numbered("sales", sales, "sale_id", sales_file(F.col("sale_id")), folder)
    second = Numbered("sale_lines", lines, "sale_id", lines_file(F.col("item_id")), folder)
    return cobucketed(first, second)


QUERIES = {"op12_cobuckets": op12_cobuckets}
ORACLES: dict[str, str] = {}
