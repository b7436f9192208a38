"""Exact top-k inner products by norm-bucketed retrieval.

Components are turned into integers, floor(256 * x). Vectors are laid out once in sorted ranges of
descending length (vectors of one length are dealt by vec_id), and BUCKET consecutive ones are a
bucket. Queries come in blocks of bounded size, which are broadcast: candidates stay where they are
and nothing but a task's best scores is shuffled, at most k rows for each query and task.

1. A threshold for each query: its k-th best score among the SEEDS longest vectors (a bounded set).
   The final k-th score can only be higher. A task raises it by what it finds itself.
2. A bucket whose longest vector times the query's length stays below the threshold is skipped.
3. Otherwise the threshold over (query length * bucket's longest) is the local cosine that a vector
   must reach. From COSINE on, coordinate pruning: the query's largest coordinate confines the
   vector's to a narrow interval. Below it, length pruning: only vectors of at least
   threshold / query length, a prefix of the bucket in descending length.
4. Products of what is left are verified exactly; each task returns its k best rows for a query, and
   these are merged.

Work is the number of queries times the number of vectors that lengths cannot rule out: the products
grow with the square of the table where all lengths are alike. Rows shuffled grow with queries times
ranges, and the table is read once for each block of queries.

Defined results: vectors that are null or hold a null or non-finite component take no part, as query
or as candidate; a shorter vector counts as padded with zeros; a candidate is any other vec_id than
the query's; rows with one vec_id are one vector for each different embedding; null ids take no part.
Products are exact as long as |component sums| stay below 2**63.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize

K = 5
SCALE = 256
#: Ranges of lengths, and more where a range would hold above RANGE_ROWS vectors.
LENGTHS = 64
RANGE_ROWS = 1 << 17
#: Vectors of a bucket, and queries that are multiplied with it at once.
BUCKET = 512
BLOCK = 1024
SEEDS = 1024
#: Bytes of the queries that are broadcast at once.
ASKED_BYTES = 1 << 25
#: Local cosine from which on a coordinate prunes more than lengths do.
COSINE = 0.8


def integer_vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of integers) and norm2 of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = table.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    rows = kept.select("vec_id", v.alias("v")).distinct()
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def matrix(lists: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of a list column as an integer matrix, padded with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(width, int(sizes.max(initial=0)))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    width = max(q.shape[1], c.shape[1])
    q, c = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, c))
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, width)
    if top < 2**53:  # whole numbers that doubles hold exactly
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        place = np.flatnonzero(scores >= least)
    else:
        place = np.arange(len(scores))
    return place[np.lexsort((ids[place], -scores[place]))][:k]


def _thresholds(seed_ids: np.ndarray, seeds: np.ndarray, k: int):
    """Queries with their k-th best score among the seeds (null if there are fewer)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids = part.column("vec_id").to_numpy(zero_copy_only=False)
                scores = products(matrix(part.column("v"), seeds.shape[1]), seeds)
                bounds = []
                for own, row in zip(ids, scores, strict=True):
                    row = row[seed_ids != own]
                    bounds.append(int(np.partition(row, len(row) - k)[len(row) - k]) if len(row) >= k else None)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), part.column("norm2"), pa.array(bounds, pa.int64())], names=["vec_id", "v", "norm2", "bound"])

    return run


FOUND = "query_id long, vec_id long, score long"


NOTHING = np.iinfo(np.int64).min


class Asked:
    """A block of queries with the best that a task has found for each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lengths: np.ndarray, least: np.ndarray, k: int):
        self.ids, self.vectors, self.lengths, self.k = ids, vectors, lengths, k
        #: The least score that may still count, and the best rows (ids and scores) of this task.
        self.least = least.copy()
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def keep(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ok = (scores >= self.least[i]) & (ids != self.ids[i])
        if not ok.any():
            return
        ids, scores = ids[ok], scores[ok]
        if i in self.found:
            ids, scores = (np.concatenate(pair) for pair in zip(self.found[i], (ids, scores), strict=True))
        top = best(scores, ids, self.k)
        self.found[i] = ids[top], scores[top]
        if len(top) == self.k:
            self.least[i] = max(self.least[i], int(scores[top[-1]]))

    def meet(self, c: np.ndarray, c_ids: np.ndarray, c_len: np.ndarray) -> None:
        """Compare every query with one bucket."""
        order = np.argsort(-c_len, kind="stable")
        c, c_ids, c_len = c[order], c_ids[order], c_len[order]
        c = np.pad(c, ((0, 0), (0, self.vectors.shape[1] - c.shape[1])))
        unit = None
        # Lengths are rounded; products are not.
        reach = self.lengths * c_len[0]
        slack = 1e-9 * reach + 1e-9
        bound = np.where(self.least == NOTHING, -np.inf, self.least.astype(np.float64))
        live = reach + slack >= bound
        cosine = np.where(bound > 0, bound / np.maximum(reach, 1e-300), -1.0)
        by_length = np.flatnonzero(live & (cosine < COSINE))
        need = np.where(bound > 0, (bound - slack) / np.maximum(self.lengths, 1e-300), 0.0)
        for at in range(0, len(by_length), BLOCK):
            some = by_length[at : at + BLOCK]
            cut = np.searchsorted(-c_len, -need[some], side="right")
            scores = products(self.vectors[some], c[: int(cut.max(initial=0))])
            for i, n, row in zip(some.tolist(), cut.tolist(), scores, strict=True):
                self.keep(i, c_ids[:n], row[:n])
        for i in np.flatnonzero(live & (cosine >= COSINE)).tolist():
            unit = c / np.maximum(c_len, 1e-300)[:, None] if unit is None else unit
            focus = int(np.abs(self.vectors[i]).argmax())
            a, t = self.vectors[i, focus] / self.lengths[i], min(1.0, cosine[i])
            spread = np.sqrt(max(0.0, (1 - a * a) * (1 - t * t)))
            # Vectors shorter than the bucket's longest need a larger cosine: the interval holds.
            low = a * t - spread if a > -t else -1.0
            high = a * t + spread if a < t else 1.0
            place = np.flatnonzero((unit[:, focus] >= low - 1e-9) & (unit[:, focus] <= high + 1e-9))
            self.keep(i, c_ids[place], products(self.vectors[i : i + 1], c[place])[0])


def _search(shared, k: int):
    """Every bucket of a task's vectors against the broadcast queries; the task's k best for each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Asked(*shared.value, k)
        for batch in batches:
            for at in range(0, batch.num_rows, BUCKET):
                part = batch.slice(at, BUCKET)
                asked.meet(matrix(part.column("v")), part.column("vec_id").to_numpy(), np.sqrt(part.column("norm2").to_numpy()))
        rows = [(int(asked.ids[i]), j, s) for i, (ids, scores) in asked.found.items() for j, s in zip(ids.tolist(), scores.tolist(), strict=True)]
        for at in range(0, len(rows), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[at : at + (1 << 16)]], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])

    return run


def candidates(vectors: DataFrame, queries: DataFrame, width: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): each task's best rows for each query, block by block of queries."""
    spark = vectors.sparkSession
    rows = max(1, ASKED_BYTES // (8 * max(1, width)))
    parts = max(1, -(-queries.count() // rows))
    dealt = queries.withColumn("part", F.pmod(F.xxhash64("vec_id", "norm2"), F.lit(parts)).cast("int"))
    found = spark.createDataFrame([], FOUND)
    for part in range(parts):
        block = dealt.filter(F.col("part") == part).drop("part").toArrow()  # about ASKED_BYTES
        least = np.array([NOTHING if b is None else b for b in block.column("bound").to_pylist()], np.int64)
        ids, lengths = block.column("vec_id").to_numpy(), np.sqrt(block.column("norm2").to_numpy())
        shared = spark.sparkContext.broadcast((ids, matrix(block.column("v"), width), lengths, least))
        found = found.unionByName(materialize(vectors.mapInArrow(_search(shared, k), FOUND), "products"))
        shared.unpersist()
    return found


def top_k(table: DataFrame, every: int = 50, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose vec_id is divisible by ``every``."""
    vectors = materialize(integer_vectors(table, scale), "vectors")
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).first()
    ranges = max(1, min(LENGTHS, -(-size["n"] // BUCKET)), -(-size["n"] // RANGE_ROWS))
    longest_first = (F.desc("norm2"), F.col("vec_id"))
    vectors = materialize(vectors.repartitionByRange(ranges, *longest_first).sortWithinPartitions(*longest_first), "buckets")
    seeds = vectors.orderBy(*longest_first).limit(SEEDS).select("vec_id", "v").toArrow()
    seed_ids = seeds.column("vec_id").to_numpy()
    queries = vectors.filter(F.col("vec_id") % every == 0)
    queries = materialize(queries.mapInArrow(_thresholds(seed_ids, matrix(seeds.column("v")), k), "vec_id long, v array<long>, norm2 double, bound long"), "queries")
    found = candidates(vectors, queries, size["width"], k)
    # Spark keeps the first k rows of each query before it shuffles them.
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(documents(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored)
SELECT query_id, place::INTEGER AS rank, vec_id, score FROM ranked WHERE place <= 5
"""

QUERIES = {"op7_top_k": op7_top_k}
ORACLES = {"op7_top_k": OP7_SQL}
