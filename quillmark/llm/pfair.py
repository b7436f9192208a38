"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a fixed pseudo-random order, form blocks of BLOCK documents. Block k of a
source with weight w (its target over the sum of all, as an exact fraction) may run from slot
floor(k / w) on and must have run by slot ceil((k + 1) / w). Slots are given to the released block of
earliest deadline. As weights sum to one this meets every deadline, so that at any slot t each source
has run between w t - 1 and w t + 1 blocks: less than one block from its target, however long the
table.

The schedule is one task's stream of (source, block, slot), a step for each block that exists; it
holds an entry for each source. Its slots are gathered to the ranges that ranks come from, so that
documents meet them in the join that gives them their ranks. On request a frame of whole slots is
repeated instead (``frame``): its shares are rounded, and the deviation is from these.

Ranks within a source come from counts of (source, range of order keys) and a row number inside each
range: no window spans a source, however large its share.

When a source has no block left its slots go to released blocks of others or stay empty, and the
others keep their windows: no document is dropped, capped or repeated. The deviation bound holds for
every source as long as it has blocks.

Defined results: a null source is a source of its own; weights name sources and are positive, those
not named have the mean of the named weights each; without weights each source's target is the square root of its number
of documents. Rows are ordered in a source by a hash of doc_id and text; equal rows take consecutive
places. Columns called mix_slot or mix_place are replaced; others pass through.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, map_arrow, materialize

BLOCK = 16
FRAME = 1000
#: Rows of the schedule that its task holds at once.
SCHEDULE_ROWS = 20_000


def shares(weights: dict, frame: int = FRAME) -> dict:
    """Whole numbers of slots in a frame, at least one each, for positive weights."""
    frame = max(frame, 4 * len(weights))
    total = math.fsum(weights.values())
    exact = {s: w / total * (frame - len(weights)) for s, w in weights.items()}
    out = {s: 1 + math.floor(x) for s, x in exact.items()}
    rest = frame - sum(out.values())
    for s in sorted(exact, key=lambda s: (math.floor(exact[s]) - exact[s], repr(s)))[:rest]:
        out[s] += 1
    return out


def frame_schedule(slots: dict) -> list:
    """The source of every slot of one frame: earliest deadline first among released blocks."""
    frame = sum(slots.values())
    waiting = [(0, repr(s), s, 0) for s in slots]  # (release, ..., source, block)
    heapq.heapify(waiting)
    ready: list = []
    out = []
    for slot in range(frame):
        while waiting and waiting[0][0] <= slot:
            _, name, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * frame // slots[s]), name, s, k))
        deadline, name, s, k = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("a deadline was missed")
        out.append(s)
        if k + 1 < slots[s]:
            heapq.heappush(waiting, ((k + 1) * frame // slots[s], name, s, k + 1))
    return out


def exact_schedule(target: dict, blocks: dict) -> Iterator[tuple]:
    """(source, block, slot) of every block: earliest deadline first, windows from the exact weights."""
    names = sorted(blocks, key=repr)
    exact = [Fraction(target[s]) for s in names]
    scale = math.lcm(*(x.denominator for x in exact))
    parts = [int(x * scale) for x in exact]
    whole = sum(parts)
    waiting = [(0, i, 0) for i, s in enumerate(names) if blocks[s]]  # (release, source, block)
    ready: list = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * whole // parts[i]), i, k))
        deadline, i, k = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("a deadline was missed")
        yield names[i], k, slot
        if k + 1 < blocks[names[i]]:
            heapq.heappush(waiting, ((k + 1) * whole // parts[i], i, k + 1))
        slot += 1


def framed_schedule(target: dict, blocks: dict, frame: int) -> Iterator[tuple]:
    """(source, block, slot) of every block, by one frame of rounded shares that repeats."""
    slots = shares(target, frame)
    order = frame_schedule(slots)
    at: dict = {s: [] for s in slots}
    for slot, s in enumerate(order):
        at[s].append(slot)
    for s, n in blocks.items():
        for k in range(n):
            yield s, k, k // slots[s] * len(order) + at[s][k % slots[s]]


def _schedule(sizes: DataFrame, weights: dict | None, block: int, frame: int | None) -> DataFrame:
    """The schedule as a table, streamed by one task from the table (source, n) of sources.

    The task holds an entry for each source, of which none passes through the driver.
    """
    shared = sizes.sparkSession.sparkContext.broadcast(weights or {})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = {s: k for batch in batches for s, k in zip(batch.column("source").to_pylist(), batch.column("n").to_pylist(), strict=True)}
        given = shared.value
        mean = math.fsum(given.values()) / len(given) if given else 0.0
        target = {s: given.get(s, mean) if given else math.sqrt(k) for s, k in n.items()}
        blocks = {s: -(-k // block) for s, k in n.items()}
        found = exact_schedule(target, blocks) if frame is None else framed_schedule(target, blocks, frame)
        while n and (part := list(itertools.islice(found, SCHEDULE_ROWS))):
            columns = list(zip(*part, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["_ps", "_pb", "_slot"])

    return map_arrow(sizes.coalesce(1), run, "_ps string, _pb long, _slot long")


PLACES = ("mix_slot", "mix_place")


def mix(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, frame: int | None = None, places: tuple[str, str] = PLACES) -> DataFrame:
    """docs with mix_slot and mix_place: the schedule's slot and the place inside its block.

    Ordering by both gives the mixed sequence. The added columns are named by ``places``.
    """
    spark = docs.sparkSession
    if not all(0 < w < math.inf for w in (weights or {}).values()):
        raise ValueError("weights must be positive")
    sizes = materialize(docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "mix-sources")
    schedule = materialize(_schedule(sizes, weights, block, frame), "mix-schedule")

    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Internal names: no column of docs can clash, and those that the caller drops are never shuffled.
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    # Order-preserving: the range is the leading part of the unsigned key.
    unsigned = F.shiftrightunsigned(F.col("_key").bitwiseXOR(F.lit(-(1 << 63))), 32)
    keyed = docs.select(*[F.col(c).alias(n) for c, n in names.items()], F.col("source").alias("_source"), F.xxhash64("doc_id", "text").alias("_key"), F.xxhash64(F.lit(1), "doc_id", "text").alias("_tie"))
    rows = keyed.withColumn("_range", F.floor(unsigned * ranges / float(1 << 32)).cast("int"))
    counts = materialize(rows.groupBy("_source", "_range").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    before = F.sum("n").over(Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_source", "_range", "n", F.coalesce(before, F.lit(0)).alias("_start")).withColumn("_first", F.floor(F.col("_start") / block))
    # The slots of the blocks that each range touches: one number for each block of documents.
    touched = starts.withColumn("_b", F.explode(F.sequence("_first", F.floor((F.col("_start") + F.col("n") - 1) / block))))
    met = touched.join(schedule, F.col("_source").eqNullSafe(F.col("_ps")) & (F.col("_b") == F.col("_pb")))
    slots = met.groupBy(F.col("_source").alias("_s"), F.col("_range").alias("_r"), "_start", "_first").agg(F.sort_array(F.collect_list("_slot")).alias("_slots"))
    slots = materialize(slots, "mix-slots")
    nth = F.row_number().over(Window.partitionBy("_source", "_range").orderBy("_key", "_tie", F.col(names["doc_id"]))) - 1
    ranked = rows.withColumn("_nth", nth).join(slots, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    found = ranked.withColumn("_rank", F.col("_start") + F.col("_nth"))
    slot = F.element_at("_slots", (F.floor(F.col("_rank") / block) - F.col("_first") + 1).cast("int"))
    others = {c: n for c, n in names.items() if c not in places}
    return found.select(*others.values(), slot.cast("bigint").alias("_at"), (F.col("_rank") % block).cast("bigint").alias("_in")).toDF(*others, *places)


def mixed_order(docs: DataFrame, weights: dict | None = None, block: int = BLOCK) -> DataFrame:
    """docs, with rows and files in the mixed order: ranges of slots, sorted inside."""
    # Names that docs does not have: its own columns stay, whatever they are called.
    longest = max(map(len, docs.columns))
    places = ("_" * (longest + 1), "_" * (longest + 2))
    return mix(docs, weights, block, places=places).repartitionByRange(*places).sortWithinPartitions(*places).select(*docs.columns)


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir).select("doc_id", "source", "text")).select("doc_id", "source", "mix_slot", "mix_place")


def mix_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slots that the mixed documents stand in: source, number of documents and the last one's place."""
    rows = op6_mix(spark, sf_dir)
    return rows.groupBy("mix_slot", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.max("mix_place").alias("last_place"))


#: The schedule slot by slot, in whole numbers: a square root's double times 2**52 is one.
SLOTS_SQL = """
WITH RECURSIVE sizes AS (
  SELECT source, n, row_number() OVER (ORDER BY source NULLS LAST) AS i, (n + 15) // 16 AS n_blocks, (sqrt(n::DOUBLE) * 4503599627370496)::HUGEINT AS part
  FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)),
given AS (
  SELECT list(part ORDER BY i) AS parts, list(n_blocks ORDER BY i) AS n_blocks, sum(part)::HUGEINT AS whole, range(1, count(*) + 1) AS all_sources
  FROM sizes),
steps AS (
  SELECT 0::BIGINT AS next_slot, list_transform(all_sources, lambda i: 0::BIGINT) AS done, NULL::BIGINT AS i, NULL::BIGINT AS k, NULL::BIGINT AS slot FROM given
  UNION ALL
  SELECT slot + 1, list_transform(all_sources, lambda j: done[j] + CASE WHEN j = pick THEN 1 ELSE 0 END), pick, done[pick], slot
  FROM (
    SELECT *, list_sort(list_transform(list_filter(waiting, lambda w: w.release <= slot), lambda w: {'deadline': w.deadline, 'i': w.i}))[1].i AS pick
    FROM (
      SELECT *, greatest(next_slot, list_min(list_transform(waiting, lambda w: w.release)))::BIGINT AS slot
      FROM (
        SELECT next_slot, done, all_sources,
          list_transform(list_filter(all_sources, lambda j: done[j] < n_blocks[j]), lambda j: {
            'release': (done[j]::HUGEINT * whole) // parts[j], 'deadline': ((done[j] + 1)::HUGEINT * whole + parts[j] - 1) // parts[j], 'i': j}) AS waiting
        FROM (SELECT next_slot, done FROM steps), given)
      WHERE len(waiting) > 0)))
SELECT slot AS mix_slot, source, least(16, n - 16 * k)::BIGINT AS n_docs, (least(16, n - 16 * k) - 1)::BIGINT AS last_place
FROM steps JOIN sizes USING (i)
"""

QUERIES = {"op6_mix": op6_mix, "mix_slots": mix_slots}
ORACLES = {"mix_slots": SLOTS_SQL}
