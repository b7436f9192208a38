"""Removal of byte strings that occur more than once, by blockwise sorted suffix buckets.

Every suffix that starts a string of LENGTH bytes inside its document is put in a bucket: the
smallest hash among the K-byte grams of that string (rightmost where hashes tie) is its anchor, and
the bucket is the anchor's hash. Equal strings have equal anchors at equal distances, so only suffixes
of one bucket, at one distance from their anchors, can tie over LENGTH bytes.

The suffixes of one anchor start at a contiguous range of distances; the bytes that they cover are the
anchor's *context*, at most 2 * LENGTH bytes.

1. Nothing is sorted that needs no place in an order: an anchor whose hash is unique has no tie, and one
   whose whole context occurs again has nothing but ties. Both are settled by counting.
2. The others are sorted bucket by bucket. A task takes whole buckets until it holds a block of some
   megabytes, and sorts their suffixes: by bucket, distance and first bytes, and longer ties by the
   ranks of a difference cover's samples, which are made once for the block (``covers``). Neighbours in
   this order that are equal over LENGTH bytes are what is looked for. Memory is a few words for each
   byte of the block, however long the ties.
3. A bucket of more than BUCKET contexts (a passage of which very many documents hold the edge) is not
   given to one task. Its suffixes are cut into blocks of BLOCK distances; each block of a context has
   two names, of the bytes common to its strings (``core``) and of all their bytes (``full``). A core
   that is unique breaks every tie of its block; one that always has the same full name proves them
   all; blocks that stay open are named suffix by suffix. Names are counted with partial results, so a
   bucket may hold a third of all documents.

Contexts and large buckets' strings are told apart by 64-bit names, contexts by BLAKE2; what is sorted
is compared byte by byte. Rows of a key that very many rows share are joined by broadcast: such keys are
at most HOT_KEYS, whatever the table.

Defined results: a null text counts as empty; matches never cross documents; a document of fewer
than LENGTH bytes keeps all; rows equal in doc_id and text are two places of the same string. Other
columns are ignored. All operations are linear in the places of repeated strings (sorting adds a
logarithm of a block's size); no pairs are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SpanHasher, blocks, documents, map_arrow, materialize, mix64, rows_of
from .covers import tied

LENGTH = 400
K = 32
BLOCK = 16
PLACE = (1 << 32) - 1
#: Contexts of a bucket that one task sorts, and bytes of buckets that it sorts at once.
BUCKET, SORTED_BYTES = 4096, 2 << 20
#: A key of more rows than HOT_ROWS and a HOT_KEYS-th of the table is met by broadcast.
HOT_ROWS, HOT_KEYS = 1000, 50_000
#: Words of the fixed-size bitmap that tells which documents have something to remove.
BITMAP_WORDS = 1 << 18

ANCHORS = "doc_id long, tid long, anchor long, print long, omin int, omax int, context long"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of keys[i : i + width] for each i, by doubling."""
    least, span = keys, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[: len(keys) - width + 1], least[width - span : len(keys) - span + 1])


def anchors_of(texts: list[bytes], length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """(text number, anchor, print, omin, omax, context) of every anchor in texts of length bytes or more."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    hasher = SpanHasher(data)
    at = np.arange(len(data) - k + 1)
    prints = mix64(hasher.spans(at, at + k))
    # Hash above place, so that the least key is the rightmost of the least hashes. The split is the
    # same in every block: equal strings must choose equal anchors.
    place = np.uint64(PLACE)
    keys = (prints & ~place) | (place - at.astype(np.uint64))
    least = _window_minima(keys, length - k + 1)
    valid = np.zeros(len(data) + 1, np.int32)
    valid[starts] += 1
    valid[ends - length + 1] -= 1
    begin = np.flatnonzero(np.cumsum(valid[: len(least)]) > 0)  # where a string of this length starts
    anchor = (place - (least[begin] & place)).astype(np.int64)
    number = np.searchsorted(ends, begin, side="right")
    new = np.ones(len(begin), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (number[1:] != number[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(begin)) - 1
    lo, hi, anchor, number = begin[first], begin[last], anchor[first], number[first]
    whole = data.tobytes()
    names = b"".join(hashlib.blake2b(whole[x:y], digest_size=8).digest() for x, y in zip(lo.tolist(), (hi + length).tolist(), strict=True))
    return number, anchor - starts[number], prints[anchor], anchor - hi, anchor - lo, np.frombuffer(names, np.uint64)


def _anchor_batches(length: int, k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((d, h, t.encode()) for d, h, t in rows_of(batches, "doc_id", "tid", "text") if t is not None and 4 * len(t) >= length)
        for block in blocks((r for r in rows if len(r[2]) >= length), lambda r: len(r[2]), 1 << 19):
            number, anchor, prints, omin, omax, context = anchors_of([r[2] for r in block], length, k)
            ids = pa.array([r[0] for r in block], pa.int64())
            tids = pa.array([r[1] for r in block], pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(number)), tids.take(pa.array(number)), pa.array(anchor), pa.array(_signed(prints)), pa.array(omin.astype(np.int32)), pa.array(omax.astype(np.int32)), pa.array(_signed(context))], names=["doc_id", "tid", "anchor", "print", "omin", "omax", "context"])

    return run


EDGES = "cid long, print long, n long, large boolean, doc_id long, tid long, anchor long, omin int, omax int, first_block int, cores array<long>, fulls array<long>, bytes binary"


def _edge_batches(length: int):
    """Contexts with their bytes and, in large buckets, the names of their blocks."""
    names = ["cid", "print", "n", "large", "doc_id", "tid", "anchor", "omin", "omax", "first_block", "cores", "fulls", "bytes"]
    kinds = [pa.int64()] * 3 + [pa.bool_()] + [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.binary()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(rows_of(batches, "doc_id", "tid", "text", "edges", step=64), lambda r: len(r[2]) + 1600 * len(r[3])):
            out = [[] for _ in names]
            for doc_id, tid, text, edges in block:
                data = text.encode()
                hasher = SpanHasher(np.frombuffer(data, np.uint8)) if any(e["large"] for e in edges) else None
                for e in edges:
                    a, omin, omax = e["anchor"], e["omin"], e["omax"]
                    if not e["large"]:
                        for column, value in zip(out, (e["cid"], e["print"], e["n"], False, doc_id, tid, a, omin, omax, 0, [], [], data[a - omax : a - omin + length]), strict=True):
                            column.append(value)
                        continue
                    first, last = omin // BLOCK, omax // BLOCK
                    low = np.arange(first, last + 1, dtype=np.int64) * BLOCK
                    high = low + BLOCK - 1
                    # Strings at distance o span [a - o, a - o + length).
                    core = hasher.spans(a - low, a - high + length)
                    whole = (low >= omin) & (high <= omax)
                    full = np.zeros(len(low), np.uint64)
                    full[whole] = mix64(hasher.spans(a - high[whole], a - low[whole] + length), 2)
                    fulls = [int(x) if w else None for x, w in zip(_signed(full), whole, strict=True)]
                    for column, value in zip(out, (e["cid"], e["print"], e["n"], True, doc_id, tid, a, omin, omax, first, _signed(mix64(core, 3)).tolist(), fulls, data[a - omax : a - omin + length]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return run


SUFFIXES = "cid long, print long, n long, o int, name long"


def _suffix_batches(length: int):
    """A row for each suffix of the blocks that the cover sample leaves open."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = rows_of(batches, "cid", "print", "n", "omin", "omax", "bytes", "open")
        for block in blocks(rows, lambda r: 16 * BLOCK * len(r[6]) + len(r[5]), 1 << 20):
            hasher = SpanHasher(np.frombuffer(b"".join(r[5] for r in block), np.uint8))
            base, out = 0, []
            for number, (_, _, _, omin, omax, data, opened) in enumerate(block):
                o = (np.array(sorted(opened), np.int64)[:, None] * BLOCK + np.arange(BLOCK)).ravel()
                o = o[(o >= omin) & (o <= omax)]
                begin = base + omax - o
                out.append((np.full(len(o), number), o, hasher.spans(begin, begin + length)))
                base += len(data)
            number, o, name = (np.concatenate(x) for x in zip(*out, strict=True))
            take = pa.array(number)
            columns = [pa.array([r[i] for r in block], pa.int64()).take(take) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(o.astype(np.int32)), pa.array(_signed(mix64(name, 4)))], names=["cid", "print", "n", "o", "name"])

    return run


STARTS = "doc_id long, tid long, first long, last long"


def _bucket_batches(length: int):
    """Ranges of starts that tie, from rows sorted by bucket: whole buckets, a block of them at a time."""

    def sorted_block(rows: list[tuple]) -> pa.RecordBatch:
        cid, prints, n, doc_id, tid, anchor, low, high = (np.array([-1 if r[i] is None else r[i] for r in rows], np.int64) for i in range(8))
        _, bucket = np.unique(prints, return_inverse=True)
        number, distance = tied([r[8] for r in rows], low, high, bucket, length)
        mine = n[number] == 1  # other contexts are removed as a whole
        number, distance = number[mine], distance[mine]
        order = np.lexsort([distance, number])
        number, distance = number[order], distance[order]
        new = np.ones(len(number), bool)
        new[1:] = (number[1:] != number[:-1]) | (distance[1:] != distance[:-1] + 1)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(number))[: len(head)] - 1
        of = number[head]
        ids = pa.array([rows[i][3] for i in of.tolist()], pa.int64())
        return pa.RecordBatch.from_arrays([ids, pa.array(tid[of]), pa.array(anchor[of] - distance[tail]), pa.array(anchor[of] - distance[head])], names=["doc_id", "tid", "first", "last"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, seen = 0, None
        for row in rows_of(batches, "cid", "print", "n", "doc_id", "tid", "anchor", "omin", "omax", "bytes"):
            if row[0] == seen:
                continue  # the document stands twice
            if held and row[1] != held[-1][1] and size >= SORTED_BYTES:
                yield sorted_block(held)
                held, size = [], 0
            held.append(row)
            size += len(row[8])
            seen = row[0]
        if held:
            yield sorted_block(held)

    return run


def met(rows: DataFrame, table: DataFrame, keys: list[str], times: str) -> DataFrame:
    """rows joined with table, which has each key once and says how many rows have it.

    Rows of a hot key are joined where they are. rows and table are written tables.
    """
    limit = max(HOT_ROWS, rows.count() // HOT_KEYS)
    hot = table.filter(F.col(times) > limit)
    if hot.isEmpty():
        return rows.join(table, keys)
    told = rows.join(F.broadcast(hot.select(*keys, F.lit(True).alias("_hot"))), keys, "left")
    cold = told.filter("_hot IS NULL").drop("_hot").join(table.filter(F.col(times) <= limit), keys)
    return cold.unionByName(rows.join(F.broadcast(hot), keys).select(*cold.columns))


def repeated_starts(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """(doc_id, tid, first, last): ranges of starts whose string of this length occurs elsewhere.

    docs: doc_id, tid (a hash of the text), text.
    """
    found = materialize(map_arrow(docs, _anchor_batches(length, k), ANCHORS), "anchors")
    shared = materialize(found.groupBy("print").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"), "anchor-prints")
    found = materialize(met(found, shared, ["print"], "times").drop("times"), "anchors-shared")

    key = ["print", "omin", "omax", "context"]
    one = [F.first(c).alias(c) for c in ("doc_id", "tid", "anchor")]
    contexts = materialize(found.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *one).withColumn("cid", F.monotonically_increasing_id()), "contexts")
    again = materialize(contexts.filter("n > 1").select(*key, "n"), "contexts-again")
    copied = met(found, again, key, "n").select("doc_id", "tid", (F.col("anchor") - F.col("omax")).alias("first"), (F.col("anchor") - F.col("omin")).alias("last"))

    # Contexts that differ around the same anchor hash have to be sorted.
    varied = materialize(contexts.groupBy("print").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"), "varied")
    edges = met(contexts, varied, ["print"], "times").withColumn("large", F.col("times") > BUCKET)
    edges = edges.groupBy("doc_id", "tid").agg(F.collect_list(F.struct("cid", "print", "n", "large", "anchor", "omin", "omax")).alias("edges"))
    held = docs.filter(F.octet_length("text") >= length).join(_renamed(edges), F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("tid") == F.col("_tid")))
    edges = materialize(map_arrow(held.select("doc_id", "tid", "text", "edges"), _edge_batches(length), EDGES), "edges")

    buckets = edges.filter("not large").select("cid", "print", "n", "doc_id", "tid", "anchor", "omin", "omax", "bytes")
    resolved = map_arrow(buckets.repartition("print").sortWithinPartitions("print", "cid"), _bucket_batches(length), STARTS)
    found = copied.unionByName(resolved)
    large = edges.filter("large")
    return found if large.isEmpty() else found.unionByName(_large_buckets(large, contexts, length))


def _large_buckets(edges: DataFrame, contexts: DataFrame, length: int) -> DataFrame:
    """As repeated_starts, for the contexts of large buckets: names of blocks, then of open suffixes, are counted."""
    cells = F.posexplode(F.arrays_zip("cores", "fulls")).alias("at", "name")
    sample = edges.select("cid", "print", "n", "doc_id", "tid", "anchor", "first_block", cells).select("cid", "print", "n", "doc_id", "tid", "anchor", (F.col("first_block") + F.col("at")).alias("block"), F.col("name.cores").alias("core"), F.col("name.fulls").alias("full"))
    sample = materialize(sample, "cover-sample")
    # A row of documents that stands twice has its contexts twice: different contexts are what counts.
    differ = [F.min("cid").alias("one"), F.max("cid").alias("other")]
    counted = sample.groupBy("print", "block", "core").agg(*differ, F.count(F.lit(1)).alias("times"), F.count("full").alias("known"), F.min("full").alias("least"), F.max("full").alias("most"))
    ties = materialize(counted.filter("one != other").select("print", "block", "core", "times", ((F.col("times") == F.col("known")) & (F.col("least") == F.col("most"))).alias("proved")), "cover-ties")
    tied_blocks = materialize(met(sample, ties, ["print", "block", "core"], "times").select("cid", "n", "doc_id", "tid", "anchor", "block", "proved"), "cover-tied")
    low = F.col("block") * BLOCK
    proved = tied_blocks.filter("proved and n = 1").select("doc_id", "tid", (F.col("anchor") - low - BLOCK + 1).alias("first"), (F.col("anchor") - low).alias("last"))

    opened = tied_blocks.filter("not proved").groupBy("cid").agg(F.collect_set("block").alias("open"))
    suffixes = materialize(map_arrow(edges.join(opened, "cid").select("cid", "print", "n", "omin", "omax", "bytes", "open"), _suffix_batches(length), SUFFIXES), "suffixes")
    equal = materialize(suffixes.groupBy("print", "o", "name").agg(*differ, F.count(F.lit(1)).alias("times")).filter("one != other").select("print", "o", "name", "times"), "suffix-ties")
    resolved = met(suffixes, equal, ["print", "o", "name"], "times").filter("n = 1").groupBy("cid").agg(F.collect_set("o").alias("os"))
    resolved = contexts.join(resolved, "cid").select("doc_id", "tid", F.explode("os").alias("o"), "anchor").select("doc_id", "tid", (F.col("anchor") - F.col("o")).alias("first"), (F.col("anchor") - F.col("o")).alias("last"))
    return proved.unionByName(resolved)


def _renamed(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("doc_id", "_doc_id").withColumnRenamed("tid", "_tid")


def _merged(ranges: list, length: int) -> list[tuple[int, int]]:
    """Maximal byte spans covered by strings that start in the ranges."""
    spans: list[list[int]] = []
    for first, last in sorted(ranges):
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], last + length)
        else:
            spans.append([first, last + length])
    return [tuple(s) for s in spans]


SPANS = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for start, end in spans:
        parts.append(data[at:start])
        at = end
    return b"".join([*parts, data[at:]])


def _span_batches(length: int, digest: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(rows_of(batches, "doc_id", "text", "ranges", step=64), lambda r: len(r[1] or "") + 200, 4 << 20):
            ids, sizes, found, kept = [], [], [], []
            for doc_id, text, ranges in block:
                data = (text or "").encode()
                spans = _merged([(r["first"], r["last"]) for r in ranges or ()], length)
                ids.append(doc_id)
                sizes.append(len(data))
                found.append(spans)
                kept.append(_kept(data, spans))
            head = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())]
            if digest:
                yield pa.RecordBatch.from_arrays([*head, pa.array([sum(e - s for s, e in x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
            else:
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*head, pa.array([[{"start": s, "end": e} for s, e in x] for x in found], kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return run


def dedup_substrings(docs: DataFrame, length: int = LENGTH, k: int = K, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, removed spans and remaining bytes (or their digest columns) of each row."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("tid"), "text")
    starts = repeated_starts(keyed, length, k)
    ranges = materialize(starts.groupBy("doc_id", "tid").agg(F.collect_set(F.struct("first", "last")).alias("ranges")), "ranges")

    # A bitmap of fixed size, whatever the input, spares unaffected documents the shuffle.
    word = F.pmod(F.col("tid"), F.lit(BITMAP_WORDS)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64("tid"), F.lit(64)).cast("int"))
    bitmap = ranges.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    marked = keyed.join(F.broadcast(bitmap), word == F.col("word"), "left").withColumn("maybe", F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False)))
    clear = marked.filter(~F.col("maybe")).select("doc_id", "text", F.lit(None).cast(ranges.schema["ranges"].dataType).alias("ranges"))
    there = _renamed(ranges)
    touched = marked.filter("maybe").select("doc_id", "tid", "text").join(there, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("tid") == F.col("_tid")), "left").select("doc_id", "text", "ranges")
    return map_arrow(clear.unionByName(touched), _span_batches(length, digest), DIGESTS if digest else SPANS)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir), digest=True)


#: Every string of 400 bytes (800 hexadecimal digits) by its MD5; texts are cut into blocks of 400 starts, so that each is a short string's part.
OP10_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h, length(hex(encode(coalesce(text, '')))) // 2 AS n_bytes
  FROM documents),
cut AS (
  SELECT rid, n_bytes, b, substr(h, b * 800 + 1, 1600) AS part
  FROM (SELECT *, unnest(range(0, (n_bytes + 399) // 400)) AS b FROM docs)),
starts AS (
  SELECT rid, b * 400 + i AS pos, md5(substr(part, 2 * i + 1, 800)) AS string
  FROM (SELECT *, unnest(range(0, 400)) AS i FROM cut) WHERE b * 400 + i + 400 <= n_bytes),
often AS (SELECT string FROM starts GROUP BY string HAVING count(*) > 1),
repeated AS (SELECT rid, pos FROM starts SEMI JOIN often USING (string)),
marked AS (SELECT *, coalesce(pos - lag(pos) OVER w > 400, TRUE) AS opens FROM repeated WINDOW w AS (PARTITION BY rid ORDER BY pos)),
numbered AS (SELECT rid, pos, count_if(opens) OVER (PARTITION BY rid ORDER BY pos) AS span FROM marked),
spans AS (SELECT rid, min(pos) AS s, max(pos) + 400 AS e FROM numbered GROUP BY rid, span),
gaps AS (
  SELECT rid, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 0) AS s, s AS e FROM spans
  UNION ALL SELECT rid, coalesce(max(e), 0), n_bytes FROM docs LEFT JOIN spans USING (rid) GROUP BY rid, n_bytes),
kept AS (SELECT rid, string_agg(substr(h, 2 * s + 1, 2 * (e - s)), '' ORDER BY s, e) AS kept FROM gaps JOIN docs USING (rid) GROUP BY rid),
told AS (SELECT rid, sum(e - s) AS n_removed, count(*) AS n_spans FROM spans GROUP BY rid)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(kept)) AS kept_sha256
FROM docs JOIN kept USING (rid) LEFT JOIN told USING (rid)
"""

QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
ORACLES = {"op10_suffix_dedup": OP10_SQL}
