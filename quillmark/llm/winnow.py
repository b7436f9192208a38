"""Document fingerprints by winnowing, with DataFrame functions only.

Every k-gram of code points is hashed; of each window of w consecutive k-gram hashes the minimum
is selected, the rightmost where hashes tie. Two texts that share a passage of at least
k + w - 1 code points therefore share a selected fingerprint.

A fingerprint is packed into one BIGINT, hash above position: ``hash << 27 | (2**27 - 1 - pos)``.
The minimum of packed values is then the minimum hash with the rightmost position, and sliding
minima need no second key. They are built by doubling (spans of 1, 2, 4 ... w grams), so that a
text of n code points costs n * log2(w) comparisons.

Defined results: a null text counts as empty; an empty text has no fingerprint; a text shorter
than k is one gram; with fewer than w grams all of them form the one window. A text of 2**27 code
points or more raises an error (its grams, eight bytes each, come near what one array of the JVM can
hold). Rows that share a doc_id are ordered by text, rows without one come last.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents

K, W = 20, 16
#: A doc_id with fewer rows is never cut by text; sampled texts for each part that others are cut into.
HOT_ROWS, SAMPLED = 1000, 50
POS_BITS = 27
POS = (1 << POS_BITS) - 1


def bound(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def grams(text: Column, k: int = K, first: Column | int = 0) -> Column:
    """Packed (hash, position) of every k-gram of text; positions start at first."""
    n = F.char_length(text)
    last = F.greatest(n - k, F.lit(0))

    def packed(code: Column) -> Column:
        # UTF-32 gives every code point four bytes, so that a gram is found by its offset.
        gram = lambda i: F.xxhash64(F.substring(code, 4 * i + 1, F.lit(4 * k)))
        place = lambda i: F.lit(POS) - first - i
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.shiftleft(F.shiftrightunsigned(gram(i), POS_BITS + 1), POS_BITS).bitwiseOR(place(i)))

    none = F.array().cast("array<bigint>")
    long = F.raise_error(F.lit("a text has 2**27 code points or more")).cast("array<bigint>")
    return F.when(n == 0, none).when(n > POS, long).otherwise(bound(F.encode(text, "UTF-32"), packed))


def minima(packed: Column, w: int = W) -> Column:
    """The distinct minima of every w consecutive packed grams, by position."""
    if w < 1 or w & (w - 1):
        raise ValueError("w must be a power of two")

    def wider(a: Column, by: int) -> Column:
        return bound(a, lambda x: F.zip_with(F.slice(x, F.lit(1), F.size(x) - by), F.slice(x, F.lit(by + 1), F.size(x) - by), lambda p, q: F.when(p < q, p).otherwise(q)))

    def slid(a: Column) -> Column:
        for step in range(int(math.log2(w))):
            a = wider(a, 1 << step)
        return F.array_distinct(a)

    return bound(packed, lambda a: F.when(F.size(a) == 0, a).when(F.size(a) <= w, F.array(F.array_min(a))).otherwise(slid(a)))


def selected(text: Column, k: int = K, w: int = W) -> Column:
    return minima(grams(text, k), w)


def position(packed: Column) -> Column:
    return F.lit(POS) - packed.bitwiseAND(F.lit(POS))


def hash_of(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, POS_BITS)


def selected_after_edit(text: Column, mine: Column, kept: Column, edited: Column, k: int = K, w: int = W) -> Column:
    """selected(edited) where edited starts with the first ``kept`` code points of text.

    Windows inside the common start select what they selected in text (mine); only the grams from
    2w - 2 before its end on are hashed again.
    """
    common = (kept - k + 1).cast("int")  # grams inside the common start
    start = common - 2 * w + 2  # 0-based place of the first gram to hash again
    tail = minima(grams(F.substring(edited, start + 1, F.char_length(edited)), k, start), w)
    joined = F.concat(F.filter(mine, lambda p: position(p) <= common - w), F.filter(tail, lambda p: position(p) > common - w))
    return F.when(common < 2 * w, selected(edited, k, w)).otherwise(joined)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints' hash sets; 1 if both are empty."""
    hashes = lambda x: F.array_distinct(F.transform(x, hash_of))
    share = lambda s: F.when(s["u"] == 0, F.lit(1.0)).otherwise(s["i"] / s["u"])
    sizes = bound(F.struct(hashes(a).alias("a"), hashes(b).alias("b")), lambda s: bound(F.size(F.array_intersect(s["a"], s["b"])), lambda i: share(F.struct(i.alias("i"), (F.size(s["a"]) + F.size(s["b"]) - i).alias("u")))))
    return sizes.cast("double")


def digest(packed: Column) -> Column:
    """One string for a fingerprint: SHA-256 of its hashes and positions in order."""
    return F.sha2(F.array_join(packed.cast("array<string>"), ","), 256)


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, n_chars and the fingerprint: an array of (pos, hash) by position."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.char_length(text).cast("bigint").alias("n_chars"), F.transform(selected(text, k, w), lambda p: F.struct(position(p).alias("pos"), hash_of(p).alias("hash"))).alias("fingerprint"))


def _text_bounds(rows: DataFrame, hot: dict, share: int) -> dict:
    """Texts that cut the rows of each hot doc_id into parts of about ``share``, from a bounded sample.

    Only where rows are cut depends on the sample, as with Spark's own range partitioning.
    """
    if not hot:
        return {}
    parts = {i: -(-n // share) for i, n in hot.items()}
    fraction = min(1.0, SAMPLED * sum(parts.values()) / sum(hot.values()))
    mine = reduce(Column.__or__, [F.col("doc_id").eqNullSafe(F.lit(i).cast("bigint")) for i in hot])
    seen: dict = {i: [] for i in hot}
    for r in rows.filter(mine).select("doc_id", F.substring("text", 1, 256).alias("text")).sample(fraction, 1).collect():
        seen[r["doc_id"]].append(r["text"])
    bounds = {}
    for i, texts in seen.items():
        texts.sort(key=lambda t: t.encode())
        bounds[i] = sorted({texts[len(texts) * p // parts[i]] for p in range(1, parts[i])} if texts else (), key=lambda t: t.encode())
    return {i: b for i, b in bounds.items() if b}


def with_next(docs: DataFrame, carry: dict[str, Column], per_partition: int = 4) -> DataFrame:
    """docs(doc_id, text) with ``own``: the carried columns, and ``next``: those of the row that
    follows in descending doc_id (after the last: the first).

    Documents are dealt into ranges of doc_id whose bounds are approximate quantiles, and ordered
    inside each range; an id that many rows share is cut by text as well. A range's last row finds its
    successor as a copied guest row: the head of the range below. Text is shuffled once, and no window
    spans the whole table or all rows of one id.
    """
    spark = docs.sparkSession
    ranges = per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    told = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], F.lit(10 * ranges)).alias("cuts"), F.count(F.lit(1)).alias("n")).first()
    # A doc_id (or its absence) with more rows than a range should have is cut by text as well.
    share = max(HOT_ROWS, told["n"] // ranges)
    # Such an id is a quantile, so that only these few are counted.
    listed = rows.filter(F.col("doc_id").isNull() | F.col("doc_id").isin(sorted(set(told["cuts"] or []))))
    hot = {r["doc_id"]: r["n"] for r in listed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > share).collect()}
    cuts = sorted({*(told["cuts"] or []), *(x for i in hot if i is not None for x in (i - 1, i))})
    wide = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i : i + wide] for i in range(0, len(cuts), wide)] or [[0]]
    heads_of = F.array(*[F.lit(g[0]).cast("bigint") for g in groups])
    inner = F.array(*[F.array(*[F.lit(c).cast("bigint") for c in g]) for g in groups])
    below = lambda cut: cut < F.col("doc_id")
    # Two short searches instead of one over all bounds.
    coarse = F.size(F.filter(heads_of, below))
    place = F.when(coarse == 0, 0).otherwise((coarse - 1) * wide + F.size(F.filter(F.element_at(inner, F.greatest(coarse, F.lit(1))), below)))
    place = F.when(F.col("doc_id").isNull(), -1).otherwise(place).cast("int") * (2 * ranges)
    for doc_id, bounds in _text_bounds(rows, hot, share).items():
        mine = F.col("doc_id").eqNullSafe(F.lit(doc_id).cast("bigint"))
        place = place + F.when(mine, F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x < F.col("text")))).otherwise(0)
    dealt = rows.withColumn("range", place)

    # At most one head for each range: bounded by the number of ranges.
    heads = sorted((r["range"], r["head"]) for r in dealt.groupBy("range").agg(F.max("doc_id").alias("head")).collect())[::-1]
    guests = [(head, r, heads[i - 1][0]) for i, (r, head) in enumerate(heads)]
    at_head = F.broadcast(spark.createDataFrame(guests, "head long, from int, to int"))
    found = dealt.join(at_head, (F.col("range") == F.col("from")) & F.col("doc_id").eqNullSafe(F.col("head")))
    guest = found.groupBy("head", "to").agg(F.max("text").alias("text")).select(F.col("head").alias("doc_id"), "text", F.col("to").alias("range"), F.lit(True).alias("guest"))

    packed = F.struct(*[c.alias(n) for n, c in carry.items()])
    together = dealt.withColumn("guest", F.lit(False)).unionByName(guest).repartition("range").select("doc_id", "text", "range", "guest", packed.alias("own"))
    order = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("text"))
    return together.withColumn("next", F.lead("own").over(order)).filter(~F.col("guest")).select("doc_id", "own", "next")


def compare_with_edits(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of every text and of its edited text, compared with each other.

    The edited text ends with the first floor(n/3) code points of the next document (descending
    doc_id, cyclic) instead of its own last floor(n/3).
    """
    text = F.col("text")
    rows = with_next(docs, {"text": text, "n": F.char_length(text), "prints": selected(text, k, w)})
    cut = F.floor(F.col("own.n") / 3).cast("int")
    edited = F.concat(F.substring(F.col("own.text"), F.lit(1), F.col("own.n") - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    rows = rows.select("doc_id", F.col("own.n").cast("bigint").alias("n_chars"), F.col("own.text").alias("text"), F.col("own.prints").alias("prints"), F.col("next.prints").alias("next_prints"), (F.col("own.n") - cut).alias("kept"), edited.alias("edited"))
    rows = rows.withColumn("edited_prints", selected_after_edit(F.col("text"), F.col("prints"), F.col("kept"), F.col("edited"), k, w))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        digest(F.col("prints")).alias("fingerprint"),
        digest(F.col("edited_prints")).alias("edited_fingerprint"),
        likeness(F.col("prints"), F.col("edited_prints")).alias("near_edited"),
        likeness(F.col("prints"), F.col("next_prints")).alias("near_next"),
        F.size("prints").cast("bigint").alias("n_fingerprints"),
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(documents(spark, sf_dir))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op4: sizes and edited texts. Fingerprints are tested against a plain version."""
    return op4_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


EDITS_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n FROM documents),
followed AS (
  SELECT *, coalesce(lead(text) OVER w, first(text) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS after
  FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, text DESC))
SELECT doc_id, n AS n_chars, sha256(substr(text, 1, n - n // 3) || substr(after, 1, n // 3)) AS edited_sha256 FROM followed
"""

QUERIES = {"op4_fingerprints": op4_fingerprints, "edited_texts": edited_texts}
ORACLES = {"edited_texts": EDITS_SQL}
