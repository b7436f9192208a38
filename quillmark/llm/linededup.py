"""Repeated runs of lines, found by winnowing over line hashes, with DataFrame functions only.

A document is its sequence of non-blank lines (split at \\n, compared after trimming spaces). A
fingerprint is the hash of K consecutive lines; of each W consecutive fingerprints the smallest is
selected, the rightmost where they tie. Any run of MIN_RUN = K + W - 1 equal lines therefore holds a
selected fingerprint at the same place in each of its copies. Shorter runs qualify by their words:
each run of fewer lines that holds more than MIN_WORDS words is a fingerprint of its own.

1. Selected fingerprints are counted; only those that occur more than once are followed.
2. Each place of such a fingerprint is extended both ways to every run of MIN_RUN lines that covers
   it. Runs are grouped by their hashes, and the first place of each, by (doc_id, line), is found.
3. The lines of every later place are deleted. Longer repeated runs are unions of such runs, so a
   line goes exactly when it stands in a run of at least MIN_RUN lines, or of more than MIN_WORDS
   words, that occurred before.

No pair of places is formed: groups of copies are aggregated to their first place and joined with
it, which costs a row for each place however large the group.

Defined results: a null text stays null and has no line; blank lines are neither compared nor
deleted; rows equal in doc_id and text are one document (both keep the same lines); rows that share
a doc_id only are ordered by a hash of their text; a null doc_id comes first. Runs never cross
documents, but may repeat inside one. Words are what white space (of ASCII) separates. Other columns pass through unchanged,
whatever their names; those called n_lines or n_removed are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, internal, marked, materialize
from .winnow import bound

K, W = 2, 2
MIN_RUN = K + W - 1
#: A run of fewer than MIN_RUN lines qualifies with more words than this.
MIN_WORDS = 50


def line_hashes(text: Column) -> Column:
    """(at, hash, words) of each non-blank line; at: its place among all lines."""
    words = lambda line: F.regexp_count(line, F.lit(r"\S+")).cast("bigint")
    each = F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(i.alias("at"), F.xxhash64(F.trim(line)).alias("hash"), words(line).alias("words"), (F.trim(line) == "").alias("blank")))
    kept = F.filter(each, lambda x: ~x["blank"])
    return F.transform(kept, lambda x: F.struct(x["at"].alias("at"), x["hash"].alias("hash"), x["words"].alias("words")))


def _grams(lines: Column, k: int) -> Column:
    """The hash of each k consecutive lines."""
    parts = lambda i: [F.element_at(lines, i + 1 + j)["hash"] for j in range(k)]
    return F.transform(F.sequence(F.lit(0), F.size(lines) - k), lambda i: F.xxhash64(*parts(i)))


def _selected(grams: Column, w: int) -> Column:
    """0-based places of the window minima, rightmost on ties."""
    n = F.size(grams)

    def least(start: Column) -> Column:
        window = F.slice(grams, start + 1, F.lit(w))
        return start + F.lit(w) - F.array_position(F.reverse(window), F.array_min(window)).cast("int")

    return F.array_distinct(F.transform(F.sequence(F.lit(0), n - w), least))


def places(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """A row for each selected fingerprint: doc_id, text_hash, print and the runs that cover it."""
    run = k + w - 1

    def one(lines: Column, s: Column, n: int) -> Column:
        """The run of n lines from s on."""
        hashes = [F.element_at(lines, s + 1 + j)["hash"] for j in range(n)]
        # Two independent combinations: 128 bits for each run.
        return F.struct(F.xxhash64(*hashes).alias("key"), F.xxhash64(F.lit(1), *hashes[::-1]).alias("check"), s.cast("bigint").alias("start"), F.transform(F.slice(lines, s + 1, F.lit(n)), lambda x: x["at"]).alias("lines"))

    def runs_over(lines: Column, at: Column) -> Column:
        starts = F.filter(F.transform(F.sequence(F.lit(1 - w), F.lit(0)), lambda d: at + d), lambda s: (s >= 0) & (s + run <= F.size(lines)))
        return F.transform(starts, lambda s: one(lines, s, run))

    def long(lines: Column) -> Column:
        each = lambda g: F.transform(_selected(g, w), lambda at: F.struct(F.element_at(g, at + 1).alias("print"), runs_over(lines, at).alias("runs")))
        return F.when(F.size(lines) >= run, bound(_grams(lines, k), each))

    def wordy(lines: Column, n: int) -> Column:
        """Runs of n lines that qualify by their words; past the end get() is null."""
        words = lambda s: sum((F.get(lines, s + j)["words"] for j in range(1, n)), F.get(lines, s)["words"])
        starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda s: words(s) > MIN_WORDS)
        return F.transform(starts, lambda s: bound(one(lines, s, n), lambda r: F.struct(r["key"].alias("print"), F.array(r).alias("runs"))))

    def found(lines: Column) -> Column:
        lists = F.array(long(lines), *[wordy(lines, n) for n in range(1, run)])
        return F.flatten(F.filter(lists, lambda x: x.isNotNull()))

    held = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), line_hashes(F.col("text")).alias("lines")).filter(F.size("lines") > 0)
    return held.select("doc_id", "text_hash", F.explode(bound(F.col("lines"), found)).alias("p")).select("doc_id", "text_hash", "p.print", "p.runs")


def repeated_lines(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, text_hash and ``gone``: the places of the lines to delete, for documents with any."""
    found = materialize(places(docs, k, w), "line-prints")
    often = materialize(found.groupBy("print").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("print"), "line-prints-often")
    runs = found.join(often, "print").select("doc_id", "text_hash", F.explode("runs").alias("r")).select("doc_id", "text_hash", "r.key", "r.check", "r.start", "r.lines")
    runs = materialize(runs, "line-runs")
    where = F.struct("doc_id", "text_hash", "start")
    first = materialize(runs.groupBy("key", "check").agg(F.min(where).alias("first"), F.max(where).alias("last")).filter("first != last").select("key", "check", "first"), "line-runs-first")
    later = runs.join(first, ["key", "check"]).filter(where != F.col("first"))
    return later.groupBy("doc_id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_set("lines"))).alias("gone"))


def dedup_lines(docs: DataFrame, k: int = K, w: int = W, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with their later repeated runs deleted from text; n_lines and n_removed are added.

    The added columns are named by ``counts``; columns of docs of these names are replaced.
    """
    columns = [c for c in docs.columns if c not in counts]
    docs, names = internal(docs.select(*columns), "doc_id", "text")
    gone = materialize(repeated_lines(docs, k, w).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("gone").alias("_gone")), "lines-gone")
    # Texts that lose nothing are not shuffled.
    seen = marked(docs.withColumn("_text_hash", F.xxhash64("text")), "_text_hash", gone.select(F.col("_hash").alias("_text_hash")))
    whole = seen.filter(~F.col("maybe")).select(*docs.columns, F.lit(None).cast(gone.schema["_gone"].dataType).alias("_gone"))
    found = seen.filter("maybe").join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left")
    joined = whole.unionByName(found.select(*docs.columns, "_gone"))
    parts = F.split("text", "\n", -1)

    def without(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
        return F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n")

    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(bound(parts, without))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    told = joined.select(*[(text if n == "text" else F.col(n)).alias(n) for n in docs.columns], n_lines.cast("bigint").alias("_n"), F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("_r"))
    return told.toDF(*names, *counts)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))


#: Every run of three non-blank lines or of more than 50 words, its first place, and what is left of each text.
OP5_SQL = r"""
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents),
lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM docs),
full_lines AS (
  SELECT doc_id, text, trim(line, ' ') AS line, len(regexp_extract_all(line, '\S+')) AS words, pos,
         row_number() OVER (PARTITION BY doc_id, text ORDER BY pos) AS nr
  FROM lines WHERE trim(line, ' ') <> ''),
ahead AS (
  SELECT *, lead(line, 1) OVER w AS line2, lead(line, 2) OVER w AS line3, lead(words, 1) OVER w AS words2, lead(pos, 1) OVER w AS pos2, lead(pos, 2) OVER w AS pos3
  FROM full_lines WINDOW w AS (PARTITION BY doc_id, text ORDER BY nr)),
runs AS (
  SELECT doc_id, text, nr, 3 AS size, line || chr(10) || line2 || chr(10) || line3 AS run, [pos, pos2, pos3] AS places FROM ahead WHERE line3 IS NOT NULL
  UNION ALL SELECT doc_id, text, nr, 2, line || chr(10) || line2, [pos, pos2] FROM ahead WHERE words + words2 > 50
  UNION ALL SELECT doc_id, text, nr, 1, line, [pos] FROM ahead WHERE words > 50),
placed AS (SELECT *, row_number() OVER (PARTITION BY size, run ORDER BY doc_id, nr) AS place FROM runs),
gone AS (SELECT DISTINCT doc_id, text, unnest(places) AS pos FROM placed WHERE place > 1),
counted AS (SELECT doc_id, text, count(*) AS n_removed FROM gone GROUP BY doc_id, text),
rebuilt AS (
  SELECT l.doc_id, l.text, string_agg(l.line, chr(10) ORDER BY l.pos) AS kept
  FROM lines l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.text = g.text AND l.pos = g.pos GROUP BY l.doc_id, l.text)
SELECT d.doc_id,
       CASE WHEN c.n_removed IS NULL THEN d.text ELSE coalesce(r.kept, '') END AS text,
       CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines,
       coalesce(c.n_removed, 0)::BIGINT AS n_removed
FROM documents d
LEFT JOIN counted c ON c.doc_id = d.doc_id AND c.text = d.text
LEFT JOIN rebuilt r ON r.doc_id = d.doc_id AND r.text = d.text
"""

QUERIES = {"op5_line_dedup": op5_line_dedup}
ORACLES = {"op5_line_dedup": OP5_SQL}
