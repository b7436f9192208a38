"""A Merkle manifest of a dataset: a tree of fixed arity for each language, and a tree over these.

1. Leaves are digests of rows. They are put in sorted ranges (language, doc_id, leaf), and each gets the
   number of its tree and its place in it from the sizes of the ranges before: no window spans a language.
2. A sparse forest holds the nodes whose siblings are not all known, keyed by tree, level and index. Its
   sum is associative and commutative: wherever the last of a run's siblings arrives (the tree's size
   tells how many there are), the run is closed and its parent arrives in turn; a tree's root arrives as
   a leaf of the tree over all. A task closes what lies in its rows: at most ARITY - 1 nodes at either
   end of a level stay open. ``treeReduce`` sums these remains to one node, the root.
3. Closed runs are stored by level: those of the tasks where they were closed, those of the sum (at most
   one for a level and border between two tasks) from its result. Proofs come from them top down: a
   node's proof is its own run's others before its parent's proof. Each level joins a run with its parent,
   an eighth of the level below; leaves meet their run last, eight to a run.

Defined results: doc_id, source, lang, n_chars and text may each be null, and texts of any length are
hashed where they stand, in the JVM. Null doc_ids and null languages come first; rows equal in lang and
doc_id are ordered by their leaf, and equal rows are leaves of their own whose proofs differ in place
only: which of them has which is not defined, as nothing tells them apart, but the set of results is.
Where doc_id is null nothing is tampered with. An empty table has no row and no root. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.ranking import ROW_BITS, ranked
from .common import documents, map_arrow, materialize, rows_of

ARITY_BITS = 3
ARITY = 1 << ARITY_BITS
DIGEST = 32
#: The number of the tree over all trees.
TOP = -1
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def height(n: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def parent_of(digests: Iterable[bytes]) -> bytes:
    """The digest of a run: digests are concatenated as lower-case hexadecimal text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


class Forest:
    """Nodes whose run is not complete, of any part of the trees; ``add`` and ``merge`` close complete runs.

    trees is the number of trees; ``closed`` gathers runs (tree, level, parent, digests) as they close.
    """

    def __init__(self, trees: int):
        self.trees, self.root = trees, None
        self.open: dict[tuple[int, int, int], tuple[int, dict[int, bytes]]] = {}
        self.closed: list[tuple[int, int, int, bytes]] = []

    def add(self, tree: int, n: int, level: int, index: int, digest: bytes) -> None:
        while True:
            width = -(-n >> ARITY_BITS * level)
            if width == 1 and tree == TOP:
                self.root = digest
                return
            if width == 1:
                tree, n, level, index = TOP, self.trees, 0, tree
                continue
            run = index >> ARITY_BITS
            _, held = self.open.setdefault((tree, level, run), (n, {}))
            held[index & ARITY - 1] = digest
            if len(held) < min(ARITY, width - (run << ARITY_BITS)):
                return
            del self.open[tree, level, run]
            digests = [held[i] for i in range(len(held))]
            self.closed.append((tree, level, run, b"".join(digests)))
            level, index, digest = level + 1, run, parent_of(digests)

    def nodes(self) -> Iterator[tuple[int, int, int, int, bytes]]:
        """(tree, n, level, index, digest) of all that is open, and of the root if it is known."""
        for (tree, level, run), (n, held) in self.open.items():
            for place, digest in held.items():
                yield tree, n, level, (run << ARITY_BITS) + place, digest
        if self.root is not None:
            yield TOP, self.trees, height(self.trees), 0, self.root

    def merge(self, other: Forest) -> Forest:
        """The sum of both; the larger takes in the nodes of the smaller."""
        into, part = (self, other) if len(self.open) >= len(other.open) else (other, self)
        into.closed += part.closed
        into.root = into.root or part.root
        for node in part.nodes():
            into.add(*node)
        return into


def leaf(text: Column | None = None) -> Column:
    """The digest of a row: each column as `-` or its byte count, a colon and its value."""

    def told(name: str) -> Column:
        value = F.col(name).cast("string") if name != "text" or text is None else text
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(told, COLUMNS)), 256))


def tampered_leaf() -> Column:
    """The leaf after tampering: where 3 divides crc32(doc_id as text), the text's A-Z are lower-cased."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(hit, leaf(F.translate("text", _UPPER, _LOWER)))


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, tampered (null where nothing is), tree, n (leaves of the tree) and index of every row."""
    rows = docs.select(*[F.col(c) for c in COLUMNS])
    made = rows.select("doc_id", "lang", leaf().alias("leaf"), tampered_leaf().alias("tampered"), F.monotonically_increasing_id().alias("copy"))
    order = ["lang", "doc_id", "leaf", "copy"]
    # Written first: sampling for the ranges would hash the texts once more.
    laid = materialize(made, "leaves").repartitionByRange(*order).sortWithinPartitions(*order).drop("copy")
    laid = materialize(laid.withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.shiftright("at", ROW_BITS)), "leaves-sorted")
    # A row for each range and language in it; a language has at most one in each range.
    parts = laid.groupBy("range", "lang").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).withColumn("n", F.sum("rows").over(Window.partitionBy("lang")))
    trees = ranked(parts.select("lang").distinct(), F.col("lang"), name="tree").select(F.col("lang").alias("own"), (F.col("tree") - 1).alias("tree"))
    parts = materialize(parts.join(trees, F.col("lang").eqNullSafe(F.col("own"))).select("range", F.col("lang").alias("own"), "first", "before", "n", "tree"), "leaf-ranges")
    met = laid.join(parts.withColumnRenamed("range", "_range"), (F.col("range") == F.col("_range")) & F.col("lang").eqNullSafe(F.col("own")))
    return met.select("doc_id", "leaf", "tampered", "tree", "n", (F.col("at") - F.col("first") + F.col("before")).alias("index"))


_PARTS = "open boolean, level int, tree long, n long, index long, digests binary"


def forests(leaves: DataFrame, trees: int) -> DataFrame:
    """The closed runs of each task's leaves, and the nodes that it leaves open."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(trees)

        def told(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["open", "level", "tree", "n", "index", "digests"])

        def closed() -> list[tuple]:
            gone, forest.closed = forest.closed, []
            return [(False, level, tree, None, index, digests) for tree, level, index, digests in gone]

        for tree, n, index, digest in rows_of(batches, "tree", "n", "index", "leaf"):
            forest.add(tree, n, 0, index, digest)
            if len(forest.closed) >= 4096:
                yield told(closed())
        yield told(closed())
        yield told([(True, level, tree, n, index, digest) for tree, n, level, index, digest in forest.nodes()])

    return map_arrow(leaves.select("tree", "n", "index", "leaf"), run, _PARTS)


def reduced(parts: DataFrame, trees: int) -> Forest:
    """The sum of all open nodes: its root, and the runs that it closed."""

    def summed(rows: Iterable) -> Iterator[Forest]:
        forest = Forest(trees)
        for r in rows:
            forest.add(r["tree"], r["n"], r["level"], r["index"], bytes(r["digests"]))
        yield forest

    fragments = parts.filter("open").select("tree", "n", "level", "index", "digests").rdd.mapPartitions(summed)
    return fragments.treeReduce(Forest.merge) if fragments.getNumPartitions() else Forest(trees)


def _step(digests: Column, place: Column) -> Column:
    """What stands before and after a place of a run."""
    after = (place + 1) * DIGEST
    return F.struct(F.substring(digests, F.lit(1), place * DIGEST).alias("left"), F.substring(digests, after + 1, F.octet_length(digests) - after).alias("right"))


def _descended(nodes: DataFrame, runs: DataFrame) -> DataFrame:
    """Nodes (tree, index, steps, subroot) and runs of the level below: (tree, index, digests, steps, subroot) of each run."""
    parents = nodes.select(F.col("tree").alias("_tree"), F.col("index").alias("_index"), "steps", "subroot")
    return runs.join(parents, (F.col("tree") == F.col("_tree")) & (F.col("index") == F.col("_index"))).drop("_tree", "_index")


def _children(runs: DataFrame) -> DataFrame:
    """The nodes of runs, with their digests and their steps to the root."""
    many = (F.octet_length("digests") / DIGEST).cast("int")
    each = runs.select("*", F.explode(F.sequence(F.lit(0), many - 1)).alias("place"))
    steps = F.concat(F.array(_step(F.col("digests"), F.col("place"))), F.col("steps"))
    digest = F.substring(F.col("digests"), F.col("place") * DIGEST + 1, F.lit(DIGEST))
    return each.select("tree", (F.col("index") * ARITY + F.col("place")).alias("index"), steps.alias("steps"), "subroot", digest.alias("digest"))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    spark = docs.sparkSession
    leaves = materialize(placed(docs), "leaves-placed")
    shape = leaves.agg(F.max("tree").alias("last"), F.max("n").alias("n")).first()
    trees, tallest = (shape["last"] + 1, height(shape["n"])) if shape["n"] else (0, 0)
    parts = materialize(forests(leaves, trees), "forests", "open", "level")
    forest = reduced(parts, trees)
    upper = spark.createDataFrame([(level, tree, index, bytearray(d)) for tree, level, index, d in forest.closed], "level int, tree long, index long, digests binary")
    closed = parts.filter("NOT open").select("level", "tree", "index", "digests").unionByName(upper)
    root = F.lit(forest.root.hex() if forest.root else None).cast("string")

    def level(number: int, top: bool) -> DataFrame:
        return closed.filter((F.col("level") == number) & ((F.col("tree") == TOP) == F.lit(top))).drop("level")

    no_steps = F.array().cast("array<struct<left: binary, right: binary>>")
    nodes = spark.range(1).select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).cast("long").alias("index"), no_steps.alias("steps"), F.lit(None).cast("binary").alias("subroot"), F.unhex(root).alias("digest"))
    for number in reversed(range(height(trees))):
        nodes = _children(_descended(nodes, level(number, True)))
    sizes = leaves.filter("index = 0").select("tree", "n").distinct()
    roots = materialize(nodes.select(F.col("index").alias("tree"), "steps", F.col("digest").alias("subroot")).join(sizes, "tree"), "subroots")
    # Trees of one height start at the same level.
    tops = lambda h: roots.filter((F.col("n") > ARITY ** (h - 1)) & (F.col("n") <= ARITY**h) if h else F.col("n") == 1).select("tree", F.lit(0).cast("long").alias("index"), "steps", "subroot")
    nodes = tops(tallest)
    for number in reversed(range(1, tallest)):
        nodes = _children(_descended(nodes, level(number, False))).drop("digest").unionByName(tops(number))
    own = leaves.withColumn("run", F.shiftright("index", ARITY_BITS)).withColumn("place", F.col("index").bitwiseAND(F.lit(ARITY - 1)).cast("int"))
    if tallest:
        runs = materialize(_descended(nodes, level(0, False)).select(F.col("tree").alias("_tree"), F.col("index").alias("_run"), "digests", "steps", "subroot"), "runs")
        met = own.filter("n > 1").join(runs, (F.col("tree") == F.col("_tree")) & (F.col("run") == F.col("_run")))
        met = met.select("doc_id", "leaf", "tampered", "subroot", F.concat(F.array(_step(F.col("digests"), F.col("place"))), F.col("steps")).alias("steps"))
    else:
        met = own.limit(0).select("doc_id", "leaf", "tampered", F.col("leaf").alias("subroot"), no_steps.alias("steps"))
    alone = own.filter("n = 1").join(tops(0).drop("index"), "tree").select("doc_id", "leaf", "tampered", "subroot", "steps")
    text = lambda c: F.lower(F.hex(c))
    proof = F.array_join(F.transform("steps", lambda s: F.concat(text(s["left"]), text(s["right"]))), "")
    folded = F.aggregate("steps", text(F.coalesce("tampered", "leaf")), lambda d, s: F.sha2(F.concat(text(s["left"]), d, text(s["right"])), 256))
    told = met.unionByName(alone).select("doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), root.alias("root"), F.sha2(proof, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(documents(spark, sf_dir))


#: Levels that the SQL unrolls: 8**7 leaves of a language and 8**3 languages.
_LEVELS, _TOP_LEVELS = 7, 3
_VALUE = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_VALUE.format(text if c == "text" else c) for c in COLUMNS) + ")"


def _tree_sql(name: str, levels: int) -> str:
    """Levels name0 (tree, width, idx, d) and up, and for each the siblings before and after a node."""
    out = [f"{name}{k + 1} AS (SELECT tree, (width + 7) // 8 AS width, idx // 8 AS idx, sha256(string_agg(d, '' ORDER BY idx)) AS d FROM {name}{k} WHERE width > 1 GROUP BY 1, 2, 3)" for k in range(levels)]
    run = "OVER (PARTITION BY tree, idx // 8 ORDER BY idx ROWS BETWEEN {0})"
    out += [f"{name}s{k} AS (SELECT tree, idx, coalesce(string_agg(d, '') {run.format('UNBOUNDED PRECEDING AND 1 PRECEDING')}, '') AS l, coalesce(string_agg(d, '') {run.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')}, '') AS r FROM {name}{k} WHERE width > 1)" for k in range(levels)]
    return ",\n".join(out)


def _folds_sql() -> str:
    """Each step of a leaf's way to the root: what is proved so far, and the digest so far."""
    out = ["f0 AS (SELECT *, '' AS proof, tampered AS d FROM placed)"]
    steps = [(f"ns{k}", "tree", f"idx // {8**k}") for k in range(_LEVELS)] + [(f"ts{k}", "0", f"tree // {8**k}") for k in range(_TOP_LEVELS)]
    for k, (siblings, tree, idx) in enumerate(steps):
        out.append(f"f{k + 1} AS (SELECT f.* EXCLUDE (proof, d), f.proof || coalesce(s.l || s.r, '') AS proof, CASE WHEN s.l IS NULL THEN f.d ELSE sha256(s.l || f.d || s.r) END AS d FROM f{k} f LEFT JOIN {siblings} s ON s.tree = f.{tree} AND s.idx = f.{idx})".replace("f.0 ", "0 "))
    return ",\n".join(out)


OP11_SQL = rf"""
WITH crc AS (
  SELECT *, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1))), 4294967295) AS crc FROM documents),
leaves AS (
  SELECT doc_id, lang, {_leaf_sql('text')} AS leaf,
         CASE WHEN crc % 3 = 0 THEN {_leaf_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {_leaf_sql('text')} END AS tampered FROM crc),
placed AS (
  SELECT doc_id, leaf, tampered, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY lang) AS width,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
n0 AS (SELECT tree, width, idx, leaf AS d FROM placed),
{_tree_sql('n', _LEVELS)},
subroots AS ({' UNION ALL '.join(f'SELECT tree, d FROM n{k} WHERE width = 1' for k in range(_LEVELS + 1))}),
t0 AS (SELECT 0 AS tree, count(*) OVER () AS width, tree AS idx, d FROM subroots),
{_tree_sql('t', _TOP_LEVELS)},
roots AS ({' UNION ALL '.join(f'SELECT d FROM t{k} WHERE width = 1' for k in range(_TOP_LEVELS + 1))}),
{_folds_sql()}
SELECT doc_id, leaf, s.d AS subroot, r.d AS root, sha256(proof) AS proof_sha256, f.d AS folded_root, f.d = r.d AS verified
FROM f{_LEVELS + _TOP_LEVELS} f JOIN subroots s ON s.tree = f.tree CROSS JOIN roots r
"""

QUERIES = {"op11_merkle": op11_merkle}
ORACLES = {"op11_merkle": OP11_SQL}
