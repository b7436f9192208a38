"""Near-duplicate classes by DartMinHash signatures and banded joining.

A text is the multiset of its word 5-grams (lower case, words separated by white space; a text of
fewer words is one gram): a gram's weight is its number of occurrences. Two texts are alike if
their weighted Jaccard similarity, sum(min) / sum(max), is at least 0.8.

DartMinHash: weight and rank span a plane for each element. A hash throws Poisson(1) darts into each
unit cell of it; a text catches the darts below its weight whose rank is under a limit. Each dart
belongs to one of COORDINATES coordinates, and the earliest caught dart of each is the signature. The
limit t / (sum of weights), t = k ln k + 2k, lets about t darts be caught, however long the text. A
text that leaves a coordinate empty doubles its limit. Two texts agree in a coordinate with
probability equal to their similarity.

ROWS consecutive coordinates form a band. Texts alike at 0.8 share none of the BANDS bands with
probability (1 - 0.8**4)**32 < 1e-7. Texts that share a band are candidates:

1. Exact copies are one text from the start.
2. In each band bucket every text is compared with the bucket's first text. What proves alike by
   exact multiset similarity is linked; connected components follow.
3. Buckets whose texts are still in several components are compared in full, but for pairs inside
   a component: if few texts are outside the largest component, pair by pair; else in blocks of
   texts, each block pair a row of its own that returns only a spanning forest. There each text
   outside the largest component meets all texts of the other block at once: its grams are marked,
   and the marks at the others' grams are summed up. So no link is lost and no group is cut off.

The result does not depend on the order of rows: a class is a connected component of "alike".

Defined results: a null text is its own class (class_id = doc_id); texts without words are alike
exactly if equal. Rows equal in text share a class whatever their doc_id. class_id is the least
doc_id of the class (null if none has any). Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.components import components
from .common import SpanHasher, blocks, documents, internal, map_arrow, marked, materialize, mix64, rows_of

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
#: What a text's darts count for in the size of a block of texts.
DART_BYTES = 8192
#: A bucket with at most so many texts outside its largest component is compared pair by pair.
LOOSE_TEXTS = 48
#: Any other bucket is compared in blocks of so many texts.
BLOCK_TEXTS = 1024
#: Or, where these are long, of so many bytes (each code point counts as four).
BLOCK_TEXT_BYTES = 8 << 20


def grams(texts: list[str], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word n-gram of the texts, in order."""
    joined = [" ".join(t.lower().split()).encode() for t in texts]
    sizes = np.array([len(b) for b in joined], np.int64)
    data = np.frombuffer(b" ".join(joined) + b" ", np.uint8)
    ends = np.cumsum(sizes + 1) - 1  # of texts, at the blank that follows
    begin = ends - sizes
    blank = np.flatnonzero(data == 32)
    owner = np.searchsorted(ends, blank)  # the text whose word ends at this blank
    real = sizes[owner] > 0
    end, owner = blank[real], owner[real]
    count = np.bincount(owner, minlength=len(texts))
    before = np.cumsum(count) - count
    place = np.arange(len(end)) - before[owner]
    start = np.empty_like(end)
    start[1:] = end[:-1] + 1
    start[place == 0] = begin[owner[place == 0]]
    last = np.minimum(n, count[owner])
    full = np.flatnonzero(place + last <= count[owner])
    hasher = SpanHasher(data, 2)
    return owner[full], mix64(hasher.spans(start[full], end[full + last[full] - 1]))


def _occurrences(owner: np.ndarray, element: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, element) and how often each occurs."""
    order = np.lexsort((element, owner))
    owner, element = owner[order], element[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (element[1:] != element[:-1])
    first = np.flatnonzero(new)
    return owner[first], element[first], np.diff(np.append(first, len(owner)))


#: Cumulative chances of a Poisson(1) count, as 64-bit thresholds.
_POISSON = (np.cumsum(np.exp(-1) / np.cumprod(np.concatenate([[1.0], np.arange(1, 16)]))) * 2.0**53).astype(np.uint64)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """n x k earliest darts of n weighted sets, given as rows (owner, element, weight > 0).

    Every owner must have an element.
    """
    out = np.zeros((n, k), np.uint64)
    todo = np.arange(n)
    total = np.bincount(owner, weights=weight, minlength=n)
    limit = (k * np.log(k) + 2 * k) / total
    while len(todo):
        mine = np.isin(owner, todo) if len(todo) < n else slice(None)
        own, el, wt = owner[mine], element[mine], weight[mine]
        # Unit cells of each element's region: layers of weight times steps of rank.
        layers, steps = np.ceil(wt).astype(np.int64), np.ceil(limit[own]).astype(np.int64)
        cells = layers * steps
        row = np.repeat(np.arange(len(own)), cells)
        index = np.arange(len(row)) - np.repeat(np.cumsum(cells) - cells, cells)
        layer, step = index // steps[row], index % steps[row]
        cell = mix64(mix64(el[row] + layer.astype(np.uint64) * np.uint64(0x100000001B3)) + step.astype(np.uint64), 5)
        darts = np.searchsorted(_POISSON, cell >> np.uint64(11), side="right")
        pick = np.repeat(np.arange(len(row)), darts)
        nth = np.arange(len(pick)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix64(cell[pick] + nth.astype(np.uint64), 6)
        rank = step[pick] + _unit(mix64(dart, 7))
        height = layer[pick] + _unit(mix64(dart, 8))
        who = own[row[pick]]
        caught = (rank < limit[who]) & (height < wt[row[pick]])
        who, dart, rank = who[caught], dart[caught], rank[caught]
        slot = who * k + (mix64(dart, 9) % np.uint64(k)).astype(np.int64)
        order = np.lexsort((dart, rank, slot))
        slot, dart = slot[order], dart[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        out.ravel()[slot[first]] = dart[first]
        filled = np.bincount(slot[first] // k, minlength=n)
        todo = todo[filled[todo] < k]
        limit[todo] *= 2
    return out


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    n, k = signature.shape
    parts = signature.reshape(n, k // rows, rows)
    key = np.broadcast_to(np.arange(k // rows, dtype=np.uint64), (n, k // rows)).copy()
    for i in range(rows):
        key = mix64(key ^ parts[:, :, i], 10 + i)
    return key


BAND_ROWS = "doc_id long, t1 long, t2 long, bytes long, bands array<long>"


def _band_batches(n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # However short, a text costs as many darts as one of some thousand bytes.
        for block in blocks(rows_of(batches, "doc_id", "t1", "t2", "text"), lambda r: len(r[3]) + DART_BYTES, 1 << 20):
            owner, element = grams([r[3] for r in block], n)
            have = np.unique(owner)
            number = np.searchsorted(have, owner)
            bands = np.zeros((0, BANDS), np.int64)
            if len(have):
                own, el, count = _occurrences(number, element)
                bands = band_keys(signatures(own, el, count.astype(np.float64), len(have))).view(np.int64)
            lists: list = [[]] * len(block)
            for i, keys in zip(have.tolist(), bands.tolist(), strict=True):
                lists[i] = keys
            sizes = [4 * len(r[3]) for r in block]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in block], pa.int64()) for i in range(3)), pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "t1", "t2", "bytes", "bands"])

    return run


class Multisets:
    """Sorted (hash, occurrence) keys of texts, so that similarities are intersections."""

    def __init__(self, texts: list[str], n: int = WORDS):
        owner, element = grams(texts, n)
        own, el, count = _occurrences(owner, element)
        row = np.repeat(np.arange(len(own)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        keys = mix64(el[row] + nth.astype(np.uint64), 20)
        number = own[row]
        order = np.lexsort((keys, number))
        keys, number = keys[order], number[order]
        cuts = np.searchsorted(number, np.arange(len(texts) + 1))
        self.keys = [keys[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def alike(self, i: int, j: int, least: float) -> bool:
        a, b = self.keys[i], self.keys[j]
        if min(len(a), len(b)) < least * max(len(a), len(b)) or not len(a):
            return False
        if len(a) > len(b):
            a, b = b, a
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        both = int(np.count_nonzero(b[at] == a))
        return both >= least * (len(a) + len(b) - both) - 1e-9


def _verified(least: float, n: int):
    """Pairs (a, b, text_a, text_b) that are alike."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(rows_of(batches, "a", "b", "text_a", "text_b", step=128), lambda r: len(r[2]) + len(r[3])):
            places: dict[int, int] = {}
            texts = []
            for a, b, text_a, text_b in block:
                for node, text in ((a, text_a), (b, text_b)):
                    if node not in places:
                        places[node] = len(texts)
                        texts.append(text)
            sets = Multisets(texts, n)
            good = [(r[0], r[1]) for r in block if sets.alike(places[r[0]], places[r[1]], least)]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in good], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def spanning(sets: Multisets, labels: np.ndarray, meetings: list[tuple[np.ndarray, np.ndarray]], least: float) -> list[tuple[int, int]]:
    """Links that join what is alike across labels: of each meeting (some, others), all of some with all of others.

    Links inside of what the labels or earlier links join are left out.
    """
    size = np.array([len(k) for k in sets.keys])
    element = np.split(np.unique(np.concatenate(sets.keys), return_inverse=True)[1], np.cumsum(size)[:-1])
    label = labels.copy()
    mark = np.zeros(max((int(e.max()) for e in element if len(e)), default=0) + 1, np.int32)
    links = []
    for some, others in meetings:
        others = others[size[others] > 0]
        if not len(others):
            continue
        others = others[np.argsort(size[others], kind="stable")]
        many = size[others]
        end = np.cumsum(many)
        start = end - many
        flat = np.concatenate([element[j] for j in others])
        for i in some:
            # Only texts of like size can be alike.
            lo, hi = np.searchsorted(many, least * size[i] - 1e-6), np.searchsorted(many, size[i] / least + 1e-6, side="right")
            if lo >= hi or (label[others[lo:hi]] == label[i]).all():
                continue
            mark[element[i]] = 1
            both = np.add.reduceat(mark[flat[start[lo] : end[hi - 1]]], start[lo:hi] - start[lo])
            mark[element[i]] = 0
            near = others[lo:hi][both >= least * (size[i] + many[lo:hi] - both) - 1e-9]
            for j in near[label[near] != label[i]]:
                if label[j] != label[i]:
                    links.append((int(i), int(j)))
                    label[label == label[j]] = label[i]
    return links


def _forests(least: float, n: int):
    """A spanning forest of the links between two blocks of texts of one bucket, or inside of one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for low, high, members in rows_of(batches, "low", "high", "members", step=1):
            members = sorted({m["node"]: m for m in members}.values(), key=lambda m: m["node"])
            labels, count = np.unique([m["root"] for m in members], return_inverse=True, return_counts=True)[1:]
            first = np.array([m["part"] == low for m in members])
            main = labels == np.argmax(count)
            if low == high:
                meetings = [(np.flatnonzero(~main), np.arange(len(members)))]
            else:
                meetings = [(np.flatnonzero(first & ~main), np.flatnonzero(~first)), (np.flatnonzero(~first & ~main), np.flatnonzero(first & main))]
            links = spanning(Multisets([m["text"] for m in members], n), labels, meetings, least)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([members[x[i]]["node"] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def near_classes(docs: DataFrame, n: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, n_copies, first) of every row of docs; first: the row that stands for its
    class, exactly one row of each class that has equal doc_id and text."""
    keyed = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")
    rows = materialize(map_arrow(keyed, _band_batches(n), BAND_ROWS), "near-bands")
    # Exact copies are one node from here on; rows without a doc_id stand for it last.
    each = rows.groupBy("t1", "t2", "doc_id").agg(F.count(F.lit(1)).alias("twins"))
    nodes = each.groupBy("t1", "t2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "twins")).alias("h"), F.sum("twins").alias("copies"))
    nodes = materialize(nodes.select("t1", "t2", F.col("h.doc_id").alias("head"), F.col("h.twins").alias("twins"), "copies", F.monotonically_increasing_id().alias("node")), "near-nodes")
    of_node = rows.join(nodes, ["t1", "t2"]).filter(F.col("doc_id").eqNullSafe(F.col("head")))
    banded = materialize(of_node.select("node", "bytes", "bands").distinct(), "near-places")
    places = banded.select("node", "bytes", F.explode("bands").alias("band"))

    # A band's first text is a minimum with partial results, and only bands of several texts are met:
    # the join is of two written tables, which adaptive execution splits where a band is hot.
    centers = places.groupBy("band").agg(F.min("node").alias("center"), F.max("node").alias("other")).filter("center != other").select("band", "center")
    centers = materialize(centers, "near-centers")
    stars = materialize(places.select("band", "node").join(centers, "band").filter("node != center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct(), "near-stars")

    def texts_of(wanted: DataFrame) -> DataFrame:
        """(node, text) of the wanted nodes: texts are read again rather than carried along."""
        ids = materialize(nodes.join(wanted, "node").select("node", "t1", F.col("head").alias("_head"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2")), "near-ids")
        found = marked(keyed, "t1", ids.select("t1")).filter("maybe").join(ids.drop("t1"), F.col("doc_id").eqNullSafe(F.col("_head")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2"))).select("node", "text")
        return materialize(found, "near-texts")

    def proved(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        sides = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        return materialize(map_arrow(sides, _verified(least, n), "a long, b long").distinct(), "near-links")

    wanted = materialize(stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).distinct(), "near-wanted")
    texts = texts_of(wanted)
    links = proved(stars, texts)
    roots = materialize(components(links), "near-roots")

    # Buckets that still hold several components, and their members.
    labelled = places.join(wanted, "node").join(roots, "node", "left").select("band", "node", "bytes", F.coalesce("root", "node").alias("root"))
    labelled = materialize(labelled, "near-labelled")
    held = labelled.groupBy("band", "root").agg(F.count(F.lit(1)).alias("held"), F.sum("bytes").alias("bytes")).groupBy("band")
    mixed = held.agg(F.sum("held").alias("size"), F.sum("bytes").alias("all_bytes"), F.max(F.struct("held", "root")).alias("most"), F.count(F.lit(1)).alias("roots"))
    mixed = mixed.filter("roots > 1 and size > 2").select("band", "size", "all_bytes", F.col("most.root").alias("main"), (F.col("size") - F.col("most.held")).alias("outside"))
    members = materialize(labelled.join(materialize(mixed, "near-mixed"), "band"), "near-members")
    small = members.filter(F.col("outside") <= LOOSE_TEXTS)
    # A pair is made once: in the first band that both texts have, and from one side.
    small = materialize(small.join(banded.select("node", "bands"), "node").select("band", "node", "root", "main", "bands"), "near-small")
    loose = small.filter("root != main").select(F.col("band").alias("_band"), F.col("node").alias("x"), F.col("root").alias("root_x"), F.col("bands").alias("bands_x"))
    once = (F.element_at(F.array_intersect("bands_x", "bands"), 1) == F.col("band")) & ((F.col("root") == F.col("main")) | (F.col("x") < F.col("node")))
    pairs = loose.join(small, (F.col("_band") == F.col("band")) & (F.col("root") != F.col("root_x")) & once)
    pairs = pairs.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b"))
    pairs = materialize(pairs.join(stars, ["a", "b"], "left_anti"), "near-pairs")
    # What is linked so far is known by its roots: only new links can need further rounds.
    links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(proved(pairs, texts))

    # Larger buckets: blocks of texts, every pair of blocks a row, its texts fetched by node. A block is
    # bounded by texts and by bytes (but for a single longer text).
    large = members.filter(F.col("outside") > LOOSE_TEXTS)
    parts = F.greatest(F.ceil(F.col("size") / BLOCK_TEXTS), F.ceil(F.col("all_bytes") / BLOCK_TEXT_BYTES)).cast("int")
    dealt = large.select("band", "node", "root", parts.alias("parts"), F.pmod(F.xxhash64("node", "band"), parts).cast("int").alias("part"))
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("part")).alias("low"), F.greatest(p, F.col("part")).alias("high")))
    spread = dealt.select("band", "node", "root", "part", F.explode(meets).alias("m")).join(texts, "node")
    groups = spread.groupBy("band", "m").agg(F.collect_list(F.struct("node", "root", "part", "text")).alias("members"))
    links = links.unionByName(map_arrow(groups.select("m.low", "m.high", "members"), _forests(least, n), "a long, b long"))
    roots = components(links)

    heads = materialize(nodes.join(roots, "node", "left").select("t1", "t2", "head", "twins", "copies", F.coalesce("root", "node").alias("root")), "near-heads")
    standing = F.struct(F.col("head").isNull().alias("none"), "head", "t1", "t2")
    classes = materialize(heads.groupBy("root").agg(F.min("head").alias("class_id"), F.min(standing).alias("standing")), "near-classes")
    told = heads.join(classes, "root").select("t1", "t2", "class_id", "copies", "twins", "head", standing.eqNullSafe(F.col("standing")).alias("stands"))
    told = materialize(told, "near-told")
    out = rows.join(told, ["t1", "t2"]).select("doc_id", "class_id", F.col("copies").alias("n_copies"), (F.col("stands") & F.col("doc_id").eqNullSafe(F.col("head"))).alias("first"), "twins", "t1", "t2")
    nothing = F.lit(None).cast("bigint")
    alone = docs.filter(F.col("text").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("n_copies"), F.lit(True).alias("first"), F.lit(1).cast("bigint").alias("twins"), nothing.alias("t1"), nothing.alias("t2"))
    return out.unionByName(alone)


def one_of_each(docs: DataFrame, n: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """docs without near duplicates: of each class the document of least doc_id stays, once."""
    told = materialize(near_classes(docs, n, least).filter(F.col("t1").isNotNull() & (~F.col("first") | (F.col("twins") > 1))), "near-rows")
    # The rows that go, and those that stand several times: the others are never shuffled.
    special = told.groupBy("doc_id", "t1", "t2").agg(F.max("first").alias("_first")).withColumnsRenamed({"doc_id": "_id", "t1": "_t1", "t2": "_t2"})
    special = materialize(special, "near-special")
    columns = docs.columns
    docs, _ = internal(docs, "doc_id", "text")
    keyed = docs.withColumn("_h1", F.xxhash64("text")).withColumn("_h2", F.xxhash64(F.lit(1), "text"))
    seen = marked(keyed, "_h1", special.select(F.col("_t1").alias("_h1")))
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h1") == F.col("_t1")) & (F.col("_h2") == F.col("_t2"))
    other = seen.filter(F.col("maybe") & F.col("text").isNotNull())
    out = seen.filter(~F.col("maybe") | F.col("text").isNull()).select(*docs.columns).unionByName(other.join(special, on, "left_anti").select(*docs.columns))
    if not special.filter("_first").isEmpty():
        once = other.join(special.filter("_first"), on, "left_semi").dropDuplicates(["doc_id", "_h1", "_h2"])
        out = out.unionByName(once.select(*docs.columns))
    return out.toDF(*columns)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir)).select("doc_id", "class_id", "n_copies", "first")


#: Every pair of texts that share a gram, compared exactly; doc_ids are taken as unique.
OP2_SQL = r"""
WITH RECURSIVE
texts AS (SELECT text, min(doc_id) AS id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text),
worded AS (SELECT id, list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '') AS w FROM texts),
grams AS (
  SELECT id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS gram
  FROM worded WHERE len(w) > 0),
weighted AS (SELECT id, gram, count(*) AS c FROM grams GROUP BY id, gram),
totals AS (SELECT id, sum(c) AS n FROM weighted GROUP BY id),
shared AS (
  SELECT a.id AS a, b.id AS b, sum(least(a.c, b.c)) AS i
  FROM weighted a JOIN weighted b ON a.gram = b.gram AND a.id < b.id GROUP BY a.id, b.id),
alike AS (
  SELECT s.a, s.b FROM shared s JOIN totals x ON x.id = s.a JOIN totals y ON y.id = s.b
  WHERE s.i >= 0.8 * (x.n + y.n - s.i) - 1e-9),
links AS (SELECT a AS u, b AS v FROM alike UNION ALL SELECT b, a FROM alike),
reach(u, v) AS (SELECT id, id FROM texts UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
classes AS (SELECT u AS id, min(v) AS class_id FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(t.copies, 1) AS n_copies, coalesce(c.class_id, d.doc_id) = d.doc_id AS first
FROM documents d LEFT JOIN texts t ON t.text = d.text LEFT JOIN classes c ON c.id = t.id
"""

QUERIES = {"op2_near_dedup": op2_near_dedup}
ORACLES = {"op2_near_dedup": OP2_SQL}
