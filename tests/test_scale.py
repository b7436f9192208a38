"""Plans that must hold at scale: candidates, clusters, running sums, streams, changes of many tags."""

from __future__ import annotations

import io
import random

import pytest
from pyspark.sql import functions as F

from quillmark.functions.hashing import CHUNK, blake3, blake3_stream
from quillmark.operators import annotate, cache, collections, dedup, query
from quillmark.operators.query import Query
from quillmark.plans import components, hamming, ranking
from quillmark.sources.schema import SCHEMAS
from quillmark.streaming import oplog

from .catalogs import files, pairs, record, tagged


def _hashes(spark, n, seed=1, near=True):
    rng = random.Random(seed)
    values = {rng.getrandbits(64) - (1 << 63) for _ in range(n)}
    for v in list(values)[: n // 10 if near else 0]:  # neighbours at every distance up to 10
        changed = v + (1 << 63)
        for bit in rng.sample(range(64), rng.randint(1, 10)):
            changed ^= 1 << bit
        values.add(changed - (1 << 63))
    return sorted(values), spark.createDataFrame([(v,) for v in values], "hash long")


@pytest.mark.parametrize("most", [0, 1, 8])
def test_pairs_do_not_depend_on_the_bands(spark, most):
    values, df = _hashes(spark, 300)
    want = sorted(((a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= most), key=repr)
    assert want or not most
    for n in {1, 3, most + 1} if most == 8 else {most + 1}:
        if all(hamming.probes(w, r) <= 50_000 and r <= 2 for _, w, r in hamming.bands(most, n)):
            assert pairs(hamming.close_pairs(df, most, n), "a", "b") == want
    assert pairs(hamming.close_pairs(df, most), "a", "b") == want


def test_wide_bands_let_through_a_hundredth(spark):
    """At equal pairs: counted for 3,000 hashes, and by the formula that chooses the bands."""
    _, df = _hashes(spark, 3000, 2, near=False)
    narrow, wide = hamming.bands(8, 9), hamming.bands(8, 3)
    counted = [hamming.candidates(df, b).filter("a != b").count() for b in (narrow, wide)]
    assert counted[0] > 100 * counted[1] > 0
    rows = 10**8
    best = hamming.best_bands(8, rows)
    assert hamming.expected_candidates(rows, narrow) > 100 * hamming.expected_candidates(rows, best)
    assert all(hamming.probes(w, r) <= hamming.MAX_PROBES for _, w, r in best)
    assert len(hamming.best_bands(8, 100)) == 9


def test_radii_cover_the_distance():
    for most in range(64):
        for n in range(1, most + 2):
            found = hamming.bands(most, n)
            assert sum(w for _, w, _ in found) == 64
            assert sum(r + 1 for *_, r in found) == most + 1 and min(r for *_, r in found) >= 0


def test_clusters_need_no_window_by_label(spark):
    catalog = files(spark, *[record(f"/a/{i:03}", "same", size=i % 7) for i in range(50)], record("/b", "one"))
    found = dedup.exact_duplicates(catalog)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = found.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 51))
    assert [(r["size"], r["path"]) for r in rows] == sorted(((i % 7, f"/a/{i:03}") for i in range(50)), key=lambda x: (-x[0], x[1]))
    assert {(r["cluster_id"], r["members"]) for r in rows} == {("/a/006", 50)}


def test_running_total_and_ranks(spark):
    df = spark.range(1000).select("id", (F.col("id") % 5).alias("v"))
    got = {r["id"]: r["total"] for r in ranking.running_total(df, "v", F.desc("id")).collect()}
    total = 0
    for i in reversed(range(1000)):
        total += i % 5
        assert got[i] == total
    assert ranking.ranked_top(df, 20_000, F.desc("id")).count() == 1000
    assert pairs(ranking.ranked_top(df, 2, F.desc("id")), "id", "rank") == [(998, 2), (999, 1)]
    assert ranking.running_total(df.limit(0), "v", F.col("id")).count() == 0


def test_one_moment_may_hold_every_entry(spark):
    entries = spark.range(500).select(F.col("id").alias("ord"), F.lit(10).cast("bigint").alias("size"), F.lit(7).cast("bigint").alias("last_used"))
    assert sorted(r["ord"] for r in cache.evictions(entries, 100).collect()) == list(range(490))


def test_private_cache(spark):
    rows = [("/c/normal/a.png", 600_000, 5), ("/c/large/b.png", 600_000, 6), ("/c/other/c.png", 9, 1), ("/c/normal/d.txt", 9, 1), ("/c/normal/deep/e.png", 9, 1)]
    listing = spark.createDataFrame(rows, "path string, size long, mtime long")
    assert pairs(cache.private_evictions(listing, 1), "path") == [("/c/normal/a.png",)]
    assert pairs(cache.private_evictions(listing, 0), "path") == [("/c/large/b.png",), ("/c/normal/a.png",)]


def test_smart_counts_take_one_scan(spark):
    catalog = tagged(files(spark, record("/a", "A", camera="X"), record("/b", "B"), record("/c", "C", missing=True)), Beach=["A", "B", "C"], **{"É": ["A"]})
    catalog = annotate.set_rating(catalog, "A", 4)
    for i, q in enumerate([Query(tags_any=["beach"]), Query(tags_any=["beach"], limit=1), Query(tags_all=["BEACH", "É"]), Query(rating_min=3), Query(camera="X"), Query(), Query(tags_any=["none"]), Query(tags_all=["É", "é"]), Query(under="/a")]):
        catalog = annotate.create_smart_collection(catalog, f"s{i}", q)
    found = collections.list_collections(catalog)
    assert [r["n"] for r in found.orderBy("id").collect()] == [2, 1, 1, 1, 1, 2, 0, 1, 0]
    for r in found.collect():
        assert r["n"] == collections.collection_files(catalog, r["id"]).count()


def test_many_tags_change_in_one_pass(spark):
    catalog = tagged(files(spark, record("/a", "A")), Beach=["A"])
    rows = [(i, f"h{i % 3}", "tag", f" t{i % 40} ") for i in range(200)] + [(900, "A", "untag", "BEACH"), (901, "A", "untag", "never"), (902, "h0", "tag", "T0"), (903, "h0", "untag", "t0")]
    ops = spark.createDataFrame([(s, op, h, v) for s, h, op, v in rows], oplog.OPS)
    after = oplog.apply_ops(catalog, ops)
    names = sorted(r["name"] for r in after.tags.collect())
    assert names == sorted(["Beach", *[f"t{i}" for i in range(40)]])
    held = set(pairs(after.file_tags.join(after.tags, F.col("tag_id") == F.col("id")), "content_hash", "name"))
    assert held == {(f"h{i % 3}", f"t{i % 40}") for i in range(200)} - {("h0", "t0")}


def test_reachable_and_pending(spark):
    catalog = annotate.set_rating(files(spark, record("/a", "A"), record("/b", "B")), "B", 3)
    catalog = annotate.create_smart_collection(catalog, "all", Query(sort="Name", direction="Desc"))
    there = spark.createDataFrame([("/b",), ("/b",)], "path string")
    assert [tuple(r) for r in collections.open_collection(catalog, 1, there).collect()] == [("/b", "B", 3)]
    assert [r["path"] for r in collections.open_collection(catalog, 1).collect()] == ["/b", "/a"]
    items = spark.createDataFrame([("/a", "old", 9), ("/b", "", 9)], "path string, content_hash string, rating long")
    items = items.withColumns({"orientation": F.lit(1).cast("bigint"), "crop": F.lit(None).cast("struct<x:double,y:double,w:double,h:double>"), "date_taken": F.lit(None).cast("bigint")})
    assert pairs(query.stamped_pending(items, catalog, "/"), "path", "content_hash", "rating") == [("/a", "old", 9), ("/b", "B", 3)]


@pytest.mark.parametrize("size", [0, 1, CHUNK, 4 * CHUNK, 4 * CHUNK + 1, 8 * CHUNK, 8 * CHUNK + 5, 12 * CHUNK, 21 * CHUNK - 1, 64 * CHUNK])
def test_blake3_streams(size):
    data = random.Random(size).randbytes(size)
    assert blake3_stream(io.BytesIO(data), 4) == blake3(data)


def test_clusters_need_a_shared_folder():
    class Conf:
        def get(self, key):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        components.shared_folder(Session())


def test_enrichment_drains(spark, tmp_path):
    from quillmark.sources.catalog import Store

    for i in range(5):
        (tmp_path / f"{i}.gif").write_bytes(b"GIF89a" + bytes([i + 1, 0, 2, 0]))
    records = [record(str(tmp_path / f"{i}.gif"), f"h{i}") for i in range(6)]  # the last one is not there
    store = Store(spark, str(tmp_path / "store"))
    store.commit(files(spark, *records))
    assert oplog.run_enrichment(store, size=4) == 6
    after = store.open()
    assert oplog.run_enrichment(store) == 0
    assert [tuple(r) for r in after.files.orderBy("path").select("width", "height").collect()] == [*((i + 1, 2) for i in range(5)), (0, 0)]
    assert after.files.schema == SCHEMAS["files"]


def test_accepted_operations(spark, tmp_path):
    ops = spark.createDataFrame([(1, "rate", "A", "3")], oplog.OPS)
    assert oplog.accepted(str(tmp_path / "ops"), ops) == 1
    assert spark.read.parquet(str(tmp_path / "ops")).count() == 1
