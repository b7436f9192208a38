"""Commits write what changed: segments of the tables that a transition touched, and nothing else."""

from __future__ import annotations

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from quillmark.operators import annotate
from quillmark.sources import segments
from quillmark.sources.catalog import CommitConflict, Store, empty, from_testdata
from quillmark.sources.schema import SCHEMAS, conform
from quillmark.sources.segments import Segment

from .catalogs import files, record


def sizes(root) -> dict[str, int]:
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f.endswith((".parquet", ".json"))}


def big(spark, n: int):
    ids = spark.range(n)
    rows = ids.select((F.col("id") + 1).alias("id"), F.format_string("/lib/%08d.jpg", "id").alias("path"), F.md5(F.col("id").cast("string")).alias("content_hash"), F.lit(1).alias("size"), F.lit(1).alias("mtime"), F.lit(1).alias("indexed_at"))
    rated = ids.select(F.md5(F.col("id").cast("string")).alias("content_hash"), (F.col("id") % 5 + 1).alias("rating"))
    return empty(spark).with_tables(files=conform(rows, "files"), ratings=conform(rated, "ratings"))


def test_one_rating_writes_one_segment_of_one_table(spark, tmp_path):
    store = Store(spark, str(tmp_path), per_file=20_000)
    first = store.commit(big(spark, 1_000_000))
    before = sizes(tmp_path)
    target = first.ratings.first()["content_hash"]
    second = store.commit(annotate.set_rating(first, target, 3))
    new = {p: n for p, n in sizes(tmp_path).items() if p not in before}
    tables = [p for p in new if p.endswith(".parquet")]
    assert len(tables) == 1 and "/data/ratings/" in tables[0]
    whole = sum(n for p, n in before.items() if p.endswith(".parquet"))
    assert sum(new[p] for p in tables) < whole / 50
    assert sorted(p.split("/")[-2] for p in new if p.endswith(".json")) == ["_log", "ratings"]
    old, now = (store.entry(v)["tables"] for v in (1, 2))
    assert {t for t in SCHEMAS if old[t] != now[t]} == {"ratings"}
    assert second.ratings.count() == 1_000_000 and second.ratings.filter(F.col("content_hash") == target).first()["rating"] == 3
    assert store.open(1).ratings.exceptAll(second.ratings).count() == 1
    # Files that lie together are one segment's business, whichever transition changes them.
    before = sizes(tmp_path)
    store.commit(annotate.mark_missing(second, spark.range(500_000, 500_100).select(F.format_string("/lib/%08d.jpg", "id").alias("path"))))
    assert 1 <= sum(p.endswith(".parquet") for p in sizes(tmp_path) if p not in before) <= 2


def test_only_touched_segments_are_read(spark, tmp_path):
    store = Store(spark, str(tmp_path), per_file=1000)
    c = store.commit(big(spark, 20_000))
    listed = store.manifest(store.entry(1)["tables"]["files"])
    run = (3, 3)
    for after in (annotate.mark_missing(c, spark.createDataFrame([("/lib/00003500.jpg",)], "path string")), annotate.upsert_files(c, c.files.filter("path = '/lib/00003500.jpg'"))):
        plan = after.files.filter(segments.owned(listed, run, F.col("path")))._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.split("\n") if "FileScan parquet" in line and "PushedFilters" in line]
        assert scans and all("GreaterThanOrEqual(path" in line or "EqualTo(path" in line for line in scans)


def state(c) -> dict:
    return {t: sorted(map(repr, map(tuple, c.table(t).collect()))) for t in SCHEMAS}


@pytest.mark.parametrize("seed", range(2))
def test_random_commits_equal_whole_rewrites(spark, tmp_path, seed):
    """The same transitions on a store of small segments and in memory."""
    rng = random.Random(seed)
    hashes = [f"h{i:03d}" for i in range(60)]
    plain = files(spark, *[record(f"/p/{i:03d}", hashes[i % 60]) for i in range(90)])
    store = Store(spark, str(tmp_path), per_file=7)
    kept = store.commit(plain)
    some = lambda n: rng.sample(hashes, n)
    for step in range(5):
        chosen, value, path = some(rng.choice([1, 3])), rng.randrange(6), f"/{rng.choice('apz')}/{rng.randrange(120):03d}"
        what = rng.choice(["rate", "tag", "untag", "upsert", "miss", "rekey", "catalog"])

        def change(c):
            if what == "rate":
                return annotate.rate_selection(c, chosen, value, now=step)
            if what == "tag":
                return annotate.apply_tag(c, rng_name, chosen, now=step)
            if what == "untag":
                return annotate.remove_tag(annotate.apply_tag(c, "x", chosen), "x", chosen[:1])
            if what == "upsert":
                return annotate.upsert_files(c, files(spark, record(path, chosen[0])).files)
            if what == "miss":
                return annotate.mark_missing(c, spark.createDataFrame([(path,), ("/p/001",)], "path string"))
            if what == "rekey":
                return annotate.rekey(annotate.set_rating(c, chosen[0], 4), chosen[0], "new" + chosen[-1])
            return annotate.add_to_catalog(annotate.create_catalog(c, f"c{step}"), 1, chosen)

        rng_name = rng.choice(["a", "B", "b"])
        plain, kept = change(plain), store.commit(change(kept))
        assert state(kept) == state(plain), what
        for table, path_of in store.entry(kept.version)["tables"].items():
            found = store.manifest(path_of)
            assert all(a.high < b.low for a, b in zip(found, found[1:])), table
            assert sum(s.rows for s in found) == kept.table(table).count()
    with pytest.raises(CommitConflict):
        store.commit(annotate.set_rating(store.open(kept.version - 1), "h1", 1))


def test_null_and_equal_keys(spark, tmp_path):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 1), ("k", 1), ("k", 2), ("k", 3), ("k", 4), ("z", 1)], "content_hash string, tag_id long").transform(lambda d: conform(d, "file_tags"))
    found = segments.write(rows, "content_hash", "t", str(tmp_path), per_file=2)
    assert sum(s.rows for s in found) == 8 and all(a.high < b.low for a, b in zip(found, found[1:]))
    assert segments.read(spark, found, SCHEMAS["file_tags"], str(tmp_path)).count() == 8
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "content_hash string")
    assert 0 in segments.touched(found, keys(None)) and segments.touched(found, keys()) == []
    new = rows.filter("content_hash <=> 'k' OR content_hash IS NULL")
    after = segments.rewrite(found, new, "content_hash", keys("a", "z"), str(tmp_path), "t", 2)
    left = segments.read(spark, after, SCHEMAS["file_tags"], str(tmp_path))
    assert sorted((r.content_hash or "", r.tag_id) for r in left.collect()) == [("", 1), ("", 2), ("k", 1), ("k", 2), ("k", 3), ("k", 4)]
    assert segments.rewrite([], rows, "content_hash", keys("a"), str(tmp_path), "t", 100)[0].rows == 8


def test_owned_segments_partition_all_keys(spark):
    listed = [Segment("f", [], low, None, 1) for low in (None, "b", "m", "é")]
    keys = spark.createDataFrame([(k,) for k in (None, "", "a", "b", "bb", "m", "z", "é", "éa", "\U0001f600")], "k string")
    for row in keys.select(*[segments.owned(listed, (i, i), F.col("k")).alias(str(i)) for i in range(4)], *[segments.owned(listed, (0, 1), F.col("k")).alias("r")]).collect():
        assert sum(bool(row[str(i)]) for i in range(4)) == 1 and bool(row["r"]) == bool(row["0"] or row["1"])
    for r in keys.collect():
        (own,) = segments.touched(listed, keys.filter(F.col("k").eqNullSafe(F.lit(r.k))))
        assert keys.filter(F.col("k").eqNullSafe(F.lit(r.k))).filter(segments.owned(listed, (own, own), F.col("k"))).count() == 1


def test_versions_of_whole_folders_are_still_read(spark, tmp_path):
    import json

    c = files(spark, record("/a", "A"))
    (tmp_path / "_log").mkdir()
    for name in SCHEMAS:
        c.table(name).write.parquet(f"{tmp_path}/data/old/{name}")
    (tmp_path / "_log" / "1.json").write_text(json.dumps({"schema": 5, "tables": {n: f"data/old/{n}" for n in SCHEMAS}}))
    store = Store(spark, str(tmp_path))
    after = store.commit(annotate.set_rating(store.open(), "A", 2))
    assert after.version == 2 and after.files.count() == 1 and after.ratings.first()["rating"] == 2


def test_tables_of_a_commit_are_written_side_by_side(spark, tmp_path, monkeypatch):
    """Two writes meet before either goes on; a table that fails leaves no version behind."""
    meet, write = threading.Barrier(2), segments.write
    monkeypatch.setattr(segments, "write", lambda *a: (meet.wait(60), write(*a))[1])
    store = Store(spark, str(tmp_path / "two"))
    assert store.commit(empty(spark)).version == 1

    def fails(rows, key, folder, *rest):
        if "ratings" in folder:
            raise OSError("full")
        return write(rows, key, folder, *rest)

    monkeypatch.setattr(segments, "write", fails)
    store = Store(spark, str(tmp_path / "none"))
    with pytest.raises(OSError, match="full"):
        store.commit(empty(spark))
    assert store.versions() == []


def test_texts_are_hashed_once_for_stores(spark):
    """A store's tables come from a written table of hashes, not from the texts again and again."""
    sf_dir = "/root/testdata/sf0.001"
    once, plain = from_testdata(spark, sf_dir, once=True), from_testdata(spark, sf_dir)
    for name in ("files", "file_tags", "ratings", "crops", "collection_items"):
        plan = once.table(name)._jdf.queryExecution().optimizedPlan().toString()
        assert "md5(cast(text" not in plan and "md5(cast(text" in plain.table(name)._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(str, once.table(name).collect())) == sorted(map(str, plain.table(name).collect()))
