from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillmark.functions import columns as fn
from quillmark.operators import annotate, collections, dedup, query
from quillmark.operators.query import Query

from .catalogs import files, pairs, paths, record, tagged


def values(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_ratings_are_clamped_and_cleared(spark):
    c = files(spark)
    for rating, want in ((4, [("H", 4)]), (2, [("H", 2)]), (99, [("H", 5)]), (-3, [("H", 0)]), (None, [])):
        c = annotate.set_rating(c, "H", rating)
        assert pairs(c.ratings, "content_hash", "rating") == want
    c = annotate.rate_selection(c, ["A", "", "B", "A"], 3)
    assert pairs(annotate.rate_selection(c, ["A"], 0).ratings, "content_hash", "rating") == [("B", 3)]


def test_comments_orientations_crops(spark):
    c = annotate.set_comment(files(spark), "H", "  golden hour \n")
    assert pairs(c.comments, "content_hash", "body") == [("H", "golden hour")]
    assert annotate.set_comment(c, "H", " \t ").comments.count() == 0
    c = annotate.set_orientation(c, "H", 11)
    assert pairs(c.orientations, "orientation") == [(8,)]
    assert annotate.set_orientation(c, "H", 1).orientations.count() == 0
    c = annotate.set_crop(c, "H", (0.0, 0.1, 2.0, -1.0))
    assert pairs(c.crops, "x", "y", "w", "h") == [(0.0, 0.1, 2.0, -1.0)]
    assert annotate.set_crop(c, "H", None).crops.count() == 0


def test_tags(spark):
    c = tagged(files(spark, record("/a", "A"), record("/b", "B"), record("/b2", "B"), record("/c", "C", missing=True)), Beach=["A", "B", "C"])
    c = annotate.apply_tag(c, " beach ", ["A", "D"])
    assert pairs(c.tags, "id", "name") == [(1, "Beach")] and c.file_tags.count() == 4
    c = annotate.apply_tag(c, "été", ["A"])
    assert c.tags.count() == 2 and annotate.ensure_tags(c, ["ÉTÉ", "été", "x"]).tags.count() == 4
    assert pairs(query.tag_cloud(c), "name", "n") == [("Beach", 2), ("été", 1)]
    assert pairs(query.hashes_with_tag(c, " BEACH "), "content_hash") == [("A",), ("B",), ("C",), ("D",)]
    renamed = annotate.rename_tag(c, "beach", " BEACH ")
    assert pairs(renamed.tags, "name") == [("BEACH",), ("été",)]
    with pytest.raises(annotate.UniqueViolation):
        annotate.rename_tag(c, "beach", "été")
    assert annotate.rename_tag(c, "absent", "y").tags.count() == 2
    assert annotate.remove_tag(c, "absent", ["A"]).file_tags.count() == 5
    assert pairs(annotate.remove_tag(c, " BEACH", ["A", "B"]).file_tags, "content_hash", "tag_id") == [("A", 2), ("C", 1), ("D", 1)]
    gone = annotate.delete_tag(c, "BEACH")
    assert gone.file_tags.count() == 1 and annotate.delete_tag(c, " beach").tags.count() == 2
    many = annotate.apply_tag(c, "bulk", [f"h{i}" for i in range(500)])
    assert many.file_tags.filter("tag_id = 3").count() == 500
    assert [r.name for r in query.tags_for_hash(c, "A").collect()] == ["Beach", "été"]
    assert [r.name for r in query.search_tags(c, "ÉT").collect()] == ["été"] and query.search_tags(c, "").count() == 2


def test_rekey_lets_the_old_content_win(spark):
    c = tagged(files(spark), x=["old", "new"], y=["old"])
    c = annotate.create_catalog(c, "C")
    c = annotate.add_to_catalog(c, 1, ["new", "old"])
    for h, r in (("old", 5), ("new", 1)):
        c = annotate.set_orientation(annotate.set_comment(annotate.set_rating(c, h, r), h, h), h, 3)
    c = annotate.rekey(c, "old", "new")
    assert pairs(c.ratings, "content_hash", "rating") == [("new", 5)] and pairs(c.comments, "body") == [("old",)]
    assert pairs(c.file_tags, "content_hash", "tag_id") == [("new", 1), ("new", 2)]
    assert pairs(c.collection_items, "content_hash", "position") == [("new", 1)]
    assert pairs(c.orientations, "content_hash") == [("new",)]


def test_catalogs(spark):
    c = annotate.create_catalog(files(spark, *[record(f"/f/{h}", h) for h in "ABCD"], record("/run/user/1000/doc/x/A.jpg", "A")), "Trip")
    c = annotate.add_to_catalog(annotate.add_to_catalog(c, 1, ["B", "A", "B"]), 1, ["A", "C"])
    assert pairs(c.collection_items, "content_hash", "position") == [("A", 1), ("B", 0), ("C", 2)]
    assert paths(collections.collection_files(c, 1)) == ["/f/B", "/f/A", "/f/C"]
    c = annotate.set_catalog_order(c, 1, ["C", "B"])
    assert pairs(c.collection_items, "content_hash", "position") == [("A", 1), ("B", 1), ("C", 0)]
    c = annotate.remove_from_catalog(c, 1, ["C"])
    assert pairs(annotate.add_to_catalog(c, 1, ["D"]).collection_items, "content_hash", "position") == [("A", 1), ("B", 1), ("D", 2)]
    c = annotate.create_smart_collection(annotate.set_rating(c, "A", 4), "best", Query(rating_min=4))
    assert paths(collections.collection_files(c, 2)) == ["/f/A", "/run/user/1000/doc/x/A.jpg"]
    assert [(r.name, r.n) for r in collections.list_collections(c).collect()] == [("best", 2), ("Trip", 2)]
    c = annotate.rename_collection(c, 2, "Zoo")
    assert [r.name for r in collections.list_collections(c).collect()] == ["Trip", "Zoo"]
    gone = annotate.delete_collection(c, 1)
    assert gone.collection_items.count() == 0 and pairs(gone.collections, "id") == [(2,)]
    with pytest.raises(LookupError):
        collections.collection_files(c, 99)


def test_upsert_relink_enrich(spark):
    c = files(spark, record("/a", "A", width=4, camera="X"), record("/b", "B", missing=True))
    new = spark.createDataFrame([("/a", "A2", 7, 8, 9), ("/n", "N", 1, 1, 9), ("/m", "M", 1, 1, 9)], "path string, content_hash string, size long, mtime long, indexed_at long").withColumn("id", F.lit(None).cast("long"))
    up = annotate.upsert_files(c, new)
    assert pairs(up.files, "id", "path", "content_hash", "width") == [(1, "/a", "A2", None), (2, "/b", "B", None), (3, "/m", "M", None), (4, "/n", "N", None)]
    moved = annotate.relink_paths(c, spark.createDataFrame([("/b", "/c", 55)], "old string, new string, mtime long"))
    assert pairs(moved.files.filter("path = '/c'"), "id", "content_hash", "mtime", "missing") == [(2, "B", 55, False)]
    with pytest.raises(annotate.UniqueViolation):
        annotate.relink_paths(c, spark.createDataFrame([("/b", "/a", 1)], "old string, new string, mtime long"))
    enriched = spark.createDataFrame([("/b", 1, 0, 0, None, None, None, None), ("/x", 1, 1, 1, None, None, None, None)], "path string, phash long, width long, height long, format string, date_taken long, camera string, orientation long")
    c2 = annotate.set_enrichment(c, enriched)
    assert pairs(c2.files, "path", "width", "camera") == [("/a", 4, "X"), ("/b", 0, None)]
    assert query.paths_needing_enrichment(up, 10).count() == 3


def test_merge_keeps_named_columns(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, v string, t long")
    new = spark.createDataFrame([(2, "B", 9), (3, None, 9)], "k long, v string, t long")
    assert pairs(annotate.merged(old, new, ["k"], keep=["t"]), "k", "v", "t") == [(1, "a", 1), (2, "B", 2), (3, None, 9)]


def test_duplicates(spark):
    portal = "/run/user/1000/doc/abc/"
    c = files(spark, record("/a/1", "D", size=100), record("/a/2", "D", size=300), record("/b/3", "E"), record("/a/3", "E"), record("/u", "U"), record(portal + "u", "U"))
    got = dedup.exact_duplicates(c).orderBy("cluster_id", "rank").collect()
    assert [(r.cluster_id, r.rank, r.path) for r in got] == [("/a/2", 1, "/a/2"), ("/a/2", 2, "/a/1"), ("/a/3", 1, "/a/3"), ("/a/3", 2, "/b/3")]
    assert {r.cluster_id for r in dedup.exact_duplicates(c, "/a").collect()} == {"/a/2"}
    assert tuple(dedup.reclaimable(dedup.exact_duplicates(c)).first()) == (200, 2)
    two = files(spark, record(portal + "x", "P"), record(portal + "y", "P"))
    assert dedup.exact_duplicates(two).count() == 2
    three = files(spark, record("/r1", "P"), record("/r2", "P"), record(portal + "y", "P"))
    assert pairs(dedup.exact_duplicates(three), "path") == [("/r1",), ("/r2",)]


def test_near_duplicates(spark):
    c = files(spark, record("/x0", "h0", phash=0), record("/x1", "h1", phash=1), record("/x255", "h255", phash=255), record("/e1", "E"), record("/e2", "E"))
    assert dedup.near_duplicates(c, 1).select("cluster_id").distinct().count() == 2
    assert dedup.near_duplicates(c, 0).select("cluster_id").distinct().count() == 1
    chain = files(spark, *[record(f"/c{v}", f"h{v}", phash=v) for v in (0b0, 0b11, 0b1111)])
    assert pairs(dedup.near_duplicates(chain, 2), "cluster_id", "members") == [("/c0", 3)] * 3
    shown = dedup.shown_clusters(dedup.near_duplicates(chain, 2), members=2).first()
    assert (shown.members, shown.paths, shown.more) == (3, ["/c0", "/c15"], 1)
    assert paths(collections.durable_paths(files(spark, record("/run/user/1/doc/a/x", "h1"), record("/real", "h1"), record("/run/user/1/doc/b/y", "h2")).files).orderBy("path")) == ["/real", "/run/user/1/doc/b/y"]
    trashed = annotate.trash_others(chain, dedup.near_duplicates(chain, 2), spark.createDataFrame([("/c3",), ("/c0",)], "path string"))
    assert paths(trashed.files.filter("missing")) == ["/c3"]


def test_edit_history():
    h = annotate.EditHistory("a")
    h.commit("b")
    h.commit("c")
    assert (h.undo(), h.undo(), h.undo(), h.redo()) == ("b", "a", "a", "b")
    h.commit("d")
    assert (h.redo(), h.undo()) == ("d", "b")


def test_scalar_functions(spark):
    lit, long = F.lit, lambda x: F.lit(x).cast("long")
    assert list(values(spark, *[fn.exif_seconds(lit(t)) for t in ("1970:01:01 00:00:00", "2001:09:09 01:46:40", "0000:00:00 00:00:00", "garbage", "2021:02:31 99:00:00:7", "2021:13:01 00:00:00", None)])) == [0, 1000000000, None, None, 1614729600 + 99 * 3600, None, None]
    assert list(values(spark, *[fn.camera_label(lit(a).cast("string"), lit(b).cast("string")) for a, b in (("SONY", "ILCE-7M3"), ("NIKON", "Nikon D750"), (None, "M"), ("K", None), (None, None))])) == ["SONY ILCE-7M3", "Nikon D750", "M", "K", None]
    assert list(values(spark, *[fn.bucket_pixels(lit(t)) for t in (96, 128, 129, 256, 400, 1024, 9999)])) == [128, 128, 256, 256, 512, 1024, 1024]
    assert values(spark, fn.cache_key(lit("file:///home/jens/photo/me.png")))[0] == "d40775e596682f2a16d1b834c221c0a2"
    assert list(values(spark, fn.crc32(lit("")), fn.crc32(lit("123456789")))) == [0, 0xCBF43926]
    assert list(values(spark, *[fn.is_portal_document(lit(p)) for p in ("/run/user/1000/doc/a/b", "/run/user//doc/x", "/run/user/x1/doc/a", "/run/user/1000/gvfs/doc", "/home/run/user/1/doc/x")])) == [True, True, False, False, False]
    assert list(values(spark, *[fn.is_image_path(lit(p)) for p in ("/a/b.JPG", "/a/.jpg", "/a/b.txt", "/a.jpg/b", "/a/b.tar.heic")])) == [True, False, False, False, True]
    assert list(values(spark, fn.edit_key(lit(1), lit(None).cast("struct<x:double,y:double,w:double,h:double>")), fn.edit_key(lit(6), F.struct(lit(0.1).alias("x"), lit(0.0).alias("y"), lit(0.5).alias("w"), lit(1.0).alias("h"))))) == ["", "#o6#c0.100,0.000,0.500,1.000"]
    assert list(values(spark, *[fn.scope_display(lit(p), "/home/me") for p in ("/home/me/x", "/run/user/1/doc/id/a/b", "/run/user/1/doc/id", "/srv")])) == ["~/x", "a/b", "/run/user/1/doc/id", "/srv"]
    assert list(values(spark, fn.format_date(long(0)), fn.human_size(long(1)), fn.human_size(long(999)), fn.human_size(long(1234567)), fn.stars(lit(3)), fn.stem(lit("/a/b.c.png")), fn.stem(lit("/a/b")), fn.toggled_star(lit(3), lit(3)))) == ["1970-01-01 00:00", "1 byte", "999 bytes", "1.2 MB", "★★★", "b.c", "b", 0]
    assert list(values(spark, fn.natural_key(lit("IMG_10.jpg")), fn.natural_key(lit("a007b123456789")), fn.natural_key(lit("")))) == ["img_00000010.jpg", "a00000007b123456789", ""]
    assert list(values(spark, fn.xml_escape(lit("a < b & c > \"d\"")), fn.exif_text(lit("\0 X \0\0")), fn.exif_text(lit(" \0")), fn.default_bookmark_name(lit("/a/b/")), fn.default_bookmark_name(lit("/")), fn.sidecar_path(lit("/p.jpg")))) == ['a &lt; b &amp; c &gt; "d"', "X", None, "b", "/", "/p.jpg.xmp"]
    states = spark.createDataFrame([(s,) for s in range(1, 9)], "s long")
    op = lambda c, *names: op(fn.compose_orientation(c, names[0]), *names[1:]) if names else c
    same = states.select(*[(op(F.col("s"), *names) == F.col("s")).alias(str(i)) for i, names in enumerate((["rotate_cw"] * 4, ["flip_h"] * 2, ["flip_v"] * 2, ["rotate_cw", "rotate_ccw"]))], (op(F.col("s"), "flip_h", "flip_v") == op(F.col("s"), "rotate_cw", "rotate_cw")).alias("z"))
    assert all(all(r) for r in same.collect())
    rect = values(spark, fn.selection_rect(lit(50.0), lit(0.0), lit(150.0), lit(100.0), lit(100), lit(100), lit(200), lit(100)))[0]
    assert tuple(rect) == (0.0, 0.0, 1.0, 1.0)
    inner = values(spark, fn.crop_within(F.struct(lit(0.5).alias("x"), lit(0.0).alias("y"), lit(0.5).alias("w"), lit(1.0).alias("h")), F.struct(lit(0.5).alias("x"), lit(0.5).alias("y"), lit(0.5).alias("w"), lit(0.5).alias("h"))))[0]
    assert tuple(inner) == (0.75, 0.5, 0.25, 0.5)
