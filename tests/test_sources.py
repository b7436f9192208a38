from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.functions import hashing, pixels
from quillmark.operators import annotate, cache, export, query, scan
from quillmark.operators.query import Query
from quillmark.sources import images, walk
from quillmark.sources.catalog import CommitConflict, Store, empty, migrated
from quillmark.sources.settings import DEFAULT_CACHE_MB, Bookmark, Settings
from quillmark.streaming import oplog

from .catalogs import files, pairs, paths, record, tagged


def tiff(order: str = "<", **fields) -> bytes:
    """An EXIF block with make, model, orientation, changed and original."""
    text = {"make": 0x010F, "model": 0x0110, "changed": 0x0132}
    entries, data, base = [], b"", 8 + 2 + 12 * 6 + 4
    for name, tag in text.items():
        if name in fields:
            value = fields[name].encode() + b"\0"
            entries.append(struct.pack(order + "HHI", tag, 2, len(value)) + (value.ljust(4, b"\0") if len(value) <= 4 else struct.pack(order + "I", base + len(data))))
            data += value if len(value) > 4 else b""
    if "orientation" in fields:
        entries.append(struct.pack(order + "HHIHH", 0x0112, 3, 1, fields["orientation"], 0))
    if "original" in fields:
        entries.append(struct.pack(order + "HHII", 0x8769, 4, 1, base + len(data)))
        value = fields["original"].encode() + b"\0"
        data += struct.pack(order + "HHHII", 1, 0x9003, 2, len(value), base + len(data) + 18) + b"\0" * 4 + value
    body = struct.pack(order + "H", len(entries)) + b"".join(sorted(entries, key=lambda e: struct.unpack(order + "H", e[:2])))
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + body.ljust(base - 8, b"\0") + data


def jpeg(width: int, height: int, exif: bytes = b"") -> bytes:
    part = lambda m, d: b"\xff" + bytes([m]) + struct.pack(">H", len(d) + 2) + d
    return b"\xff\xd8" + (part(0xE1, b"Exif\0\0" + exif) if exif else b"") + part(0xDB, b"\0" * 65) + part(0xC0, struct.pack(">BHHB", 8, height, width, 3) + b"\0" * 9) + b"\xff\xd9"


def test_exif_and_headers(spark):
    for order in "<>":
        blob = tiff(order, make="NIKON", model="NIKON D750", orientation=6, changed="2020:01:01 00:00:00", original="2019:07:04 13:37:00")
        assert images.exif_fields(b"Exif\0\0" + blob) == {"make": "NIKON", "model": "NIKON D750", "orientation": 6, "changed": "2020:01:01 00:00:00", "original": "2019:07:04 13:37:00"}
    assert images.exif_fields(b"garbage") == {} and images.exif_fields(b"II*\0") == {}
    png = pixels.encode_png(np.zeros((5, 7, 4), np.uint8))
    assert images.probe(png) == {"format": "PNG", "width": 7, "height": 5}
    assert images.probe(b"GIF89a" + struct.pack("<HH", 3, 2)) == {"format": "GIF", "width": 3, "height": 2}
    assert images.probe(b"text") is None and images.probe(b"\xff\xd8\xff") is None
    rows = [("/a.jpg", jpeg(100, 50, tiff(make="SONY", model="ILCE", orientation=9, original="2019:07:04 13:37:00"))), ("/b.png", b"no image"), ("/c.png", None), ("/d.jpg", jpeg(3, 4))]
    got = {r.path: r for r in images.enriched(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert (got["/a.jpg"].width, got["/a.jpg"].height, got["/a.jpg"].format, got["/a.jpg"].camera, got["/a.jpg"].orientation, got["/a.jpg"].date_taken) == (100, 50, "JPEG", "SONY ILCE", None, 1562247420)
    assert (got["/b.png"].width, got["/c.png"].height, got["/d.jpg"].width, got["/d.jpg"].camera) == (0, 0, 3, None)


def test_blake3_vectors(spark):
    data = lambda n: bytes(i % 251 for i in range(n))
    assert hashing.blake3(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert hashing.blake3(data(1)) == "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"
    assert hashing.blake3(data(1025)) == "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"
    df = spark.createDataFrame([(b"",), (None,), (data(1),)], "content binary")
    assert [r[0] for r in df.select(hashing.content_hash(F.col("content"))).collect()] == [hashing.blake3(b""), None, hashing.blake3(data(1))]
    assert df.select(hashing.content_hash(F.col("content"), "md5")).first()[0] == "d41d8cd98f00b204e9800998ecf8427e"


def test_walk_and_scan(spark, tmp_path):
    root = tmp_path / "lib"
    (root / "sub" / "deep").mkdir(parents=True)
    for name, data in (("a.JPG", b"a"), (".hid.png", b"h"), ("sub/b.png", b"b"), ("sub/deep/_c.gif", b"c"), ("notes.txt", b"t")):
        (root / name).write_bytes(data)
    os.symlink(root / "a.JPG", root / "link.jpg")
    seen = walk.walk_images(spark, str(root))
    assert sorted(os.path.relpath(p, root) for p in paths(seen)) == [".hid.png", "a.JPG", "sub/b.png", "sub/deep/_c.gif"]
    assert [r.name for r in walk.collect_images(spark, str(root)).collect()] == [".hid.png", "a.JPG"]
    assert walk.walk_images(spark, str(root / "none")).count() == 0 and not walk.readable(str(root / "none"))

    def rescan(c):
        told = scan.changes(c, walk.with_hashes(walk.walk_images(spark, str(root))), str(root), walk.readable(str(root)))
        return scan.apply_scan(c, told, now=7), {os.path.relpath(p, root): k for p, k in pairs(told, "path", "change")}, tuple(scan.totals(told).first())

    store = Store(spark, str(tmp_path / "store"))
    c, told, totals = rescan(store.open())
    assert set(told.values()) == {"New"} and totals == (4, 4, 0)
    c = store.commit(annotate.set_rating(annotate.apply_tag(c, "keep", [hashing.blake3(b"b")]), hashing.blake3(b"b"), 5))
    os.rename(root / "sub/b.png", root / "moved.png")
    (root / "a.JPG").write_bytes(b"longer")
    (root / "sub/deep/_c.gif").unlink()
    (root / "copy.png").write_bytes(b"h")
    c2, told, totals = rescan(c)
    assert told == {"moved.png": "Moved", "a.JPG": "Modified", "sub/deep/_c.gif": "Deleted", ".hid.png": "Unchanged", "copy.png": "New"} and totals == (4, 3, 1)
    assert [os.path.basename(p) for p in paths(query.run(c2, Query(tags_all=["keep"], rating_min=5)))] == ["moved.png"]
    ids = {os.path.basename(r.path): r.id for r in c.files.collect()}
    assert {os.path.basename(r.path): r.id for r in c2.files.collect()}["moved.png"] == ids["b.png"]
    blind = scan.changes(c, walk.walk_images(spark, str(root)).withColumn("content_hash", F.lit(None).cast("string")).limit(0), str(root), readable=False)
    assert blind.count() == 0


def test_rescan_and_save_in_place(spark, tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "a.png").write_bytes(b"a")
    store = Store(spark, str(tmp_path / "store"))
    roots = [str(tmp_path / "lib"), str(tmp_path / "unplugged")]
    assert scan.rescan(store, roots) == {roots[0]: (1, 1, 0), roots[1]: (0, 0, 0)} and store.versions() == [1]
    assert scan.rescan(store, roots) == {roots[0]: (1, 0, 0), roots[1]: (0, 0, 0)} and store.versions() == [1]
    c = annotate.set_orientation(annotate.set_rating(store.open(), hashing.blake3(b"a"), 4), hashing.blake3(b"a"), 6)
    saved = annotate.save_in_place(c, c.files.withColumn("content_hash", F.lit("NEW")), hashing.blake3(b"a"))
    assert pairs(saved.ratings, "content_hash", "rating") == [("NEW", 4)] and saved.orientations.count() == 0 and pairs(saved.files, "id", "content_hash") == [(1, "NEW")]
    gone = annotate.delete_or_remove(saved, None, [], saved.files.select("path"))
    assert query.file_count(gone).first().n == 0


def test_classify(spark):
    c = files(spark, record("/same"), record("/size"), record("/time"), record("/back", missing=True))
    seen = spark.createDataFrame([("/same", 100, 42), ("/size", 1, 42), ("/time", 100, 1), ("/back", 100, 42), ("/new", 1, 1)], "path string, size long, mtime long")
    assert dict(pairs(scan.classify(c, seen), "path", "change")) == {"/same": "Unchanged", "/size": "Modified", "/time": "Modified", "/back": "Modified", "/new": "New"}
    both = files(spark, record("/root/a"), record("/root/b"), record("/other/c"))
    assert paths(scan.deleted(both, seen.limit(0).unionByName(spark.createDataFrame([("/root/a", 1, 1)], "path string, size long, mtime long")), "/root")) == ["/root/b"]


def test_moves_are_one_to_one(spark):
    c = files(spark, record("/z/old1", "H", missing=True), record("/z/old2", "H", missing=True), record("/r/back", "H", missing=True))
    seen = spark.createDataFrame([(f"/r/{n}", 1, 1, "H") for n in ("n1", "n2", "n3", "back")], "path string, size long, mtime long, content_hash string")
    told = {r.path: (r.change, r.old_path) for r in scan.changes(c, seen, "/r").collect()}
    assert told == {"/r/n1": ("Moved", "/z/old1"), "/r/n2": ("Moved", "/z/old2"), "/r/n3": ("New", None), "/r/back": ("Modified", None)}


def test_snapshots(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    first = store.commit(annotate.set_meta(files(spark, record("/a")), "k", "v"))
    assert (first.version, first.meta_value("k"), first.meta_value("x"), store.versions()) == (1, "v", None, [1])
    second = store.commit(annotate.set_meta(first, "k", "w"))
    with pytest.raises(CommitConflict):
        store.commit(annotate.set_meta(first, "k", "lost"))
    assert store.open(1).meta_value("k") == "v" and store.open().meta_value("k") == "w" and second.files.count() == 1
    copy = store.backup_to(f"file://{tmp_path}/copy", 1)
    assert copy.meta_value("k") == "v" and Store(spark, f"{tmp_path}/copy").open().files.count() == 1
    with pytest.raises(FileExistsError):
        store.backup_to(f"file://{tmp_path}/copy")
    assert Store(spark, f"{tmp_path}/none").open().files.count() == 0
    old = migrated(empty(spark), {"files": files(spark, record("/a")).files.drop("missing"), "meta": first.meta}, 1)
    assert old.comments.count() == 0 and pairs(old.files, "path", "missing") == [("/a", False)]
    with pytest.raises(ValueError):
        migrated(empty(spark), {}, 99)


def test_export_and_import(spark, tmp_path):
    c = tagged(files(spark), fave=["H1", "H2"], car=["H1"])
    c = annotate.set_comment(annotate.set_rating(c, "H1", 5), "H1", 'golden "hour"')
    c = annotate.add_to_catalog(annotate.create_catalog(c, "Cars"), 1, ["H2", "H1"])
    c = annotate.create_smart_collection(annotate.set_orientation(c, "H1", 6), "best", Query(rating_min=4))
    text = export.export_json(c)
    fresh = export.import_export(empty(spark), export.parse_export(spark, text))
    assert export.export_json(fresh) == text and fresh.orientations.count() == 0
    assert pairs(fresh.collection_items, "content_hash", "position") == [("H1", 1), ("H2", 0)]
    export.write_export(c, str(tmp_path / "e.json"))
    again = export.import_export(fresh, export.read_export(spark, str(tmp_path / "e.json")))
    assert (again.tags.count(), again.file_tags.count(), again.collections.count()) == (2, 3, 4)
    assert export.export_json(empty(spark)) == '{"version":2,"file_tags":[],"ratings":[],"comments":[],"collections":[]}'
    one = export.parse_export(spark, '{"version":1,"file_tags":[{"content_hash":"X","tags":["FAVE","new"]}],"ratings":[{"content_hash":"H1","rating":2}],"collections":[]}')
    merged = export.import_export(c, one)
    assert pairs(merged.ratings, "rating") == [(2,)] and pairs(merged.tags, "id", "name") == [(1, "fave"), (2, "car"), (3, "new")]
    bad = export.parse_export(spark, '{"version":2,"file_tags":[],"ratings":[{"content_hash":"H1","rating":9}],"collections":[]}')
    with pytest.raises(ValueError):
        export.import_export(c, bad)


def test_xmp(spark, tmp_path):
    c = tagged(files(spark, record(str(tmp_path / "p.jpg"), "H"), record("/none", "N"), record("/empty", "")), **{"a < b & c": ["H"], "z": ["H"]})
    c = annotate.set_rating(c, "H", 5)
    packets = export.xmp_packets(c, c.files)
    assert export.write_sidecars(packets) == 1
    text = (tmp_path / "p.jpg.xmp").read_text(encoding="utf-8")
    assert "<xmp:Rating>5</xmp:Rating>" in text and "<rdf:li>a &lt; b &amp; c</rdf:li>\n     <rdf:li>z</rdf:li>" in text and text.startswith('<?xpacket begin="﻿"') and "dc:description" not in text
    one = spark.range(1).select(export.xmp_packet(F.lit(9), F.lit("x<y"), F.array().cast("array<string>")).alias("p")).first().p
    assert "<xmp:Rating>5<" in one and "x&lt;y" in one and "dc:subject" not in one


def test_eviction(spark):
    plan = lambda rows, cap: sorted(r.ord for r in cache.evictions(spark.createDataFrame(rows, "ord long, size long, last_used long"), cap).collect())
    assert plan([(0, 30, 3), (1, 30, 1), (2, 30, 2)], 60) == [1]
    assert plan([(0, 40, 4), (1, 30, 3), (2, 20, 2), (3, 10, 1)], 40) == [1, 2, 3]
    assert plan([(0, 10, 5), (1, 10, 5), (2, 10, 5)], 20) == [0] and plan([(0, 5, 1)], 5) == []
    lru = cache.SizedLru(100)
    for key, size in (("a", 40), ("b", 40), ("c", 40)):
        lru.put(key, key, size)
    assert lru.get("a") is None and lru.get("b") == "b" and lru.held == 80
    lru.put("d", "d", 500)
    assert len(lru) == 1 and lru.get("d") == "d"
    lru.clear()
    assert (len(lru), lru.held) == (0, 0)


def test_pixels(spark):
    red = np.tile(np.array([255, 0, 0, 255], np.uint8), (20, 40, 1))
    assert pixels.resize(red, 10).shape == (5, 10, 4) and pixels.resize(red, 10)[0, 0].tolist() == [255, 0, 0, 255]
    padded = bytes([10, 20, 30, 40, 50, 60, 70, 80, 0, 0, 0, 0, 11, 21, 31, 41, 51, 61, 71, 81, 0, 0, 0, 0])
    tight = pixels.raster(padded, 2, 2, 12)
    assert tight.ravel().tolist() == [10, 20, 30, 40, 50, 60, 70, 80, 11, 21, 31, 41, 51, 61, 71, 81]
    assert pixels.raster(b"xxxx", 0, 0) is None and pixels.raster(b"xxxx", 100, 100) is None
    ab = np.array([[[1] * 4, [2] * 4]], np.uint8)
    first = lambda o: pixels.orient(ab, o)[:, :, 0].tolist()
    assert (first(2), first(3), first(6), first(8)) == ([[2, 1]], [[2, 1]], [[1], [2]], [[2], [1]])
    assert pixels.orient(ab, 1) is None and pixels.orient(ab, 9) is None
    grid = np.arange(6, dtype=np.uint8).reshape(2, 3, 1)
    want = {2: [[2, 1, 0], [5, 4, 3]], 3: [[5, 4, 3], [2, 1, 0]], 4: [[3, 4, 5], [0, 1, 2]], 5: [[0, 3], [1, 4], [2, 5]], 6: [[3, 0], [4, 1], [5, 2]], 7: [[5, 2], [4, 1], [3, 0]], 8: [[2, 5], [1, 4], [0, 3]]}
    assert {o: pixels.orient(grid, o)[:, :, 0].tolist() for o in want} == want
    assert pixels.crop(red, (0.5, 0.5, 1.0, 1.0)).shape == (10, 20, 4) and pixels.crop(red, (1.0, 0, 1, 1)) is None
    grad = np.repeat((np.arange(32 * 32) % 32 * 8).astype(np.uint8), 3)
    a, b, c = (pixels.gradient_hash(x.tobytes(), 32, 32) for x in (grad, np.minimum(grad.astype(int) + 10, 255).astype(np.uint8), 255 - grad))
    bits = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    assert bits(a, b) <= 4 and bits(a, c) > 20 and pixels.gradient_hash(b"x", 4, 4) is None
    png = pixels.add_text_chunks(pixels.encode_png(red), [("Thumb::URI", "file:///a"), ("Thumb::MTime", "7")])
    assert b"tEXtThumb::URI\0file:///a" in png and images.probe(png)["width"] == 40 and pixels.add_text_chunks(b"no", []) is None
    at = png.index(b"tEXt")
    size = struct.unpack(">I", png[at - 4 : at])[0]
    assert struct.unpack(">I", png[at + 4 + size : at + 8 + size])[0] == zlib.crc32(png[at : at + 4 + size])
    hashed = pixels.gradient_hashes(spark.createDataFrame([("/r", red.tobytes(), 40, 20, None), ("/bad", b"", 4, 4, None)], "path string, data binary, width long, height long, stride long"))
    assert dict(pairs(hashed, "path", "phash")) == {"/r": 0, "/bad": None}
    rows = [("/a", red.tobytes(), 40, 20, None, 6, 0.0, 0.0, 1.0, 0.5), ("/bad", b"", 4, 4, None, None, None, None, None, None)]
    got = {r.path: (r.width, r.height) for r in pixels.transformed(spark.createDataFrame(rows, "path string, data binary, width long, height long, stride long, orientation long, x double, y double, w double, h double"), 10).collect()}
    assert got == {"/a": (10, 10), "/bad": (0, 0)}


def test_thumbnail_lookup(spark):
    f = spark.createDataFrame([("u1", "/p/1", 10), ("u2", "/run/user/1/doc/x", 10), ("u3", "/p/3", 10)], "uri string, path string, mtime long")
    key = lambda u: __import__("hashlib").md5(u.encode()).hexdigest()
    listing = spark.createDataFrame([("shared", key("u1"), 10), ("shared", key("u2"), 10), ("private", key("u2"), 11), ("shared", key("u3"), 9)], "cache string, key string, thumb_mtime long")
    assert pairs(cache.cached_thumbnails(f, listing), "uri", "found_in") == [("u1", "shared"), ("u2", "private"), ("u3", "decode")]


def test_settings(tmp_path):
    s = Settings(str(tmp_path / "conf" / "settings.ini"))
    assert (s.roots(), s.cache_mb(), s.sort_field(), s.sort_descending(), s.bookmarks()) == ([], DEFAULT_CACHE_MB, "name", False, [])
    assert s.add_root("/a") and s.add_root("/B c") and not s.add_root("/a")
    s.set_cache_mb(0)
    s.set_sort("script:x", True)
    assert s.add_bookmark("/pics/trip/") and s.add_bookmark("/x", "X") and not s.add_bookmark("/x")
    s.move_bookmark("/x", 0)
    again = Settings(s.path)
    assert (again.roots(), again.cache_mb(), again.sort_field(), again.sort_descending()) == (["/a", "/B c"], DEFAULT_CACHE_MB, "script:x", True)
    assert again.bookmarks() == [Bookmark("X", "/x"), Bookmark("trip", "/pics/trip/")]
    again.remove_root("/a")
    again.remove_bookmark("/x")
    assert Settings(s.path).roots() == ["/B c"] and len(Settings(s.path).bookmarks()) == 1


def test_oplog_stream(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    store.commit(files(spark, record("/a", "A"), record("/b", "B")))
    write = lambda rows, n: spark.createDataFrame(rows, oplog.OPS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ops")
    write([(1, "rate", "A", "4"), (2, "rate", "A", "9"), (3, "rate", "B", "1"), (4, "rate", "B", "0"), (5, "tag", "A", " Beach "), (6, "tag", "B", "beach"), (7, "untag", "B", "BEACH"), (8, "comment", "A", " x ")], 1)
    for _ in range(2):  # the second run finds nothing new
        stream = oplog.run_oplog(spark, f"{tmp_path}/ops", store, f"{tmp_path}/state")
        stream.awaitTermination()
    c = store.open()
    assert (c.version, pairs(c.ratings, "content_hash", "rating"), pairs(c.comments, "body"), pairs(c.tags, "name"), pairs(c.file_tags, "content_hash")) == (2, [("A", 5)], [("x",)], [("Beach",)], [("A",)])
    write([(9, "rate", "A", None), (10, "orient", "B", "6")], 2)
    oplog.run_oplog(spark, f"{tmp_path}/ops", store, f"{tmp_path}/state").awaitTermination()
    c = store.open()
    assert (c.version, c.ratings.count(), pairs(c.orientations, "content_hash", "orientation")) == (3, 0, [("B", 6)])


def test_arriving_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(b"a")
    (tmp_path / "in" / "b.txt").write_bytes(b"b")
    q = oplog.arriving_files(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("arrivals").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.path, r["size"]) for r in spark.sql("SELECT * FROM arrivals").collect()] == [(str(tmp_path / "in" / "a.png"), 1)]
