"""Thumbnail files: written whole, found while current, touched, and what a failing task leaves."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.functions import pixels
from quillmark.operators import cache
from quillmark.sources import shared_files

FILES = "uri string, path string, mtime long, target int, data binary, width long, height long"


def rows(spark, tmp_path):
    wide = np.random.default_rng(1).integers(0, 256, (150, 300, 4), dtype=np.uint8)
    given = [(f"file:///p/{i}.jpg", path, 1000, target, bytes(wide.tobytes()), 300, 150) for i, (path, target) in enumerate([("/p/0.jpg", 100), ("/p/1.jpg", 200), ("/run/user/1/doc/x", 100)])]
    given.append(("file:///p/bad.jpg", "/p/bad.jpg", 1000, 100, b"xx", 300, 150))
    return spark.createDataFrame(given, FILES)


def test_store_read_touch(spark, tmp_path):
    private, shared = str(tmp_path / "private"), str(tmp_path / "shared")
    given = rows(spark, tmp_path)
    for _ in range(2):
        assert cache.store_thumbnails(given, private, f"file://{shared}") == 5
    files = sorted(os.path.relpath(os.path.join(d, f), tmp_path) for d, _, names in os.walk(tmp_path) for f in names)
    assert len(files) == 5 and all(f.endswith(".png") for f in files) and sum(f.startswith("shared/normal/") for f in files) == 1 and sum("/large/" in f for f in files) == 2
    read = {r.uri[-5]: r for r in cache.read_thumbnails(given, private, shared).collect()}
    assert [read[k].found_in for k in "012d"] == ["shared", "shared", "private", None]
    assert pixels.decode_png(bytes(read["0"].content)).shape == (64, 128, 4) and pixels.decode_png(bytes(read["1"].content)).shape == (128, 256, 4)
    assert b"tEXtThumb::URI\0file:///p/0.jpg" in bytes(read["0"].content) and b"Thumb::MTime\x001000" in bytes(read["0"].content)
    old = [os.path.join(d, f) for d, _, names in os.walk(private) for f in names]
    for path in old:
        os.utime(path, (2000, 2000))
    now = 2000 + cache.TOUCH_AFTER
    cache.read_thumbnails(given, private, shared, now).collect()
    assert {int(os.stat(p).st_mtime) for p in old} == {2000}
    cache.read_thumbnails(given, private, shared, now + 1).collect()
    assert sorted(int(os.stat(p).st_mtime) for p in old) == [2000, 2000, now + 1]  # the private one that was used
    newer = given.withColumn("mtime", F.lit(10**12))
    assert {r.found_in for r in cache.read_thumbnails(newer, private, shared).collect()} == {None}


def test_a_failing_task_leaves_no_partial_file(spark, tmp_path):
    files = spark.createDataFrame([(str(tmp_path / "a" / f"{i}.xmp"), b"x" * 10) for i in range(20)], "path string, content binary").repartition(4)
    assert shared_files.write_files(files).filter("written").count() == 20

    @F.udf("binary")
    def breaks(path):
        if path.endswith("7.xmp"):
            raise RuntimeError("lost")
        return b"new"

    with pytest.raises(Exception, match="lost"):
        shared_files.write_files(files.withColumn("content", breaks("path"))).collect()
    left = [p for p in (tmp_path / "a").iterdir()]
    assert len(left) == 20 and {p.read_bytes() for p in left} <= {b"x" * 10, b"new"}
    (tmp_path / "file").write_text("no folder")
    bad = spark.createDataFrame([(str(tmp_path / "file" / "b"), b"x"), (str(tmp_path / "c"), None), (str(tmp_path / "d"), b"")], "path string, content binary")
    assert {os.path.basename(r.path): r.written for r in shared_files.write_files(bad).collect()} == {"b": False, "c": False, "d": True}
