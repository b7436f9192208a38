from __future__ import annotations

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from quillmark.operators import annotate, grid, query
from quillmark.operators.query import Query

from .catalogs import files, paths, record, tagged


def dated(path, date, **more):
    return record(path, date_taken=date, **more)


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_undated_files_come_last_both_ways(spark):
    c = files(spark, dated("/p/c", 300), dated("/p/a", 100), dated("/p/z", None), dated("/p/b", 200))
    assert paths(query.run(c, Query(sort="DateTaken"))) == ["/p/a", "/p/b", "/p/c", "/p/z"]
    assert paths(query.run(c, Query(sort="DateTaken", direction="Desc"))) == ["/p/c", "/p/b", "/p/a", "/p/z"]


def test_filters(spark):
    c = files(spark, record("/pics/trip/1", camera="SONY", size=300, date_taken=100), record("/pics/trip/2", camera="NIKON", size=100, date_taken=200, format="JPEG", orientation=6), record("/pics/other/3", camera="SONY", size=200, date_taken=300), record("/pics/gone", missing=True))
    run = lambda **q: paths(query.run(c, Query(**q)))
    assert run(under="/pics/trip", camera="SONY") == ["/pics/trip/1"]
    assert run(under="/pics/trip/") == ["/pics/trip/1", "/pics/trip/2"]
    assert run(date_from=150, date_to=350, sort="Size", direction="Desc") == ["/pics/other/3", "/pics/trip/2"]
    assert run(format="JPEG") == run(orientation=6) == ["/pics/trip/2"]
    assert run() == ["/pics/other/3", "/pics/trip/1", "/pics/trip/2"]
    assert run(under="/") == run()
    assert run(limit=-1) == run() and run(limit=1) == ["/pics/other/3"] and run(limit=0) == []
    assert run(camera="x'); DROP TABLE files;--") == []


def test_subtrees_have_no_wildcards_or_siblings(spark):
    c = files(spark, record("/a_b/1"), record("/axb/2"), record("/a_b0/3"), record("/a_b"))
    assert paths(query.run(c, Query(under="/a_b"))) == ["/a_b/1"]


def test_area_and_overflow(spark):
    c = files(spark, record("/s", width=100, height=100), record("/b", width=2**40, height=2**40), record("/m", width=1000, height=1000), record("/failed", width=0, height=0), record("/new"))
    assert paths(query.run(c, Query(sort="Area", direction="Desc", limit=2))) == ["/b", "/m"]
    assert paths(query.run(c, Query(sort="Area"))) == ["/failed", "/s", "/m", "/b", "/new"]


def test_tags_and_ratings(spark):
    c = tagged(files(spark, record("/a", "A"), record("/b", "B"), record("/c", "C")), beach=["A", "B"], sunset=["A", "C"])
    assert paths(query.run(c, Query(tags_all=["beach", "SUNSET"]))) == ["/a"]
    assert paths(query.run(c, Query(tags_any=["beach", "SUNSET"]))) == ["/a", "/b", "/c"]
    assert paths(query.run(c, Query(tags_all=["beach", "Beach"]))) == ["/a", "/b"]
    c = annotate.set_rating(annotate.set_rating(c, "A", 5), "B", 0)
    assert paths(query.run(c, Query(rating_min=4))) == ["/a"]
    assert paths(query.run(c, Query(rating_min=0))) == ["/a", "/b"]  # unrated ones fail
    assert query.distinct_names(["É", "é", "a", "A"]) == ["É", "a"]


def test_plans_push_down_and_semi_join(spark, tmp_path):
    files(spark, record("/a")).files.write.parquet(str(tmp_path / "f"))
    c = files(spark).with_tables(files=spark.read.parquet(str(tmp_path / "f")))
    text = plan(query.filtered(c, Query(under="/a", tags_any=["x"], rating_min=3)))
    assert "GreaterThanOrEqual(path,/a/)" in text and "LessThan(path,/a0)" in text and text.count("Join type: LeftSemi") == 2
    assert "TakeOrderedAndProject" in plan(query.run(c, Query(sort="Size", limit=3)))


def test_predicates_as_json():
    q = Query.from_json('{"tags_all":["fave"],"rating_min":4,"later_field":1}')
    assert q == Query(tags_all=["fave"], rating_min=4)
    assert Query.from_json(q.to_json()) == q
    with pytest.raises(ValueError):
        Query.from_json('{"sort":"Nothing"}')
    assert query.current_filter_query(0, None) is None
    assert query.current_filter_query(3, "x") == Query(rating_min=3, tags_any=["x"])


def test_folder_stamp(spark):
    c = files(spark, record("/p/a", "A"), record("/p/b", "B"), record("/other/c", "C"))
    c = annotate.set_crop(annotate.set_orientation(annotate.set_rating(c, "A", 4), "B", 6), "B", (0.1, 0.2, 0.3, 0.4))
    got = {r.path: r for r in query.ratings_under(c, "/p").collect()}
    assert (got["/p/a"].rating, got["/p/a"].orientation, got["/p/a"].crop) == (4, 1, None)
    assert (got["/p/b"].rating, got["/p/b"].orientation, tuple(got["/p/b"].crop)) == (0, 6, (0.1, 0.2, 0.3, 0.4))
    assert set(got) == {"/p/a", "/p/b"}
    items = query.ratings_under(c, "/p").withColumn("rating", F.lit(1).cast("long")).unionByName(query.ratings_under(c, "/other").withColumn("path", F.lit("/p/new")).withColumn("rating", F.lit(2).cast("long")))
    stamped = {r.path: r.rating for r in query.stamped(items, c, "/p").collect()}
    assert stamped == {"/p/a": 4, "/p/b": 0, "/p/new": 2}


def test_lookups(spark):
    c = files(spark, record("/l/x", "H"), record("/l/a", "H", missing=True), record("/l/b", "H", missing=True), record("/l/sub/deep/q"), record("/l/.hidden/q"))
    assert paths(query.file_by_path(c, "/l/a")) == ["/l/a"]
    assert paths(query.files_by_hash(c, "H")) == ["/l/a", "/l/b", "/l/x"]
    assert paths(query.missing_file_by_hash(c, "H")) == ["/l/a"]
    assert [r.name for r in query.dir_children(c, "/l").collect()] == ["sub"]
    assert query.file_count(c).first().n == 3


def test_grid_orders(spark):
    c = files(spark, record("/g/B", "B", date_taken=5), record("/g/a", "A", date_taken=9), record("/g/c", "C"))
    c = annotate.set_rating(c, "C", 5)
    order = lambda f, d: [r.name for r in grid.grid(c).orderBy(*grid.grid_order(f, d)).collect()]
    assert order("name", False) == ["a", "B", "c"] and order("name", True) == ["c", "B", "a"]
    assert order("rating", False) == ["c", "a", "B"] and order("rating", True) == ["B", "a", "c"]
    assert order("date", False) == ["a", "B", "c"] and order("date", True) == ["c", "B", "a"]


def test_script_orders(spark):
    c = files(spark, *[record(f"/g/{n}") for n in ("img_10", "IMG_2", "img_1", "x")])
    items, keys = grid.grid(c), grid.SortKeys()
    names = lambda *a, **k: [r.name for r in keys.sorted_or_by_name(items, *a, **k).collect()]
    assert names("Name (natural)") == ["img_1", "IMG_2", "img_10", "x"]
    assert names("Name (natural)", descending=True) == ["x", "img_10", "IMG_2", "img_1"]
    keys.register("Mixed", lambda item: "text" if item["name"] == "x" else (float("nan") if item["name"] == "img_1" else len(item["name"])))
    assert names("Mixed") == ["IMG_2", "img_10", "img_1", "x"]
    keys.register("Broken", lambda item: None)
    assert names("Broken") == ["img_1", "img_10", "IMG_2", "x"]
    keys.register("Broken", lambda item: 1 // 0)
    assert names("Broken") == ["img_1", "img_10", "IMG_2", "x"]
    with pytest.raises(ValueError):
        keys.register("  ", len)
    assert keys.from_field_id("script:Mixed") == "Mixed" and keys.from_field_id("script:gone") == "name" and keys.from_field_id("size") == "size"


def test_scripts_of_a_folder(spark, tmp_path):
    (tmp_path / "a.py").write_text("register_sort('Size', lambda item: item['size'])")
    (tmp_path / "b.py").write_text("register_sort('Gone', len)\nraise RuntimeError('broken')")
    (tmp_path / "c.py").write_text("register_sort('Name length', lambda item: len(item['name']))")
    keys = grid.SortKeys()
    assert list(keys.load_dir(str(tmp_path))) == [str(tmp_path / "b.py")] and keys.load_dir(str(tmp_path / "none")) == {}
    assert list(keys.orders)[2:] == ["Size", "Name length"]
    c = files(spark, record("/g/big", size=9), record("/g/small", size=1))
    assert [r.name for r in keys.sorted_or_by_name(grid.grid(c), "Size").collect()] == ["small", "big"]
    assert [r.name for r in grid.nearest(grid.grid(c), "size", 8.0, 1).collect()] == ["big"]


def test_nearest_of_one_place_by_path(spark):
    """Items of one place are taken by their paths, in whatever order they come."""
    names = [f"/g/{i:02}" for i in range(20)]
    for rows in (names, names[::-1], names[10:] + names[:10]):
        items = spark.createDataFrame([(n, 7) for n in rows], "path string, pos long")
        assert sorted(r.path for r in grid.nearest(items, "pos", 5.0, 3).collect()) == names[:3]
