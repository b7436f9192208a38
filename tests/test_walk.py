"""Folder walks: nothing on the driver, large trees and flat folders in many tasks."""

from __future__ import annotations

import os

from quillmark.sources import walk


def test_any_budget_lists_the_same_tree(spark, tmp_path):
    want = set()
    for i in range(40):
        folder = tmp_path / "a" / str(i % 7) / ("deep/" * (i % 4))
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{i}.png").write_bytes(b"x" * i)
        (folder / f"{i}.txt").write_bytes(b"")
        want.add((str(folder / f"{i}.png"), i))
    os.symlink(tmp_path / "a", tmp_path / "a" / "loop")
    for listed in (1, 5, 10_000):
        got = walk.walk_images(spark, str(tmp_path), listed=listed).collect()
        assert {(r.path, r["size"]) for r in got} == want and len(got) == 40
    assert walk.walk_images(spark, str(tmp_path / "a" / "1"), recursive=False).count() == sum(os.path.dirname(p) == str(tmp_path / "a" / "1") for p, _ in want)


def test_a_flat_folder_is_many_tasks_and_the_driver_asks_nothing(spark, tmp_path, monkeypatch):
    for i in range(3000):
        (tmp_path / f"{i}.jpg").touch()

    def forbidden(*args, **kwargs):
        raise AssertionError("the driver asked the file system")

    monkeypatch.setattr(os, "stat", forbidden)
    monkeypatch.setattr(os, "scandir", forbidden)
    found = walk.walk_images(spark, str(tmp_path), asked=500)
    monkeypatch.undo()
    assert found.rdd.getNumPartitions() == 6 and found.count() == 3000


def test_names_decide_before_files_are_asked(spark, tmp_path):
    (tmp_path / "a.txt").touch()
    (tmp_path / "old.png").touch()
    os.utime(tmp_path / "old.png", (-5, -5))
    os.mkfifo(tmp_path / "pipe.png")
    assert walk.walk_images(spark, str(tmp_path)).count() == 0
