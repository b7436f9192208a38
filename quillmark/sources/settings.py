"""User settings in an INI file: library roots, cache budget, sort, bookmarks."""

from __future__ import annotations

import configparser
import os
from dataclasses import dataclass

DEFAULT_CACHE_MB = 8192


@dataclass(frozen=True)
class Bookmark:
    name: str
    path: str


def default_bookmark_name(path: str) -> str:
    return os.path.basename(path.rstrip("/")) or path


class Settings:
    """Read fresh where needed; every change is written at once."""

    def __init__(self, path: str):
        self.path = path
        self._file = configparser.RawConfigParser()
        self._file.optionxform = str
        try:
            self._file.read(path, encoding="utf-8")
        except (configparser.Error, UnicodeDecodeError):
            self._file.clear()  # unreadable settings are no settings

    def _get(self, group: str, key: str, default: str = "") -> str:
        return self._file.get(group, key, fallback=default)

    def _set(self, group: str, **values: object) -> None:
        if not self._file.has_section(group):
            self._file.add_section(group)
        for key, value in values.items():
            self._file.set(group, key.replace("_", "-"), str(value))
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        with open(self.path, "w", encoding="utf-8") as file:
            self._file.write(file)

    def _number(self, group: str, key: str) -> int:
        text = self._get(group, key)
        return int(text) if text.isdigit() else 0

    def roots(self) -> list[str]:
        return [r for i in range(self._number("roots", "count")) if (r := self._get("roots", str(i)))]

    def set_roots(self, roots: list[str]) -> None:
        self._set("roots", **{str(i): r for i, r in enumerate(roots)}, count=len(roots))

    def add_root(self, root: str) -> bool:
        roots = self.roots()
        if root in roots:
            return False
        self.set_roots([*roots, root])
        return True

    def remove_root(self, root: str) -> None:
        self.set_roots([r for r in self.roots() if r != root])

    def cache_mb(self) -> int:
        return self._number("cache", "mb") or DEFAULT_CACHE_MB

    def set_cache_mb(self, mb: int) -> None:
        self._set("cache", mb=mb)

    def sort_field(self) -> str:
        return self._get("sort", "field", "name")

    def sort_descending(self) -> bool:
        return self._get("sort", "descending").lower() == "true"

    def set_sort(self, field: str, descending: bool) -> None:
        self._set("sort", field=field, descending=str(descending).lower())

    def bookmarks(self) -> list[Bookmark]:
        found = []
        for i in range(self._number("bookmarks", "count")):
            if path := self._get("bookmarks", f"path-{i}"):
                found.append(Bookmark(self._get("bookmarks", f"name-{i}") or default_bookmark_name(path), path))
        return found

    def set_bookmarks(self, marks: list[Bookmark]) -> None:
        values = {k: v for i, m in enumerate(marks) for k, v in ((f"path_{i}", m.path), (f"name_{i}", m.name))}
        self._set("bookmarks", **values, count=len(marks))

    def add_bookmark(self, path: str, name: str = "") -> bool:
        marks = self.bookmarks()
        if any(m.path == path for m in marks):
            return False
        self.set_bookmarks([*marks, Bookmark(name or default_bookmark_name(path), path)])
        return True

    def remove_bookmark(self, path: str) -> None:
        self.set_bookmarks([m for m in self.bookmarks() if m.path != path])

    def move_bookmark(self, path: str, place: int) -> None:
        marks = self.bookmarks()
        moved = [m for m in marks if m.path == path]
        rest = [m for m in marks if m.path != path]
        self.set_bookmarks([*rest[:place], *moved, *rest[place:]])
