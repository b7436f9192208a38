"""Order and filter of a folder's grid, and orders by user-supplied keys."""

from __future__ import annotations

import glob
import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import file_name, natural_key
from ..functions.script import MAX_CHARS, Key, ScriptError, read_script
from ..plans.components import written
from ..sources.catalog import Catalog
from .query import hashes_with_tag, present

#: Sort fields: the key and whether "ascending" shows its highest values first.
FIELDS = {"name": (None, False), "size": ("size", False), "modified": ("mtime", False), "type": ("type", False), "rating": ("rating", True), "date": ("date_taken", True)}


def grid(catalog: Catalog) -> DataFrame:
    """Present files as grid items."""
    ratings = catalog.ratings.select("content_hash", "rating")
    rows = present(catalog).join(ratings, "content_hash", "left")
    return rows.select("path", file_name("path").alias("name"), "size", "mtime", F.lower(F.coalesce("format", F.lit(""))).alias("type"), "content_hash", F.coalesce("rating", F.lit(0)).cast("bigint").alias("rating"), "date_taken")


def grid_order(field: str, descending: bool = False) -> list[Column]:
    """The field, then the lower-case name, then path; all but path are reversed when descending.

    "Ascending" puts the best rating and the newest date first, and undated items last; descending
    reverses all of it, so undated items then come first.
    """
    key, highest_first = FIELDS[field]
    order = []
    if key:
        down = highest_first != descending
        column = F.col(key)
        if key == "date_taken":
            order.append(column.desc_nulls_last() if down else column.asc_nulls_first())
        else:
            order.append(column.desc() if down else column.asc())
    name = F.lower("name")
    return [*order, name.desc() if descending else name.asc(), F.col("path").asc()]


def grid_filter(items: DataFrame, catalog: Catalog, min_rating: int = 0, tag: str | None = None) -> DataFrame:
    """Items of at least a rating (unrated ones count 0) that carry a tag, if one is chosen."""
    rows = items.filter(F.coalesce("rating", F.lit(0)) >= min_rating)
    if tag is None:
        return rows
    return rows.filter(F.col("content_hash") != "").join(hashes_with_tag(catalog, tag), "content_hash", "left_semi").select(*items.columns)


#: What a view queues to load: the grid, the filmstrip, and how many of the latter load at once.
GRID_QUEUE, STRIP_QUEUE, STRIP_LOADING = 512, 96, 8


def nearest(items: DataFrame, position: str, center: float, limit: int = GRID_QUEUE) -> DataFrame:
    """The items closest to a place in the view: what to load next. Items of one place are taken by their paths."""
    return items.orderBy(F.abs(F.col(position) - center), position, "path").limit(limit)


# --- orders by user-supplied keys ----------------------------------------------------------

KEY = "struct<kind:int,num:double,str:string>"


class KeyError_(ValueError):
    """A key function failed or returned neither number nor string."""


def number_key(column: Column) -> Column:
    return F.struct(F.lit(0).alias("kind"), column.cast("double").alias("num"), F.lit(None).cast("string").alias("str"))


def text_key(column: Column) -> Column:
    return F.struct(F.lit(1).alias("kind"), F.lit(None).cast("double").alias("num"), column.alias("str"))


class SortKeys:
    """Named orders: a Column builder, a script's key, or a Python function of one item's facts.

    Registering a name again replaces it in place. Python functions are a program's own, trusted code; they
    run in Arrow batches, once for each item, and their keys belong to paths: equal contents may have
    different names. Scripts of users are compiled and can reach nothing but the item; an item whose key is
    null comes after the others.
    """

    def __init__(self):
        self.orders: dict[str, Callable] = {}
        self.native: set[str] = set()
        self.register("Name (natural)", lambda: text_key(natural_key("name")), native=True)
        self.register("Oldest first", lambda: number_key(F.coalesce("date_taken", "mtime")), native=True)

    def register(self, name: str, key: Callable, native: bool = False) -> None:
        if not name.strip():
            raise ValueError("an order needs a name")
        self.orders[name] = key
        (self.native.add if native else self.native.discard)(name)

    def load_dir(self, folder: str) -> dict[str, str]:
        """Read every ``*.py`` of a folder, in order of names: calls of ``register_sort(name, key)``.

        Scripts are compiled to Columns (``functions.script``), never run. Returns the errors by file; the
        other files still load, and a file that fails leaves no order behind. A folder that is not there
        holds nothing.
        """
        errors: dict[str, str] = {}
        for path in sorted(glob.glob(os.path.join(glob.escape(folder), "*.py"))):
            try:
                with open(path, encoding="utf-8") as file:
                    found = read_script(path, file.read(MAX_CHARS + 1))
            except (OSError, UnicodeDecodeError, ScriptError) as error:
                errors[path] = f"{type(error).__name__}: {error}"
                continue
            for name, key in found.items():
                self.register(name, key, native=True)
        return errors

    def field_id(self, name: str) -> str:
        return f"script:{name}"

    def from_field_id(self, text: str) -> str:
        """The order's name; 'name' if nothing of that name is registered."""
        name = text.removeprefix("script:")
        return name if text.startswith("script:") and name in self.orders else text if text in FIELDS else "name"

    def keyed(self, items: DataFrame, name: str) -> DataFrame:
        """items with the column sort_key."""
        key = self.orders[name]
        if isinstance(key, Key):
            value = key(items)
            if value.kind not in ("num", "str"):
                raise KeyError_(f"{key.script}: {name}: a key must be a number or a string, not {value.kind}")
            made = number_key if value.kind == "num" else text_key
            return items.withColumn("sort_key", F.when(value.column.isNotNull(), made(value.column)))
        if name in self.native:
            return items.withColumn("sort_key", key())

        def one(facts: dict) -> dict:
            try:
                value = key(facts)
            except Exception as error:
                raise KeyError_(f"{name}: {type(error).__name__}: {error}") from error
            if isinstance(value, bool) or not isinstance(value, (int, float, str)):
                raise KeyError_(f"{name}: a key must be a number or a string, not {type(value).__name__}")
            text = isinstance(value, str)
            return {"kind": int(text), "num": None if text else float(value), "str": value if text else None}

        kind = pa.struct([("kind", pa.int32()), ("num", pa.float64()), ("str", pa.string())])

        @F.arrow_udf(KEY)
        def keys(facts: pa.Array) -> pa.Array:
            # Arrow, not pandas: a NaN key is a number and must not become a null.
            return pa.array([one(f) for f in facts.to_pylist()], kind)

        return items.withColumn("sort_key", keys(F.struct(*items.columns)))

    def order(self, descending: bool = False) -> list[Column]:
        """Keyed items before others, numbers before strings (NaN greatest), then name; reversed when descending."""
        parts = [F.col("sort_key").isNull(), F.col("sort_key.kind"), F.col("sort_key.num"), F.col("sort_key.str"), F.lower("name")]
        return [*(c.desc() if descending else c.asc() for c in parts), F.col("path").asc()]

    def sorted_or_by_name(self, items: DataFrame, name: str, descending: bool = False) -> DataFrame:
        """Items in the order, or by name if a key fails: the keys are computed before the order is used.

        Only a key function's own failure counts; lost executors or full disks are errors as ever.
        """
        try:
            keyed = written(self.keyed(items, name), "keys")
        except (KeyError_, ScriptError):
            return items.orderBy(*grid_order("name", descending))
        except PythonException as error:
            if KeyError_.__name__ not in str(error):
                raise
            return items.orderBy(*grid_order("name", descending))
        return keyed.orderBy(*self.order(descending)).drop("sort_key")
