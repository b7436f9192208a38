"""Typed sort-and-filter queries over present files, storable as JSON predicates."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import LOWER, UPPER, ascii_fold, in_subtree
from ..plans.ranking import ranked, ranked_top
from ..sources.catalog import Catalog
from ..sources.schema import FILE_COLUMNS


def _area() -> Column:
    # Exact in DECIMAL: the product of two BIGINTs may not fit one.
    return F.col("width").cast("decimal(19,0)") * F.col("height").cast("decimal(19,0)")


#: Sort keys and whether they may be null. Their order is fixed: stored predicates name them.
SORT_KEYS = {"Name": ("path", False), "DateTaken": ("date_taken", True), "Size": ("size", False), "Mtime": ("mtime", False), "Area": (_area, True), "IndexedAt": ("indexed_at", False)}


@dataclass(frozen=True)
class Query:
    """Default: every present file, by path. Values are literals of the plan, never SQL text."""

    under: str | None = None
    tags_all: list[str] = field(default_factory=list)
    tags_any: list[str] = field(default_factory=list)
    rating_min: int | None = None
    camera: str | None = None
    format: str | None = None
    date_from: int | None = None
    date_to: int | None = None
    orientation: int | None = None
    sort: str = "Name"
    direction: str = "Asc"
    limit: int | None = None

    def to_json(self) -> str:
        return json.dumps(asdict(self), separators=(",", ":"), ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Query:
        """Absent fields take their defaults; unknown ones are ignored."""
        stored = json.loads(text)
        query = cls(**{k: v for k, v in stored.items() if k in cls.__dataclass_fields__})
        if query.sort not in SORT_KEYS or query.direction not in ("Asc", "Desc"):
            raise ValueError(f"unknown order {query.sort} {query.direction}")
        return query


def distinct_names(names: list[str]) -> list[str]:
    """The first of the names that agree in (Unicode) lower case."""
    return list({n.lower(): n for n in reversed(names)}.values())[::-1]


def present(catalog: Catalog) -> DataFrame:
    return catalog.files.filter(~F.col("missing")).select(*FILE_COLUMNS)


def hashes_with_any(catalog: Catalog, names: list[str]) -> DataFrame:
    """content_hash and folded name of the file tags that match a name."""
    folded = [F.lit(n) for n in _folded(names)]
    tags = catalog.tags.select("id", ascii_fold("name").alias("tag")).filter(F.col("tag").isin(*folded))
    return catalog.file_tags.join(tags, F.col("tag_id") == F.col("id")).select("content_hash", "tag")


def own_conditions(query: Query) -> list[Column]:
    """The conditions that a file's own columns decide."""
    found = [in_subtree("path", query.under)] if query.under is not None else []
    for column in ("camera", "format", "orientation"):
        value = getattr(query, column)
        if value is not None:
            found.append(F.col(column) == F.lit(value))
    if query.date_from is not None:
        found.append(F.col("date_taken") >= query.date_from)
    if query.date_to is not None:
        found.append(F.col("date_taken") <= query.date_to)
    return found


def _folded(names: list[str]) -> list[str]:
    return list(dict.fromkeys(n.translate(str.maketrans(UPPER, LOWER)) for n in names))


def matches(query: Query) -> Column:
    """Whether a present file is in the query, given its folded tags and rating as _tags and _rating."""
    found = reduce(Column.__and__, own_conditions(query), F.lit(True))
    if query.tags_all:
        names = distinct_names(query.tags_all)
        has = [F.array_contains("_tags", n) for n in _folded(names)]
        # Names that agree in Unicode lower case only are two tags or none.
        found = found & (reduce(Column.__and__, has) if len(has) == len(names) else F.lit(False))
    if query.tags_any:
        found = found & F.arrays_overlap("_tags", F.array(*[F.lit(n) for n in _folded(query.tags_any)]))
    if query.rating_min is not None:
        found = found & (F.col("_rating") >= query.rating_min)
    return found


def filtered(catalog: Catalog, query: Query) -> DataFrame:
    """The query's rows, without order or limit."""
    rows = present(catalog)
    for condition in own_conditions(query):
        rows = rows.filter(condition)
    if query.tags_all:
        names = distinct_names(query.tags_all)
        every = hashes_with_any(catalog, names).groupBy("content_hash").agg(F.countDistinct("tag").alias("n")).filter(F.col("n") == len(names))
        rows = rows.join(every, "content_hash", "left_semi")
    if query.tags_any:
        rows = rows.join(hashes_with_any(catalog, query.tags_any), "content_hash", "left_semi")
    if query.rating_min is not None:
        rows = rows.join(catalog.ratings.filter(F.col("rating") >= query.rating_min), "content_hash", "left_semi")
    return rows.select(*FILE_COLUMNS)


def order_of(query: Query) -> list[Column]:
    """Nulls last in both directions; equal keys by ascending path, always."""
    key, _ = SORT_KEYS[query.sort]
    column = key() if callable(key) else F.col(key)
    first = column.desc_nulls_last() if query.direction == "Desc" else column.asc_nulls_last()
    return [first, F.col("path").asc()]


def run(catalog: Catalog, query: Query) -> DataFrame:
    """The query's rows in order. A negative limit is none."""
    rows = filtered(catalog, query).orderBy(*order_of(query))
    return rows.limit(query.limit) if query.limit is not None and query.limit >= 0 else rows


def run_ranked(catalog: Catalog, query: Query) -> DataFrame:
    """The query's rows with their place in the order as a column."""
    rows = filtered(catalog, query)
    if query.limit is not None and query.limit >= 0:
        return ranked_top(rows, query.limit, *order_of(query))
    return ranked(rows, *order_of(query))


def file_count(catalog: Catalog) -> DataFrame:
    return present(catalog).agg(F.count(F.lit(1)).alias("n"))


def file_by_path(catalog: Catalog, path: str) -> DataFrame:
    """At most one row, missing ones included."""
    return catalog.files.filter(F.col("path") == path)


def _of_content(rows: DataFrame, contents: str | DataFrame) -> DataFrame:
    if isinstance(contents, DataFrame):
        return rows.join(contents.select("content_hash").distinct(), "content_hash", "left_semi").select(*rows.columns)
    return rows.filter(F.col("content_hash") == contents)


def files_by_hash(catalog: Catalog, contents: str | DataFrame) -> DataFrame:
    """All files, missing ones too, of one content or of a column of contents, by path."""
    return _of_content(catalog.files, contents).orderBy("path")


def missing_file_by_hash(catalog: Catalog, contents: str | DataFrame) -> DataFrame:
    """The first missing file, by path, of one content or of each of a column of contents."""
    rows = _of_content(catalog.files.filter("missing"), contents)
    first = rows.groupBy("content_hash").agg(F.min_by(F.struct(*FILE_COLUMNS), "path").alias("file"))
    return first.select("file.*")


def paths_under(catalog: Catalog, root: str) -> DataFrame:
    return present(catalog).filter(in_subtree("path", root)).select("path")


def paths_needing_enrichment(catalog: Catalog, limit: int | None = None) -> DataFrame:
    """id and path of present files that were not decoded yet; with a limit the first by id."""
    waiting = present(catalog).filter(F.col("width").isNull()).select("id", "path")
    return waiting if limit is None else waiting.orderBy("id").limit(limit)


def tags_for_hash(catalog: Catalog, content_hash: str) -> DataFrame:
    found = catalog.file_tags.filter(F.col("content_hash") == content_hash).join(catalog.tags, F.col("tag_id") == F.col("id"))
    return found.select("name").orderBy(ascii_fold("name"), "name")


def hashes_with_tag(catalog: Catalog, name: str) -> DataFrame:
    return hashes_with_any(catalog, [name.strip()]).select("content_hash").distinct()


def tag_names(catalog: Catalog) -> DataFrame:
    return catalog.tags.select("name").orderBy(ascii_fold("name"), "name")


def tag_cloud(catalog: Catalog) -> DataFrame:
    """Every tag with the number of different contents that carry it and have a present file."""
    contents = catalog.files.filter(~F.col("missing")).select("content_hash").distinct()
    counts = catalog.file_tags.join(contents, "content_hash", "left_semi").groupBy("tag_id").agg(F.countDistinct("content_hash").alias("n"))
    joined = catalog.tags.join(counts, F.col("id") == F.col("tag_id"), "left")
    return joined.select("id", "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")).orderBy(ascii_fold("name"), "name")


def search_tags(catalog: Catalog, needle: str) -> DataFrame:
    return catalog.tags.filter(F.contains(F.lower("name"), F.lit(needle.lower())) | F.lit(not needle)).select("name")


def ratings_under(catalog: Catalog, folder: str) -> DataFrame:
    """Present files of a subtree with rating (0), orientation (1) and crop (null unless complete)."""
    rows = present(catalog).filter(in_subtree("path", folder)).select("path", "content_hash", "date_taken")
    crop = F.when(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull(), F.struct("x", "y", "w", "h"))
    edits = [catalog.ratings.select("content_hash", "rating"), catalog.orientations.select("content_hash", F.col("orientation").alias("turned")), catalog.crops.select("content_hash", "x", "y", "w", "h")]
    for table in edits:
        rows = rows.join(table, "content_hash", "left")
    return rows.select("path", "content_hash", F.coalesce("rating", F.lit(0)).cast("bigint").alias("rating"), F.coalesce("turned", F.lit(1)).cast("bigint").alias("orientation"), crop.alias("crop"), "date_taken")


def stamped(items: DataFrame, catalog: Catalog, folder: str) -> DataFrame:
    """Grid items with fresh annotations by path; items that are not indexed keep what they had."""
    new = ratings_under(catalog, folder).select("path", *[F.col(c).alias(f"new_{c}") for c in ("content_hash", "rating", "orientation", "crop", "date_taken")], F.lit(True).alias("hit"))
    joined = items.join(new, "path", "left")
    replaced = {c: F.when(F.col("hit"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("content_hash", "rating", "orientation", "crop", "date_taken")}
    return joined.select(*[replaced.get(c, F.col(c)) for c in items.columns])


def stamped_pending(items: DataFrame, catalog: Catalog, folder: str) -> DataFrame:
    """As stamped, for items that have no content hash yet: the others are not joined."""
    pending = F.coalesce(F.col("content_hash"), F.lit("")) == ""
    return items.filter(~pending).unionByName(stamped(items.filter(pending), catalog, folder))


def selected_hashes(selection: DataFrame) -> DataFrame:
    """Contents of selected items (ord, content_hash) that have been hashed, in order, repeats kept."""
    return selection.filter(F.col("content_hash") != "").select("ord", "content_hash").orderBy("ord")


def current_filter_query(min_rating: int, tag: str | None) -> Query | None:
    """What the grid's filter would save as a smart collection; None if it filters nothing."""
    if min_rating <= 0 and not tag:
        return None
    return Query(rating_min=min_rating if min_rating > 0 else None, tags_any=[tag] if tag else [])


def dir_children(catalog: Catalog, folder: str) -> DataFrame:
    """Names of the immediate sub-folders that hold files, hidden ones left out."""
    base = folder.rstrip("/") + "/"
    rest = F.substring("path", F.lit(len(base) + 1), F.length("path"))
    name = F.regexp_extract(rest, "^([^/]+)/", 1)
    return present(catalog).filter(in_subtree("path", folder)).select(name.alias("name")).filter("name != '' AND name NOT LIKE '.%'").distinct().orderBy(F.lower("name"), "name")
