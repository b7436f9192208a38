"""Further registered queries: transitions of the catalogue, scalars, rasters, stores and caches.

As in ``queries``: each comes with the SQL that gives the same rows from the derived tables.
"""

from __future__ import annotations

from functools import reduce
from pathlib import Path
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import columns as fn
from .functions import hashing, pixels
from .operators import annotate, cache, collections, dedup, export, grid, query
from .operators.query import Query
from .plans.components import shared_folder
from .plans.ranking import ranked
from .queries import _EXACT, _ITEMS, register
from .sources import catalog, images
from .sources.catalog import Catalog, Store
from .sources.schema import SCHEMAS
from .streaming import oplog


def _own(c: Catalog) -> DataFrame:
    """The files outside of the sandbox, with the documents' numbers."""
    return c.files.filter("path LIKE '/lib/%'").withColumn("doc_id", F.col("id") - 1)


# --- files ---------------------------------------------------------------------------------


@register("file_lookup", "SELECT id, path, content_hash, size, missing FROM files WHERE path = (SELECT max(path) FROM files WHERE missing)")
def _lookup(c):
    path = c.files.filter("missing").agg(F.max("path").alias("p")).first()["p"]
    return query.file_by_path(c, path).select("id", "path", "content_hash", "size", "missing")


@register("enrichment_set", "SELECT path, CASE WHEN hit AND doc_id % 12 = 0 THEN NULL WHEN hit THEN doc_id END AS phash, CASE WHEN hit AND doc_id % 12 = 0 THEN 0 WHEN hit THEN 640 ELSE width END AS width, CASE WHEN hit AND doc_id % 12 = 0 THEN 0 WHEN hit THEN 480 ELSE height END AS height, CASE WHEN NOT hit THEN camera END AS camera FROM (SELECT *, doc_id % 4 = 0 AS hit FROM own) UNION ALL SELECT path, NULL, width, height, camera FROM files WHERE path LIKE '/run/%'")
def _enrichment(c):
    failed = F.col("doc_id") % 12 == 0
    nothing = {n: F.lit(None).cast(t).alias(n) for n, t in (("format", "string"), ("date_taken", "bigint"), ("camera", "string"), ("orientation", "bigint"))}
    found = _own(c).filter("doc_id % 4 = 0").select("path", F.when(~failed, F.col("doc_id")).alias("phash"), F.when(failed, 0).otherwise(640).alias("width"), F.when(failed, 0).otherwise(480).alias("height"), *nothing.values())
    after = annotate.set_enrichment(c, found.unionByName(found.withColumn("path", F.concat(F.lit("/absent"), "path"))))
    kept = F.when(F.col("path").like("/lib/%") & (((F.col("id") - 1) % 4) == 0), F.col("phash"))
    return after.files.select("path", kept.alias("phash"), "width", "height", "camera")


@register("image_headers", "SELECT path, CASE doc_id % 4 WHEN 0 THEN 'PNG' WHEN 1 THEN 'GIF' WHEN 2 THEN 'BMP' END AS format, CASE WHEN doc_id % 4 = 3 THEN 0 ELSE 1 + doc_id % 200 END AS width, CASE WHEN doc_id % 4 = 3 THEN 0 ELSE 1 + doc_id % 100 END AS height FROM own")
def _headers(c):
    """Headers of three formats, and bytes that are none, as the enrichment reads them."""
    return images.enriched(_own(c).select("path", _header_bytes(F.col("doc_id")).alias("content"))).select("path", "format", "width", "height")


def _header_bytes(number: Column) -> Column:
    width, height = number % 200 + 1, number % 100 + 1
    big = lambda x: F.unhex(F.lpad(F.hex(x), 8, "0"))
    little = lambda x, n: F.substring(F.concat(F.unhex(F.lpad(F.hex(x), 2, "0")), F.unhex(F.lit("00" * n))), 1, n)
    raw = lambda text: F.unhex(F.lit(text))
    png = F.concat(raw("89504e470d0a1a0a0000000d49484452"), big(width), big(height), raw("0802000000"))
    gif = F.concat(raw("474946383961"), little(width, 2), little(height, 2))
    bmp = F.concat(raw("424d" + "00" * 16), little(width, 4), little(height, 4), raw("00" * 4))
    kind = number % 4
    return F.when(kind == 0, png).when(kind == 1, gif).when(kind == 2, bmp).otherwise(F.encode(F.lit("no image"), "UTF-8"))


@register("image_paths", "SELECT path || ext AS path, ext IN ('.JPG', '.x.heic', '.svg') AS is_image, regexp_extract(lower(ext), '([^.]*)$', 1) AS kind FROM (SELECT path, ['.JPG', '.x.heic', '.svg', '.txt', '.jpg~'][1 + doc_id % 5] AS ext FROM own)")
def _image_paths(c):
    ext = F.element_at(F.array(*map(F.lit, [".JPG", ".x.heic", ".svg", ".txt", ".jpg~"])), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = _own(c).select(F.concat("path", ext).alias("path"))
    return rows.select("path", fn.is_image_path("path").alias("is_image"), fn.extension("path").alias("kind"))


@register("supported_types", "SELECT path, doc_id % 4 IN (0, 1) AS supported FROM own")
def _supported(c):
    kinds = F.array(*map(F.lit, ["image/png", "image/svg+xml", "text/plain", "image/x-unknown"]))
    return _own(c).select("path", fn.is_supported_image(F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int"))).alias("supported"))


@register("content_hashes", "SELECT id, md5(path) AS md5, sha256(path) AS sha256 FROM files")
def _hashes(c):
    content = F.encode("path", "UTF-8")
    return c.files.select("id", hashing.content_hash(content, "md5").alias("md5"), hashing.content_hash(content, "sha256").alias("sha256"))


# --- annotations ---------------------------------------------------------------------------

_LAST = "SELECT content_hash, max(doc_id) AS doc_id FROM own WHERE doc_id % {n} = {k} GROUP BY content_hash"


@register("comments_set", f", last AS ({_LAST.format(n=5, k=0)}) SELECT content_hash, body FROM comments WHERE content_hash NOT IN (SELECT content_hash FROM last) UNION ALL SELECT content_hash, 'new ' || doc_id FROM last WHERE doc_id % 3 = 1")
def _comments(c):
    body = F.when(F.col("doc_id") % 3 == 0, F.lit(" \t ")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("　 new "), F.col("doc_id").cast("string"), F.lit("\n")))
    changes = _own(c).filter("doc_id % 5 = 0").select(F.col("doc_id").alias("seq"), "content_hash", body.alias("body"), F.lit(0).alias("updated_at"))
    return annotate.apply_changes(c, "comments", changes).comments.select("content_hash", "body")


@register("orientations_set", f", last AS ({_LAST.format(n=3, k=1)}) SELECT content_hash, turned AS orientation FROM orientations WHERE content_hash NOT IN (SELECT content_hash FROM last) UNION ALL SELECT content_hash, least(doc_id % 12, 8) FROM last WHERE doc_id % 12 > 1")
def _orientations(c):
    changes = _own(c).filter("doc_id % 3 = 1").select(F.col("doc_id").alias("seq"), "content_hash", (F.col("doc_id") % 12).alias("orientation"), F.lit(0).alias("updated_at"))
    return annotate.apply_changes(c, "orientations", changes).orientations.select("content_hash", "orientation")


@register("crops_set", f", last AS ({_LAST.format(n=4, k=0)}) SELECT content_hash, x, y, w, h FROM crops WHERE content_hash NOT IN (SELECT content_hash FROM last) UNION ALL SELECT content_hash, (doc_id % 10) / 16.0, 0.125, 0.5, 0.75 FROM last WHERE doc_id % 8 = 4")
def _crops(c):
    kept = F.col("doc_id") % 8 == 4
    changes = _own(c).filter("doc_id % 4 = 0").select(F.col("doc_id").alias("seq"), "content_hash", F.when(kept, (F.col("doc_id") % 10) / 16.0).alias("x"), F.lit(0.125).alias("y"), F.lit(0.5).alias("w"), F.lit(0.75).alias("h"), F.lit(0).alias("updated_at"))
    return annotate.apply_changes(c, "crops", changes).crops.select("content_hash", "x", "y", "w", "h")


def _rated(name: str, value: int, kept: str) -> None:
    @register(name, f", chosen AS (SELECT DISTINCT content_hash FROM own WHERE doc_id % 7 = 2) SELECT content_hash, rating FROM ratings WHERE content_hash NOT IN (SELECT content_hash FROM chosen){kept}")
    def _rate(c):
        items = _own(c).filter("doc_id % 7 = 2").select("doc_id", "content_hash")
        unhashed = items.withColumn("content_hash", F.lit(""))
        selection = items.unionByName(unhashed).withColumnRenamed("doc_id", "ord")
        return annotate.rate_selection(c, query.selected_hashes(selection), value).ratings.select("content_hash", "rating")


_rated("rate_selection", 4, " UNION ALL SELECT content_hash, 4 FROM chosen")
_rated("unrate_selection", 0, "")


@register("selected_hashes", "SELECT doc_id AS ord, content_hash FROM own WHERE doc_id % 6 <> 0")
def _selected(c):
    blank = F.when(F.col("doc_id") % 6 == 0, F.lit("")).otherwise(F.col("content_hash"))
    return query.selected_hashes(_own(c).select(F.col("doc_id").alias("ord"), blank.alias("content_hash")))


_OPS = """,
ops AS (
  SELECT doc_id AS seq, content_hash, CASE doc_id % 5 WHEN 0 THEN 'rate' WHEN 1 THEN 'comment' WHEN 2 THEN 'orient' WHEN 3 THEN 'tag' ELSE 'untag' END AS op,
    CASE doc_id % 5 WHEN 0 THEN (doc_id % 8)::VARCHAR WHEN 1 THEN 'c' || doc_id WHEN 2 THEN (doc_id % 9)::VARCHAR ELSE ['BEACH', 'sunset', 'op tag'][1 + doc_id % 3] END AS value FROM own),
last AS (
  SELECT * FROM ops QUALIFY row_number() OVER (PARTITION BY content_hash, CASE WHEN op IN ('tag', 'untag') THEN 'tags ' || lower(value) ELSE op END ORDER BY seq DESC) = 1)
"""


def _ops(c: Catalog) -> DataFrame:
    which = F.col("doc_id") % 5
    op = F.element_at(F.array(*map(F.lit, ["rate", "comment", "orient", "tag", "untag"])), (which + 1).cast("int"))
    name = F.element_at(F.array(*map(F.lit, [" BEACH", "sunset", "op tag "])), (F.col("doc_id") % 3 + 1).cast("int"))
    value = F.when(which == 0, (F.col("doc_id") % 8).cast("string")).when(which == 1, F.concat(F.lit("c"), F.col("doc_id").cast("string"))).when(which == 2, (F.col("doc_id") % 9).cast("string")).otherwise(name)
    return _own(c).select(F.col("doc_id").alias("seq"), op.alias("op"), "content_hash", value.alias("value"))


_OPS_STATE = _OPS + """
SELECT 'rating' AS section, content_hash, rating::VARCHAR AS value FROM ratings WHERE content_hash NOT IN (SELECT content_hash FROM last WHERE op = 'rate')
UNION ALL SELECT 'rating', content_hash, least(value::INT, 5)::VARCHAR FROM last WHERE op = 'rate' AND value::INT > 0
UNION ALL SELECT 'comment', content_hash, body FROM comments WHERE content_hash NOT IN (SELECT content_hash FROM last WHERE op = 'comment')
UNION ALL SELECT 'comment', content_hash, value FROM last WHERE op = 'comment'
UNION ALL SELECT 'orientation', content_hash, turned::VARCHAR FROM orientations WHERE content_hash NOT IN (SELECT content_hash FROM last WHERE op = 'orient')
UNION ALL SELECT 'orientation', content_hash, value FROM last WHERE op = 'orient' AND value::INT > 1
UNION ALL SELECT 'tag', content_hash, fold FROM tagged ANTI JOIN (SELECT content_hash, lower(value) AS fold FROM last WHERE op = 'untag') USING (content_hash, fold)
UNION ALL SELECT 'tag', content_hash, lower(value) FROM last WHERE op = 'tag' AND (content_hash, lower(value)) NOT IN (SELECT (content_hash, fold) FROM tagged)"""


@register("oplog_apply", _OPS_STATE)
def _oplog(c):
    return op_state(oplog.apply_ops(c, _ops(c)))


def op_state(after: Catalog) -> DataFrame:
    """What an operation log acts on: ratings, comments, orientations and tags as rows of text."""
    tags = after.file_tags.join(after.tags, F.col("tag_id") == F.col("id")).select("content_hash", fn.ascii_fold("name").alias("value"))
    parts = {"rating": after.ratings.select("content_hash", F.col("rating").cast("string").alias("value")), "comment": after.comments.select("content_hash", F.col("body").alias("value")), "orientation": after.orientations.select("content_hash", F.col("orientation").cast("string").alias("value")), "tag": tags}
    return reduce(DataFrame.unionByName, [rows.select(F.lit(name).alias("section"), "content_hash", "value") for name, rows in parts.items()])


@register("save_in_place", ", one AS (SELECT min(path) AS path FROM own WHERE content_hash = (SELECT min(content_hash) FROM ratings)), old AS (SELECT min(content_hash) AS h FROM ratings) SELECT 'file' AS section, path, CASE WHEN path = (SELECT path FROM one) THEN 'rewritten' ELSE content_hash END AS content_hash FROM files UNION ALL SELECT 'rating', rating::VARCHAR, CASE WHEN content_hash = h THEN 'rewritten' ELSE content_hash END FROM ratings, old UNION ALL SELECT 'turned', turned::VARCHAR, content_hash FROM orientations, old WHERE content_hash <> h")
def _in_place(c):
    old = c.ratings.agg(F.min("content_hash").alias("h")).first()["h"]
    record = _own(c).filter(F.col("content_hash") == old).orderBy("path").limit(1).withColumn("content_hash", F.lit("rewritten")).drop("doc_id")
    after = annotate.save_in_place(c, record, old)
    return after.files.select(F.lit("file").alias("section"), "path", "content_hash").unionByName(after.ratings.select(F.lit("rating").alias("section"), F.col("rating").cast("string").alias("path"), "content_hash")).unionByName(after.orientations.select(F.lit("turned").alias("section"), F.col("orientation").cast("string").alias("path"), "content_hash"))


# --- collections ---------------------------------------------------------------------------

_SAVED = '{"under":null,"tags_all":[],"tags_any":["Beach"],"rating_min":3,"camera":null,"format":null,"date_from":null,"date_to":null,"orientation":null,"sort":"Name","direction":"Asc","limit":null}'


@register("collections_edit", f"SELECT id, name, kind, query FROM (VALUES (1::BIGINT, 'Journey', 'catalog', NULL), (4, 'beach or sunset', 'smart', '{{\"tags_any\":[\"BEACH\",\"sunset\"],\"sort\":\"DateTaken\",\"direction\":\"Desc\"}}'), (3, 'Top rated', 'smart', '{{\"rating_min\":4}}'), (5, 'Found', 'smart', '{_SAVED}'), (6, 'Empty', 'catalog', NULL)) t(id, name, kind, query)")
def _edit(c):
    c = annotate.create_smart_collection(c, "Found", query.current_filter_query(3, "Beach"))
    c = annotate.create_catalog(c, "Empty")
    return annotate.delete_collection(annotate.rename_collection(c, 1, "Journey"), 2).collections.select("id", "name", "kind", "query")


@register("collection_delete", "SELECT collection_id, content_hash, position FROM collection_items WHERE collection_id <> 2")
def _delete(c):
    return annotate.delete_collection(c, 2).collection_items.select("collection_id", "content_hash", "position")


@register("saved_filter", "SELECT path, row_number() OVER (ORDER BY path) AS rank FROM present WHERE content_hash IN (SELECT content_hash FROM ratings WHERE rating >= 3) AND content_hash IN (SELECT content_hash FROM tagged WHERE fold = 'beach')")
def _saved(c):
    """The grid's filter, saved as a smart collection and opened again."""
    c = annotate.create_smart_collection(c, "Found", query.current_filter_query(3, "Beach"))
    return query.run_ranked(c, collections.stored_query(c, 5)).select("path", "rank")


@register("catalog_remove", "SELECT collection_id, content_hash, position FROM collection_items WHERE NOT (collection_id = 1 AND content_hash IN (SELECT content_hash FROM own WHERE doc_id % 30 = 0))")
def _remove(c):
    gone = _own(c).filter("doc_id % 30 = 0").select("content_hash")
    return annotate.delete_or_remove(c, 1, gone).collection_items.select("collection_id", "content_hash", "position")


@register("collection_kinds", "SELECT id, CASE WHEN kind = 'smart' THEN 'smart' ELSE 'catalog' END AS kind FROM (SELECT id, CASE id % 3 WHEN 0 THEN 'smart' WHEN 1 THEN 'Smart' ELSE 'other' END AS kind FROM own)")
def _kinds(c):
    text = F.element_at(F.array(*map(F.lit, ["smart", "Smart", "other"])), (F.col("id") % 3 + 1).cast("int"))
    return _own(c).select("id", fn.collection_kind(text).alias("kind"))


_DURABLE_OF = "SELECT *, min(regexp_matches(path, '^/run/user/[0-9]*/doc/')::INT) OVER (PARTITION BY content_hash) AS best FROM"


@register("open_smart", f", picked AS (SELECT * FROM ({_DURABLE_OF} (SELECT * FROM present WHERE content_hash IN (SELECT content_hash FROM ratings WHERE rating >= 4))) WHERE regexp_matches(path, '^/run/user/[0-9]*/doc/')::INT = best) SELECT path, content_hash, rating FROM picked JOIN ratings USING (content_hash) WHERE id % 4 <> 1")
def _open_smart(c):
    return collections.open_collection(c, 3, c.files.filter("id % 4 <> 1").select("path"))


@register("open_catalog", f", reps AS (SELECT * FROM present QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY path ILIKE '/run/user/%/doc/%', path) = 1) SELECT p.path, p.content_hash, coalesce(r.rating, 0) AS rating FROM reps p JOIN collection_items i USING (content_hash) LEFT JOIN ratings r USING (content_hash) WHERE i.collection_id = 2 AND p.id % 4 <> 1")
def _open_catalog(c):
    return collections.open_collection(c, 2, c.files.filter("id % 4 <> 1").select("path"))


@register("drop_totals", "SELECT count(*) FILTER (WHERE doc_id % 2 = 0) AS by_path, count(*) FILTER (WHERE doc_id % 2 = 1 AND doc_id % 3 <> 0 AND content_hash IN (SELECT content_hash FROM present)) AS by_hash, count(*) FILTER (WHERE doc_id % 2 = 1 AND doc_id % 3 = 0) AS unhashable, count(*) FILTER (WHERE doc_id % 2 = 1 AND doc_id % 3 <> 0 AND content_hash NOT IN (SELECT content_hash FROM present)) AS unknown, count(DISTINCT CASE WHEN doc_id % 2 = 0 OR (doc_id % 3 <> 0 AND content_hash IN (SELECT content_hash FROM present)) THEN content_hash END) AS kept FROM own")
def _drop_totals(c):
    odd = F.col("doc_id") % 2 == 1
    dropped = _own(c).select(F.col("doc_id").alias("ord"), F.when(odd, F.concat(F.lit("/else"), "path")).otherwise(F.col("path")).alias("path"), F.when(F.col("doc_id") % 3 != 0, F.col("content_hash")).alias("hash"))
    return collections.drop_totals(collections.resolve_drop(c, dropped))


# --- trash ---------------------------------------------------------------------------------


@register("trash_duplicates", _EXACT + "SELECT path, missing OR path IN (SELECT path FROM clusters WHERE rank > 1 AND length(path) % 2 = 0) AS missing FROM files")
def _trash(c):
    found = dedup.exact_duplicates(c)
    return annotate.trash_others(c, found, c.files.filter("length(path) % 2 = 0")).files.select("path", "missing")


@register("trash_selected", "SELECT path, content_hash FROM present WHERE NOT (id % 3 = 0 AND id % 2 = 0)")
def _trash_selected(c):
    """Of the selection (a third) only what was moved to the trash (every other) leaves the view."""
    view = query.present(c).select("id", "path", "content_hash")
    moved = view.filter("id % 3 = 0 AND id % 2 = 0").select("path")
    return annotate.trashed_view(view, moved).select("path", "content_hash")


# --- grid ----------------------------------------------------------------------------------


def _items(c: Catalog) -> DataFrame:
    """Grid items that carry old annotations; a third have not been hashed."""
    known = F.col("id") % 3 != 0
    return query.present(c).select("path", F.when(known, F.col("content_hash")).otherwise(F.lit("")).alias("content_hash"), F.lit(9).cast("bigint").alias("rating"), F.lit(1).cast("bigint").alias("orientation"), F.lit(None).cast("struct<x:double,y:double,w:double,h:double>").alias("crop"), F.lit(None).cast("bigint").alias("date_taken"))


_STAMP = "SELECT p.path, CASE WHEN {hit} THEN p.content_hash WHEN p.id % 3 <> 0 THEN p.content_hash ELSE '' END AS content_hash, CASE WHEN {hit} THEN coalesce(r.rating, 0) ELSE 9 END AS rating, CASE WHEN {hit} THEN c.w END AS w, CASE WHEN {hit} THEN p.date_taken END AS date_taken FROM present p LEFT JOIN ratings r USING (content_hash) LEFT JOIN crops c USING (content_hash)"
_UNDER = "(p.path >= '/lib/src1/' AND p.path < '/lib/src10')"


@register("stamp_items", _STAMP.format(hit=_UNDER))
def _stamp(c):
    return query.stamped(_items(c), c, "/lib/src1").select("path", "content_hash", "rating", "crop.w", "date_taken")


@register("stamp_pending", _STAMP.format(hit=f"({_UNDER} AND p.id % 3 = 0)"))
def _pending(c):
    return query.stamped_pending(_items(c), c, "/lib/src1").select("path", "content_hash", "rating", "crop.w", "date_taken")


def _nearest(name: str, limit: int) -> None:
    @register(name, f"SELECT path, (id * 7919 % 100003) AS pos FROM present QUALIFY row_number() OVER (ORDER BY abs(id * 7919 % 100003 - 50000), id * 7919 % 100003) <= {limit}")
    def _near(c):
        return grid.nearest(query.present(c).select("path", (F.col("id") * 7919 % 100003).alias("pos")), "pos", 50000.0, limit)


_nearest("nearest_items", grid.GRID_QUEUE)
_nearest("filmstrip_queue", grid.STRIP_QUEUE)


@register("script_folder", _ITEMS + "SELECT path, 'script:By type and length' AS field, 'name' AS fallback, row_number() OVER (ORDER BY type || ' ' || lpad(length(name)::VARCHAR, 4, '0'), lower(name), path) AS rank FROM items")
def _script_folder(c):
    """An order from a folder of scripts, found again by its stored id; an id without provider is by name."""
    keys = grid.SortKeys()
    keys.load_dir(str(Path(__file__).parent / "orders"))
    field = keys.field_id("By type and length")
    rows = ranked(keys.keyed(grid.grid(c), keys.from_field_id(field)), *keys.order())
    return rows.select("path", F.lit(field).alias("field"), F.lit(keys.from_field_id("script:absent")).alias("fallback"), "rank")


# --- scalars -------------------------------------------------------------------------------


@register("exif_texts", "SELECT id, CASE id % 4 WHEN 0 THEN 'NIKON ' || id WHEN 1 THEN 'a b' WHEN 2 THEN NULL ELSE 'x' END AS label, CASE WHEN id % 12 BETWEEN 1 AND 8 THEN id % 12 END AS turned FROM own")
def _exif_texts(c):
    which = F.col("id") % 4
    raw = F.when(which == 0, F.concat(F.lit(" \x00NIKON "), F.col("id").cast("string"), F.lit("\x00\x00 "))).when(which == 1, F.lit("\ta b\n")).when(which == 2, F.lit(" \x00 ")).otherwise(F.lit("x"))
    return _own(c).select("id", fn.exif_text(raw).alias("label"), fn.orientation_or_null(F.col("id") % 12).alias("turned"))


@register("trimmed_names", "SELECT id, 'name ' || id AS name FROM own")
def _trimmed(c):
    pads = F.element_at(F.array(*map(F.lit, [" ", "　\t", "\n  ", ""])), (F.col("id") % 4 + 1).cast("int"))
    return _own(c).select("id", fn.trimmed(F.concat(pads, F.lit("name "), F.col("id").cast("string"), pads)).alias("name"))


@register("texture_costs", "SELECT path, width * height * 4 AS cost FROM files")
def _costs(c):
    return c.files.select("path", fn.texture_cost("width", "height").alias("cost"))


@register("bookmark_names", "SELECT path || tail AS path, CASE WHEN root THEN '///' ELSE regexp_extract(path, '[^/]*$') END AS name FROM (SELECT CASE WHEN id % 5 = 0 THEN '' ELSE path END AS path, ['', '/', '//'][1 + id % 3] AS tail, id % 5 = 0 AS root FROM own WHERE id % 5 <> 0) UNION ALL SELECT '///', '///'")
def _bookmarks(c):
    tail = F.element_at(F.array(*map(F.lit, ["", "/", "//"])), (F.col("id") % 3 + 1).cast("int"))
    rows = _own(c).filter("id % 5 <> 0").select(F.concat("path", tail).alias("path"))
    return rows.unionByName(c.spark.createDataFrame([("///",)], "path string")).select("path", fn.default_bookmark_name("path").alias("name"))


@register("crop_within", "SELECT id, (CASE WHEN id % 3 = 0 THEN 0.25 ELSE 0.5 + 0.25 * 0.25 END)::DOUBLE AS x, (CASE WHEN id % 3 = 0 THEN 0.5 ELSE 0.25 + 0.5 * 0.5 END)::DOUBLE AS y, (CASE WHEN id % 3 = 0 THEN 0.5 ELSE 0.5 * 0.25 END)::DOUBLE AS w, (CASE WHEN id % 3 = 0 THEN 0.25 ELSE 0.25 * 0.5 END)::DOUBLE AS h FROM own")
def _crop_within(c):
    rect = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, "xywh", strict=True)])
    existing = F.when(F.col("id") % 3 != 0, rect(0.5, 0.25, 0.25, 0.5))
    return _own(c).select("id", fn.crop_within(existing, rect(0.25, 0.5, 0.5, 0.25)).alias("r")).select("id", "r.*")


@register("view_geometry", "SELECT id, least(800.0 / (1 + id % 50), 600.0 / (1 + id % 30)) AS scale, least(greatest((id % 500) / 20.0, 0.05), 20.0) AS zoom FROM own")
def _geometry(c):
    width, height = F.col("id") % 50 + 1, F.col("id") % 30 + 1
    return _own(c).select("id", fn.fit_scale(width, height, F.lit(800.0), F.lit(600.0)).alias("scale"), fn.clamp_zoom((F.col("id") % 500) / 20.0).alias("zoom"))


@register("selection_rects", "SELECT id, CASE WHEN x0 < 400 THEN x0 / 400.0 END AS x, CASE WHEN x0 < 400 THEN 0.25::DOUBLE END AS y, CASE WHEN x0 < 400 THEN 1 - x0 / 400.0 END AS w, CASE WHEN x0 < 400 THEN 0.5::DOUBLE END AS h FROM (SELECT id, (id % 6) * 100 AS x0 FROM own)")
def _rects(c):
    """A 400 x 200 picture fills a 400 x 400 view's middle; the drag ends beyond its right edge."""
    start = F.col("id") % 6 * 100
    size = [F.lit(float(v)) for v in (400, 200, 400, 400)]
    rect = fn.selection_rect(start, F.lit(150.0), F.lit(900.0), F.lit(250.0), *size)
    return _own(c).select("id", rect.alias("r")).select("id", "r.*")


@register("star_toggle", "SELECT id, CASE WHEN id % 6 = 1 + id % 5 THEN 0 ELSE 1 + id % 5 END AS rating FROM own")
def _toggle(c):
    return _own(c).select("id", fn.toggled_star(F.col("id") % 6, F.col("id") % 5 + 1).alias("rating"))


@register("human_sizes", "SELECT id, CASE WHEN n <= 0 THEN '0 bytes' WHEN n = 1 THEN '1 byte' WHEN n < 1000 THEN n || ' bytes' WHEN n < 1000000 THEN printf('%.1f kB', n / 1e3) WHEN n < 1000000000 THEN printf('%.1f MB', n / 1e6) ELSE printf('%.1f GB', n / 1e9) END AS shown FROM (SELECT id, CASE id % 4 WHEN 0 THEN id - 3 WHEN 1 THEN id * 1024 WHEN 2 THEN id * 1048573 ELSE id * 1073741789 END AS n FROM own) WHERE n < 1000000000000")
def _sizes(c):
    i = F.col("id")
    n = F.when(i % 4 == 0, i - 3).when(i % 4 == 1, i * 1024).when(i % 4 == 2, i * 1048573).otherwise(i * 1073741789)
    return _own(c).select("id", n.alias("n")).filter("n < 1000000000000").select("id", fn.human_size("n").alias("shown"))


@register("edit_keys", "SELECT id, CASE WHEN id % 9 > 1 THEN '#o' || (id % 9) ELSE '' END || CASE WHEN id % 2 = 0 THEN printf('#c%.3f,%.3f,%.3f,%.3f', (id % 8) / 8.0, 0.125, 0.5, 1.0) ELSE '' END AS key FROM own")
def _edit_keys(c):
    rect = F.struct(((F.col("id") % 8) / 8.0).alias("x"), F.lit(0.125).alias("y"), F.lit(0.5).alias("w"), F.lit(1.0).alias("h"))
    return _own(c).select("id", fn.edit_key(F.col("id") % 9, F.when(F.col("id") % 2 == 0, rect)).alias("key"))


# --- rasters: the 16 bytes of a content hash are 2 x 2 RGBA pixels ----------------------------

_PIXELS = ", px AS (SELECT path, doc_id, content_hash AS h, [substr(content_hash, 1, 8), substr(content_hash, 9, 8), substr(content_hash, 17, 8), substr(content_hash, 25, 8)] AS p FROM own)"


def _raster(c: Catalog, orientation: Column | None = None, crop: Column | None = None, padded: bool = False) -> DataFrame:
    data = F.unhex("content_hash")
    if padded:
        pad = F.encode(F.lit("???"), "UTF-8")
        data = F.concat(F.substring(data, 1, 8), pad, F.substring(data, 9, 8), pad)
    none = F.lit(None).cast("double")
    rect = {n: (crop[n] if crop is not None else none).alias(n) for n in "xywh"}
    turned = (orientation if orientation is not None else F.lit(None)).cast("long").alias("orientation")
    return _own(c).select("path", data.alias("data"), F.lit(2).cast("long").alias("width"), F.lit(2).cast("long").alias("height"), F.lit(11 if padded else 8).cast("long").alias("stride"), turned, *rect.values())


def _shown(rasters: DataFrame, longest: int | None = None) -> DataFrame:
    return pixels.transformed(rasters, longest).select("path", F.lower(F.hex("data")).alias("data"), "width", "height")


@register("rasters_oriented", _PIXELS + " SELECT path, CASE 1 + doc_id % 8 WHEN 2 THEN p[2] || p[1] || p[4] || p[3] WHEN 3 THEN p[4] || p[3] || p[2] || p[1] WHEN 4 THEN p[3] || p[4] || p[1] || p[2] WHEN 5 THEN p[1] || p[3] || p[2] || p[4] WHEN 6 THEN p[3] || p[1] || p[4] || p[2] WHEN 7 THEN p[4] || p[2] || p[3] || p[1] WHEN 8 THEN p[2] || p[4] || p[1] || p[3] ELSE h END AS data, 2::BIGINT AS width, 2::BIGINT AS height FROM px")
def _oriented(c):
    return _shown(_raster(c, orientation=F.col("doc_id") % 8 + 1))


@register("rasters_tight", _PIXELS + " SELECT path, h AS data, 2::BIGINT AS width, 2::BIGINT AS height FROM px")
def _tight(c):
    return _shown(_raster(c, padded=True))


@register("rasters_cropped", _PIXELS + " SELECT path, CASE doc_id % 3 WHEN 0 THEN p[2] || p[4] WHEN 1 THEN p[3] || p[4] END AS data, CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END::BIGINT AS width, CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END::BIGINT AS height FROM px")
def _cropped(c):
    """The right column, the lower row, and a rectangle of which nothing is left."""
    which = F.col("doc_id") % 3
    rect = F.struct(F.when(which == 0, 0.5).otherwise(0.0).alias("x"), F.when(which == 1, 0.5).otherwise(0.0).alias("y"), F.when(which == 0, 0.5).when(which == 1, 2.0).otherwise(0.0).alias("w"), F.lit(1.0).alias("h"))
    return _shown(_raster(c, crop=rect))


@register("rasters_turned_cropped", _PIXELS + " SELECT path, p[1] || p[2] AS data, 1::BIGINT AS width, 2::BIGINT AS height FROM px")
def _turned_cropped(c):
    """Orientation comes first: the right column of the picture that is turned clockwise."""
    return _shown(_raster(c, orientation=F.lit(6), crop=F.struct(F.lit(0.5).alias("x"), F.lit(0.0).alias("y"), F.lit(0.5).alias("w"), F.lit(1.0).alias("h"))))


_MEAN = " || ".join(f"printf('%02x', floor(list_sum(list_transform(p, lambda q: ('0x' || substr(q, {2 * k + 1}, 2))::BIGINT)) / 4.0 + 0.5)::BIGINT)" for k in range(4))


@register("rasters_resized", _PIXELS + f" SELECT path, {_MEAN} AS data, 1::BIGINT AS width, 1::BIGINT AS height FROM px")
def _resized(c):
    return _shown(_raster(c), longest=1)


@register("rasters_malformed", _PIXELS + " SELECT path, NULL::VARCHAR AS data, 0::BIGINT AS width, 0::BIGINT AS height FROM px")
def _malformed(c):
    return _shown(_raster(c).withColumn("height", F.lit(3).cast("long")))


# --- stores, exports, caches ---------------------------------------------------------------


@register("backup_copy", "SELECT path, content_hash, size, missing, 'one' AS value FROM files")
def _backup(c):
    """Two commits and a compact copy of the second one, opened again."""
    root = f"{shared_folder(c.spark)}/stores"
    store = Store(c.spark, _fresh(root))
    first = store.commit(annotate.set_meta(c, "state", "none"))
    second = store.commit(annotate.set_meta(first, "state", "one"))
    copy = store.backup_to(_fresh(root), second.version)
    return copy.files.select("path", "content_hash", "size", "missing", F.lit(copy.meta_value("state")).alias("value"))


def _fresh(root: str) -> str:
    return f"{root}/{uuid4().hex}"


@register("meta_values", "SELECT * FROM (VALUES ('state', 'two'), ('other', 'x')) t(key, value)")
def _meta(c):
    for key, value in (("state", "one"), ("other", "x"), ("state", "two")):
        c = annotate.set_meta(c, key, value)
    return c.meta.select("key", "value")


@register("empty_catalog", "SELECT unnest(['meta', 'files', 'tags', 'file_tags', 'ratings', 'collections', 'collection_items', 'comments', 'orientations', 'crops']) AS name, 0::BIGINT AS n")
def _empty(c):
    return _sizes_of(catalog.empty(c.spark))


def _sizes_of(c: Catalog) -> DataFrame:
    return reduce(DataFrame.unionByName, [c.table(name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name in SCHEMAS])


@register("migrated_catalog", "SELECT 'files' AS name, count(*) AS n, count(*) FILTER (WHERE missing) AS defaulted FROM files UNION ALL SELECT 'ratings', count(*), count(*) FROM ratings UNION ALL SELECT 'comments', 0, 0")
def _migrated(c):
    """A first-version snapshot: comments did not exist yet, ratings had no sync state."""
    old = {"files": c.files, "ratings": c.ratings.select("content_hash", "rating"), "comments": c.comments}
    new = catalog.migrated(c, old, 1)
    counted = lambda name, column: new.table(name).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(column, 1)).alias("defaulted")).select(F.lit(name).alias("name"), "n", "defaulted")
    return counted("files", F.col("missing")).unionByName(counted("ratings", F.col("sync_state") == "db-only")).unionByName(counted("comments", F.lit(True)))


@register("export_collections", "SELECT lpad(c.id::VARCHAR, 20, '0') AS place, c.name, c.kind, coalesce(string_agg(i.content_hash, ',' ORDER BY i.position, i.content_hash), '') AS items FROM collections c LEFT JOIN collection_items i ON i.collection_id = c.id GROUP BY c.id, c.name, c.kind")
def _export_collections(c):
    rows = export.export_rows(c).filter("section = 'collections'").select("place", F.from_json("entry", "name string, kind string, query string, items array<string>").alias("e"))
    return rows.select("place", "e.name", "e.kind", F.array_join("e.items", ",").alias("items"))


@register("import_document", "SELECT 'tag' AS section, content_hash AS place, fold AS value FROM tagged UNION ALL SELECT 'rating', content_hash, rating::VARCHAR FROM ratings UNION ALL SELECT 'comment', content_hash, body FROM comments UNION ALL SELECT 'item ' || c.name, i.content_hash, (row_number() OVER (PARTITION BY c.id ORDER BY i.position, i.content_hash) - 1)::VARCHAR FROM collections c JOIN collection_items i ON i.collection_id = c.id")
def _import_document(c):
    """The whole export as one file, read into an empty catalogue in ranges of 16 KB."""
    path = f"{shared_folder(c.spark)}/export-{uuid4().hex}.json"
    export.write_export(c, path)
    document = export.read_export(c.spark, path, 1 << 14)
    new = export.import_export(catalog.empty(c.spark), document)
    tags = new.file_tags.join(new.tags, F.col("tag_id") == F.col("id")).select(F.lit("tag").alias("section"), F.col("content_hash").alias("place"), fn.ascii_fold("name").alias("value"))
    ratings = new.ratings.select(F.lit("rating").alias("section"), F.col("content_hash").alias("place"), F.col("rating").cast("string").alias("value"))
    comments = new.comments.select(F.lit("comment").alias("section"), F.col("content_hash").alias("place"), F.col("body").alias("value"))
    items = new.collection_items.join(new.collections, F.col("collection_id") == F.col("id")).select(F.concat(F.lit("item "), "name").alias("section"), F.col("content_hash").alias("place"), F.col("position").cast("string").alias("value"))
    return tags.unionByName(ratings).unionByName(comments).unionByName(items)


@register("cache_prune", "SELECT path, size, mtime FROM (SELECT *, sum(size) OVER (ORDER BY mtime DESC, path DESC) AS held FROM (SELECT '/cache/' || ['large', 'normal', 'xx-large'][1 + id % 3] || '/' || md5(path) || '.png' AS path, size * 100 AS size, mtime FROM own)) WHERE held > 3000000")
def _prune(c):
    folder = F.element_at(F.array(*map(F.lit, ["large", "normal", "xx-large"])), (F.col("id") % 3 + 1).cast("int"))
    own = _own(c)
    held = own.select(F.concat(F.lit("/cache/"), folder, F.lit("/"), F.md5("path"), F.lit(".png")).alias("path"), (F.col("size") * 100).alias("size"), "mtime")
    stray = own.select(F.concat(F.lit("/cache/other/"), F.md5("path"), F.lit(".png")).alias("path"), "size", "mtime")
    return cache.private_evictions(held.unionByName(stray), 3)
