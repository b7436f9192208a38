"""Registered queries over the derived catalogue, each with the SQL that gives the same rows.

Order is data: queries whose order matters return it as a rank or position column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import columns as fn
from .operators import annotate, cache, collections, dedup, export, grid, query, scan
from .operators.query import Query
from .plans.ranking import ranked
from .sources.catalog import Catalog, from_testdata

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The derived tables in SQL; a query names those that it needs and the others cost nothing.
TABLES = """
WITH RECURSIVE
own AS (
  SELECT doc_id, doc_id + 1 AS id, '/lib/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, md5(text) AS content_hash,
    CASE WHEN doc_id % 7 <> 0 THEN xor(('0x' || substr(md5((n_chars % 97)::VARCHAR), 1, 15))::BIGINT, (1::BIGINT << (n_chars % 61)::INT) - 1) END AS phash,
    n_chars AS size, 1700000000 + (doc_id * 37) % 100000 AS mtime,
    CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 0 ELSE 100 + doc_id % 50 END AS width,
    CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 0 ELSE 80 + doc_id % 30 END AS height,
    CASE WHEN doc_id % 7 <> 0 THEN lang END AS format,
    CASE WHEN doc_id % 7 <> 0 AND doc_id % 3 <> 0 THEN 1500000000 + (doc_id * 86399) % 200000000 END AS date_taken,
    CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 <> 0 THEN 'CAM ' || (doc_id % 4) END AS camera,
    CASE WHEN doc_id % 7 <> 0 THEN 1 + doc_id % 8 END AS orientation,
    1700100000 + doc_id % 10 AS indexed_at, doc_id % 11 = 0 AS missing
  FROM documents),
files AS (
  SELECT * EXCLUDE (doc_id) FROM own UNION ALL
  SELECT * EXCLUDE (doc_id) REPLACE (id + 1000000 AS id, '/run/user/1000/doc/' || substr(content_hash, 1, 8) || '/' || doc_id || '.txt' AS path, false AS missing)
  FROM own WHERE doc_id % 10 = 3),
present AS (SELECT * FROM files WHERE NOT missing),
tags AS (SELECT * FROM (VALUES (1::BIGINT, 'Keeper'), (2, 'toxic'), (3, 'Beach'), (4, 'sunset'), (5, 'Unused')) t(id, name)),
file_tags AS (
  SELECT DISTINCT content_hash, tag_id FROM (
    SELECT o.content_hash, 1::BIGINT AS tag_id FROM own o JOIN labels l USING (doc_id) WHERE l.quality = 1 UNION ALL
    SELECT o.content_hash, 2 FROM own o JOIN labels l USING (doc_id) WHERE l.toxic = 1 UNION ALL
    SELECT content_hash, 3 FROM own WHERE doc_id % 4 = 0 UNION ALL
    SELECT content_hash, 4 FROM own WHERE doc_id % 6 = 0)),
ratings AS (SELECT content_hash, max(doc_id % 6) AS rating FROM own WHERE doc_id % 3 <> 0 GROUP BY content_hash),
comments AS (SELECT content_hash, 'note <' || min(doc_id) || '> & more' AS body FROM own WHERE doc_id % 9 = 0 GROUP BY content_hash),
orientations AS (SELECT content_hash, 2 + min(doc_id) % 7 AS turned FROM own WHERE doc_id % 8 = 0 GROUP BY content_hash),
crops AS (SELECT DISTINCT content_hash, 0.25::DOUBLE AS x, 0.0::DOUBLE AS y, 0.5::DOUBLE AS w, 1.0::DOUBLE AS h FROM own WHERE doc_id % 8 = 4),
collections AS (SELECT * FROM (VALUES (1::BIGINT, 'Trip', 'catalog'), (2, 'best', 'catalog'), (3, 'Top rated', 'smart'), (4, 'beach or sunset', 'smart')) t(id, name, kind)),
collection_items AS (
  SELECT 1::BIGINT AS collection_id, content_hash, min(doc_id) AS position FROM own WHERE doc_id % 15 = 0 GROUP BY content_hash UNION ALL
  SELECT 2, content_hash, -min(doc_id) FROM own WHERE doc_id % 10 = 3 GROUP BY content_hash),
tagged AS (SELECT ft.content_hash, t.name, lower(t.name) AS fold FROM file_tags ft JOIN tags t ON t.id = ft.tag_id),
durable AS (
  SELECT * EXCLUDE (portal, best) FROM (
    SELECT *, min(portal) OVER (PARTITION BY content_hash) AS best FROM (
      SELECT *, regexp_matches(path, '^/run/user/[0-9]*/doc/')::INT AS portal FROM present))
  WHERE portal = best)
"""
_ROW = "id, path, content_hash, size"


def register(name: str, sql: str | None, once: bool = False):
    """Register build(catalog) under the name, with SQL over the derived tables; once: as in from_testdata."""

    def add(build: Callable[[Catalog], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(from_testdata(spark, sf_dir, once))
        if sql is not None:
            ORACLES[name] = TABLES + sql
        return build

    return add


def _rows(df: DataFrame) -> DataFrame:
    return df.select("id", "path", "content_hash", "size")


def _filter_query(name: str, q: Query, where: str) -> None:
    register(name, f"SELECT {_ROW} FROM present WHERE {where}")(lambda c: _rows(query.filtered(c, q)))


UNDER = "path >= '/lib/src1/' AND path < '/lib/src10'"
_filter_query("files_present", Query(), "true")
_filter_query("subtree", Query(under="/lib/src1/"), UNDER)
_filter_query("by_camera", Query(camera="CAM 2"), "camera = 'CAM 2'")
_filter_query("by_format", Query(format="fr"), "format = 'fr'")
_filter_query("date_window", Query(date_from=1500086399, date_to=1560000000), "date_taken >= 1500086399 AND date_taken <= 1560000000")
_filter_query("by_orientation", Query(orientation=6), "orientation = 6")
_filter_query("tags_all", Query(tags_all=["beach", "SUNSET", "Beach"]), "content_hash IN (SELECT content_hash FROM tagged WHERE fold IN ('beach', 'sunset') GROUP BY content_hash HAVING count(DISTINCT fold) = 2)")
_filter_query("tags_any", Query(tags_any=["TOXIC", "sunset", "absent"]), "content_hash IN (SELECT content_hash FROM tagged WHERE fold IN ('toxic', 'sunset', 'absent'))")
_filter_query("rating_min", Query(rating_min=4), "content_hash IN (SELECT content_hash FROM ratings WHERE rating >= 4)")
_filter_query("rating_min_zero", Query(rating_min=0), "content_hash IN (SELECT content_hash FROM ratings WHERE rating >= 0)")
_filter_query("injection_literal", Query(camera="x'); DROP TABLE files;--"), "false")


@register("file_count", "SELECT count(*) AS n FROM present")
def _file_count(c):
    return query.file_count(c)


@register("files_by_hash", f"SELECT {_ROW}, missing FROM files WHERE content_hash = (SELECT min(content_hash) FROM collection_items WHERE collection_id = 2)")
def _files_by_hash(c):
    first = c.collection_items.filter("collection_id = 2").agg(F.min("content_hash").alias("content_hash"))
    return query.files_by_hash(c, first).select("id", "path", "content_hash", "size", "missing")


@register("missing_file_by_hash", "SELECT content_hash, min(path) AS path FROM files WHERE missing GROUP BY content_hash")
def _missing_by_hash(c):
    return query.missing_file_by_hash(c, c.files.select("content_hash")).select("content_hash", "path")


@register("paths_under", f"SELECT path FROM present WHERE {UNDER}")
def _paths_under(c):
    return query.paths_under(c, "/lib/src1")


@register("enrichment_queue", "SELECT id, path FROM present WHERE width IS NULL ORDER BY id LIMIT 64")
def _queue(c):
    return query.paths_needing_enrichment(c, 64)


# --- orders --------------------------------------------------------------------------------

_SORTS = {"name": ("Name", "path"), "date": ("DateTaken", "date_taken"), "size": ("Size", "size"), "mtime": ("Mtime", "mtime"), "area": ("Area", "width * height"), "indexed": ("IndexedAt", "indexed_at")}
for _name, (_key, _sql) in _SORTS.items():
    for _word in ("Asc", "Desc"):
        _q = Query(sort=_key, direction=_word)
        register(f"sort_{_name}_{_word.lower()}", f"SELECT path, row_number() OVER (ORDER BY {_sql} {_word} NULLS LAST, path) AS rank FROM present")(lambda c, q=_q: query.run_ranked(c, q).select("path", "rank"))
register("topk_area", "SELECT path, row_number() OVER (ORDER BY width * height DESC NULLS LAST, path) AS rank FROM present QUALIFY rank <= 20")(lambda c: query.run_ranked(c, Query(sort="Area", direction="Desc", limit=20)).select("path", "rank"))

_ITEMS = """,
items AS (
  SELECT p.path, regexp_extract(p.path, '[^/]*$') AS name, p.size, p.mtime, lower(coalesce(p.format, '')) AS type, p.content_hash,
         coalesce(r.rating, 0) AS rating, p.date_taken
  FROM present p LEFT JOIN ratings r USING (content_hash))
"""
_GRID = {"name": "", "size": "size {d}, ", "modified": "mtime {d}, ", "type": "type {d}, ", "rating": "rating {i}, ", "date": "date_taken {i} NULLS {n}, "}
for _field, _sql in _GRID.items():
    for _down in (False, True):
        _order = _sql.format(d="DESC" if _down else "ASC", i="ASC" if _down else "DESC", n="FIRST" if _down else "LAST") + ("lower(name) DESC" if _down else "lower(name)") + ", path"
        register(f"grid_sort_{_field}_{'desc' if _down else 'asc'}", f"{_ITEMS} SELECT path, row_number() OVER (ORDER BY {_order}) AS rank FROM items")(lambda c, f=_field, d=_down: ranked(grid.grid(c), *grid.grid_order(f, d)).select("path", "rank"))


@register("grid_filter", _ITEMS + "SELECT path, rating FROM items WHERE rating >= 2 AND content_hash IN (SELECT content_hash FROM tagged WHERE fold = 'beach')")
def _grid_filter(c):
    return grid.grid_filter(grid.grid(c), c, 2, " Beach ").select("path", "rating")


@register("script_natural", _ITEMS + ", keyed AS (SELECT path, name, array_to_string(list_transform(regexp_extract_all(lower(name), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(ltrim(x, '0'), greatest(8, len(ltrim(x, '0')))::INT, '0') ELSE x END), '') AS key FROM items) SELECT path, key, row_number() OVER (ORDER BY key, lower(name), path) AS rank FROM keyed")
def _natural(c):
    keys = grid.SortKeys()
    return ranked(keys.keyed(grid.grid(c), "Name (natural)"), *keys.order()).select("path", F.col("sort_key.str").alias("key"), "rank")


@register("script_oldest", _ITEMS + "SELECT path, row_number() OVER (ORDER BY coalesce(date_taken, mtime) DESC, lower(name) DESC, path) AS rank FROM items")
def _oldest(c):
    keys = grid.SortKeys()
    return ranked(keys.keyed(grid.grid(c), "Oldest first"), *keys.order(descending=True)).select("path", "rank")


@register("script_python", _ITEMS + "SELECT path, row_number() OVER (ORDER BY length(name) * 2, lower(name), path) AS rank FROM items")
def _python_key(c):
    keys = grid.SortKeys()
    keys.register("By length", lambda item: len(item["name"]) * 2)
    return ranked(keys.keyed(grid.grid(c), "By length"), *keys.order()).select("path", "rank")


# --- joins and aggregates ------------------------------------------------------------------


@register("folder_stamp", f"SELECT p.path, p.content_hash, coalesce(r.rating, 0) AS rating, coalesce(o.turned, 1) AS orientation, c.x, c.y, c.w, c.h, p.date_taken FROM present p LEFT JOIN ratings r USING (content_hash) LEFT JOIN orientations o USING (content_hash) LEFT JOIN crops c USING (content_hash) WHERE p.{UNDER.replace('AND path', 'AND p.path')}")
def _stamp(c):
    return query.ratings_under(c, "/lib/src1").select("path", "content_hash", "rating", "orientation", "crop.x", "crop.y", "crop.w", "crop.h", "date_taken")


@register("combined_smart", "SELECT path, date_taken, row_number() OVER (ORDER BY date_taken DESC NULLS LAST, path) AS rank FROM present WHERE path >= '/lib/' AND path < '/lib0' AND content_hash IN (SELECT content_hash FROM ratings WHERE rating >= 2) AND content_hash IN (SELECT content_hash FROM tagged WHERE fold IN ('beach', 'sunset')) QUALIFY rank <= 50")
def _smart(c):
    return query.run_ranked(c, Query(under="/lib", rating_min=2, tags_any=["beach", "Sunset"], sort="DateTaken", direction="Desc", limit=50)).select("path", "date_taken", "rank")


@register("tag_cloud", "SELECT t.id, t.name, count(DISTINCT p.content_hash) AS n FROM tags t LEFT JOIN file_tags ft ON ft.tag_id = t.id LEFT JOIN present p ON p.content_hash = ft.content_hash GROUP BY t.id, t.name")
def _cloud(c):
    return query.tag_cloud(c)


@register("tag_names", "SELECT name, row_number() OVER (ORDER BY lower(name), name) AS rank FROM tags")
def _names(c):
    return ranked(query.tag_names(c), fn.ascii_fold("name"), F.col("name"))


@register("tag_search", "SELECT name FROM tags WHERE contains(lower(name), 'se')")
def _search(c):
    return query.search_tags(c, "SE")


@register("hashes_with_tag", "SELECT DISTINCT content_hash FROM tagged WHERE fold = 'toxic'")
def _with_tag(c):
    return query.hashes_with_tag(c, " Toxic ")


@register("tags_for_hash", "SELECT content_hash, string_agg(name, ',' ORDER BY fold, name) AS tags FROM tagged GROUP BY content_hash")
def _tags_of(c):
    return export.tags_by_hash(c).select("content_hash", F.array_join("tags", ",").alias("tags"))


@register("tag_browse", "SELECT d.path, d.content_hash, coalesce(r.rating, 0) AS rating FROM durable d LEFT JOIN ratings r USING (content_hash) WHERE d.content_hash IN (SELECT content_hash FROM tagged WHERE fold = 'sunset')")
def _browse(c):
    # Scoped to the tag first, then the durable paths of what is left: the same by content.
    return collections.tag_browse(c, "SUNSET")


@register("durable_paths", "SELECT path, content_hash FROM durable")
def _durable(c):
    return collections.durable_paths(query.present(c)).select("path", "content_hash")


@register("dir_children", "SELECT DISTINCT regexp_extract(substr(path, 6), '^([^/]+)/', 1) AS name FROM present WHERE path >= '/lib/' AND path < '/lib0'")
def _children(c):
    return query.dir_children(c, "/lib")


_REPS = ", reps AS (SELECT * FROM present QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY path ILIKE '/run/user/%/doc/%', path) = 1)"


@register("catalog_files", _REPS + "SELECT r.path, r.content_hash, i.position, row_number() OVER (ORDER BY i.position, r.content_hash) AS rank FROM reps r JOIN collection_items i USING (content_hash) WHERE i.collection_id = 2")
def _catalog_files(c):
    rows = collections.catalog_files(c, 2).select("path", "content_hash", "position")
    return ranked(rows, F.col("position"), F.col("content_hash"))


@register("smart_files", "SELECT path, row_number() OVER (ORDER BY date_taken DESC NULLS LAST, path) AS rank FROM present WHERE content_hash IN (SELECT content_hash FROM tagged WHERE fold IN ('beach', 'sunset'))")
def _smart_files(c):
    return query.run_ranked(c, collections.stored_query(c, 4)).select("path", "rank")


@register("collection_counts", "SELECT c.id, c.name, c.kind, CASE WHEN c.id = 3 THEN (SELECT count(*) FROM present WHERE content_hash IN (SELECT content_hash FROM ratings WHERE rating >= 4)) WHEN c.id = 4 THEN (SELECT count(*) FROM present WHERE content_hash IN (SELECT content_hash FROM tagged WHERE fold IN ('beach', 'sunset'))) ELSE (SELECT count(DISTINCT i.content_hash) FROM collection_items i JOIN present p USING (content_hash) WHERE i.collection_id = c.id) END AS n FROM collections c")
def _counts(c):
    return collections.list_collections(c)


@register("drop_resolution", ", dropped AS (SELECT doc_id AS ord, CASE WHEN doc_id % 2 = 0 THEN '/lib/' || source || '/' || lang || '/' || doc_id || '.txt' ELSE '/else/' || doc_id END AS path, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'none' ELSE md5(text) END AS hash FROM documents), told AS (SELECT d.ord, d.path, coalesce(f.content_hash, CASE WHEN d.hash IN (SELECT content_hash FROM present) THEN d.hash END) AS content_hash, CASE WHEN f.content_hash IS NOT NULL THEN 'by_path' WHEN d.hash IS NULL THEN 'unhashable' WHEN d.hash IN (SELECT content_hash FROM present) THEN 'by_hash' ELSE 'unknown' END AS outcome FROM dropped d LEFT JOIN files f ON f.path = d.path) SELECT *, content_hash IS NOT NULL AND row_number() OVER (PARTITION BY content_hash ORDER BY ord) = 1 AS kept FROM told")
def _drops(c):
    own = c.files.filter("path LIKE '/lib/%'").withColumn("ord", F.col("id") - 1)
    path = F.when(F.col("ord") % 2 == 0, F.col("path")).otherwise(F.concat(F.lit("/else/"), F.col("ord").cast("string")))
    hashed = F.when(F.col("ord") % 5 == 0, None).when(F.col("ord") % 7 == 0, F.lit("none")).otherwise(F.col("content_hash"))
    return collections.resolve_drop(c, own.select("ord", path.alias("path"), hashed.alias("hash")))


# --- duplicates ----------------------------------------------------------------------------

_CLUSTERS = """,
kept AS (
  SELECT * FROM (SELECT *, min(regexp_matches(path, '^/run/user/[0-9]*/doc/')::INT) OVER (PARTITION BY content_hash) AS best FROM labelled)
  WHERE regexp_matches(path, '^/run/user/[0-9]*/doc/')::INT = best),
clusters AS (
  SELECT first(path) OVER w AS cluster_id, row_number() OVER w AS rank, count(*) OVER (PARTITION BY label) AS members, path, content_hash, size
  FROM kept WINDOW w AS (PARTITION BY label ORDER BY size DESC, path) QUALIFY members > 1)
"""
_EXACT = ", labelled AS (SELECT *, content_hash AS label FROM present)" + _CLUSTERS
_SCOPED = f", labelled AS (SELECT *, content_hash AS label FROM present WHERE {UNDER})" + _CLUSTERS


def _near_sql(where: str) -> str:
    return f""",
scoped AS (SELECT * FROM present WHERE {where}),
nodes AS (SELECT DISTINCT content_hash, phash FROM scoped),
links AS (
  SELECT DISTINCT a.content_hash AS u, b.content_hash AS v FROM nodes a JOIN nodes b ON bit_count(xor(a.phash, b.phash)) <= 8),
reach(u, v) AS (SELECT content_hash, content_hash FROM nodes UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
labelled AS (SELECT s.*, r.label FROM scoped s JOIN (SELECT u, min(v) AS label FROM reach GROUP BY u) r ON r.u = s.content_hash)
""" + _CLUSTERS


@register("exact_duplicates", _EXACT + "SELECT * FROM clusters")
def _exact(c):
    return dedup.exact_duplicates(c)


@register("exact_duplicates_scoped", _SCOPED + "SELECT * FROM clusters")
def _exact_scoped(c):
    return dedup.exact_duplicates(c, "/lib/src1")


@register("reclaimable", _EXACT + "SELECT coalesce(sum(CASE WHEN rank > 1 THEN greatest(size, 0) END), 0)::BIGINT AS bytes, count(CASE WHEN rank = 1 THEN 1 END) AS clusters FROM clusters")
def _reclaim(c):
    return dedup.reclaimable(dedup.exact_duplicates(c))


@register("shown_clusters", _EXACT + "SELECT cluster_id, members, string_agg(path, '|' ORDER BY rank) FILTER (WHERE rank <= 2) AS paths, greatest(members - 2, 0) AS more FROM clusters GROUP BY cluster_id, members ORDER BY members DESC, cluster_id LIMIT 20")
def _shown(c):
    return dedup.shown_clusters(dedup.exact_duplicates(c), 20, 2).withColumn("paths", F.array_join("paths", "|"))


@register("near_pairs", ", h AS (SELECT DISTINCT phash FROM present WHERE phash IS NOT NULL) SELECT x.phash AS a, y.phash AS b FROM h x JOIN h y ON x.phash < y.phash WHERE bit_count(xor(x.phash, y.phash)) <= 8")
def _pairs(c):
    return dedup.near_pairs(c, 8)


@register("near_duplicates", _near_sql("true") + "SELECT * FROM clusters")
def _near(c):
    return dedup.near_duplicates(c, 8)


@register("near_scoped", _near_sql(UNDER) + "SELECT * FROM clusters")
def _near_scoped(c):
    return dedup.near_duplicates(c, 8, "/lib/src1")


# --- scans ---------------------------------------------------------------------------------

_G = "(doc_id // 20) % 5"
_SCAN_SQL = f""",
walk AS (
  SELECT CASE WHEN {_G} = 2 THEN replace(path, '.txt', '.moved.txt') ELSE path END AS path, CASE WHEN {_G} = 1 THEN size + 1 ELSE size END AS size, mtime, content_hash
  FROM own WHERE path >= '/lib/src1/' AND path < '/lib/src10' AND {_G} <> 0
  UNION ALL SELECT '/lib/src1/en/new' || id || '.txt', 1, 1, md5('/lib/src1/en/new' || id || '.txt') FROM own WHERE id % 50 = 0),
told AS (
  SELECT w.*, CASE WHEN f.path IS NULL THEN 'New' WHEN NOT f.missing AND f.size = w.size AND f.mtime = w.mtime THEN 'Unchanged' ELSE 'Modified' END AS change
  FROM walk w LEFT JOIN files f USING (path)),
gone AS (SELECT path FROM present WHERE {UNDER} AND path NOT IN (SELECT path FROM walk)),
sources AS (
  SELECT content_hash, path AS old_path, row_number() OVER (PARTITION BY content_hash ORDER BY path) AS n
  FROM files WHERE (missing OR path IN (SELECT path FROM gone)) AND path NOT IN (SELECT path FROM walk)),
arrived AS (
  SELECT t.path, CASE WHEN s.old_path IS NULL THEN 'New' ELSE 'Moved' END AS change, s.old_path, t.content_hash, t.size, t.mtime
  FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY path) AS n FROM told WHERE change = 'New') t LEFT JOIN sources s USING (content_hash, n)),
changes AS (
  SELECT * FROM arrived UNION ALL
  SELECT path, change, NULL, content_hash, size, mtime FROM told WHERE change <> 'New' UNION ALL
  SELECT path, 'Deleted', NULL, NULL, NULL, NULL FROM gone WHERE path NOT IN (SELECT old_path FROM arrived WHERE old_path IS NOT NULL))
"""


def _walk(c: Catalog) -> DataFrame:
    own = c.files.filter("path LIKE '/lib/%'").withColumn("g", F.floor((F.col("id") - 1) / 20) % 5)
    seen = own.filter(fn.in_subtree("path", "/lib/src1") & (F.col("g") != 0)).select(F.when(F.col("g") == 2, F.replace("path", F.lit(".txt"), F.lit(".moved.txt"))).otherwise(F.col("path")).alias("path"), (F.col("size") + F.when(F.col("g") == 1, 1).otherwise(0)).alias("size"), "mtime", "content_hash")
    path = F.concat(F.lit("/lib/src1/en/new"), F.col("id").cast("string"), F.lit(".txt"))
    return seen.unionByName(own.filter("id % 50 = 0").select(path.alias("path"), F.lit(1).cast("bigint").alias("size"), F.lit(1).cast("bigint").alias("mtime"), F.md5(path).alias("content_hash")))


@register("scan_changes", _SCAN_SQL + "SELECT * FROM changes")
def _changes(c):
    return scan.changes(c, _walk(c), "/lib/src1")


@register("scan_totals", _SCAN_SQL + "SELECT count(*) FILTER (WHERE change <> 'Deleted') AS total, count(*) FILTER (WHERE change IN ('New', 'Modified', 'Moved')) AS added, count(*) FILTER (WHERE change = 'Deleted') AS flagged FROM changes")
def _totals(c):
    return scan.totals(scan.changes(c, _walk(c), "/lib/src1"))


@register("scan_apply", _SCAN_SQL + """
SELECT coalesce(m.path, f.path) AS path, f.content_hash, CASE WHEN x.path IS NOT NULL THEN x.size ELSE f.size END AS size, coalesce(m.mtime, x.mtime, f.mtime) AS mtime,
  CASE WHEN x.path IS NULL THEN f.width END AS width, CASE WHEN x.path IS NOT NULL THEN 99 ELSE f.indexed_at END AS indexed_at,
  CASE WHEN m.path IS NOT NULL OR x.path IS NOT NULL THEN false WHEN d.path IS NOT NULL THEN true ELSE f.missing END AS missing
FROM files f LEFT JOIN changes m ON m.old_path = f.path LEFT JOIN changes x ON x.path = f.path AND x.change = 'Modified' LEFT JOIN changes d ON d.path = f.path AND d.change = 'Deleted'
UNION ALL SELECT path, content_hash, size, mtime, NULL, 99, false FROM changes WHERE change = 'New'""")
def _apply(c):
    after = scan.apply_scan(c, scan.changes(c, _walk(c), "/lib/src1"), now=99)
    return after.files.select("path", "content_hash", "size", "mtime", "width", "indexed_at", "missing")


@register("scan_reachable", _SCAN_SQL + f"SELECT path FROM present WHERE {UNDER} AND path IN (SELECT path FROM walk)")
def _reachable(c):
    return scan.reachable(query.paths_under(c, "/lib/src1"), _walk(c))


# --- state transitions ---------------------------------------------------------------------


def _events(name: str, sql: str):
    def add(build):
        QUERIES[name] = lambda spark, sf_dir: build(spark.read.parquet(f"{sf_dir}/events.parquet"))
        ORACLES[name] = sql
        return build

    return add


@_events("oplog_latest", "SELECT user_id AS key, event_type AS op, event_id AS seq, floor(value)::BIGINT % 6 AS rating FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def _oplog(events):
    ops = events.select(F.col("user_id").alias("key"), F.col("event_type").alias("op"), F.col("event_id").alias("seq"), (F.floor("value") % 6).cast("bigint").alias("rating"))
    return annotate.latest(ops, ["key"])


_FIRST_TWO = ", pair AS (SELECT min(content_hash) AS old, max(content_hash) AS new FROM ratings)"


def _pair(c: Catalog) -> tuple[str, str]:
    row = c.ratings.agg(F.min("content_hash").alias("a"), F.max("content_hash").alias("b")).first()
    return row["a"], row["b"]


@register("rekey", _FIRST_TWO + " SELECT CASE WHEN content_hash = old THEN new ELSE content_hash END AS content_hash, rating FROM ratings, pair WHERE content_hash <> new OR old = new")
def _rekey(c):
    old, new = _pair(c)
    return annotate.rekey(c, old, new).ratings.select("content_hash", "rating")


@register("rekey_tags", _FIRST_TWO + " SELECT DISTINCT CASE WHEN content_hash = old THEN new ELSE content_hash END AS content_hash, tag_id FROM file_tags, pair")
def _rekey_tags(c):
    return annotate.rekey(c, *_pair(c)).file_tags.select("content_hash", "tag_id")


@register("set_ratings", "SELECT content_hash, rating FROM (SELECT content_hash, rating FROM ratings WHERE content_hash NOT IN (SELECT content_hash FROM own WHERE doc_id % 10 = 0) UNION ALL SELECT content_hash, least(greatest(arg_max(doc_id % 9 - 2, doc_id), 0), 5) FROM own WHERE doc_id % 10 = 0 GROUP BY content_hash)")
def _set_ratings(c):
    ops = c.files.filter("path LIKE '/lib/%' AND (id - 1) % 10 = 0").select((F.col("id") - 1).alias("seq"), "content_hash", ((F.col("id") - 1) % 9 - 2).alias("rating"), F.lit(0).alias("updated_at"))
    return annotate.apply_changes(c, "ratings", ops).ratings.select("content_hash", "rating")


@register("tag_apply_remove", ", picked AS (SELECT DISTINCT content_hash FROM own WHERE doc_id % 25 = 1) SELECT content_hash, fold FROM (SELECT content_hash, fold FROM tagged WHERE NOT (fold = 'beach' AND content_hash IN (SELECT content_hash FROM own WHERE doc_id % 8 = 0)) UNION SELECT content_hash, 'fresh' FROM picked UNION SELECT content_hash, 'sunset' FROM picked)")
def _tag_changes(c):
    ids = F.col("id") - 1
    own = c.files.filter("path LIKE '/lib/%'")
    picked = own.filter(ids % 25 == 1).select("content_hash").distinct()
    c = annotate.apply_tag(annotate.apply_tag(c, " Fresh ", picked), "SUNSET", picked)
    c = annotate.remove_tag(c, "beach", own.filter(ids % 8 == 0).select("content_hash").distinct())
    return c.file_tags.join(c.tags, F.col("tag_id") == F.col("id")).select("content_hash", fn.ascii_fold("name").alias("fold"))


@register("tag_delete_rename", "SELECT CASE WHEN fold = 'beach' THEN 'Shore' ELSE name END AS name, count(*) AS n FROM tagged WHERE fold <> 'toxic' GROUP BY 1")
def _tag_names(c):
    c = annotate.rename_tag(annotate.delete_tag(c, "TOXIC"), "beach", " Shore ")
    return c.file_tags.join(c.tags, F.col("tag_id") == F.col("id")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


_ORDERED = ", listed AS (SELECT content_hash, row_number() OVER (ORDER BY content_hash DESC) - 1 AS n FROM (SELECT DISTINCT content_hash FROM own WHERE doc_id % 45 = 0))"


@register("catalog_add", _ORDERED + " SELECT content_hash, position FROM collection_items WHERE collection_id = 2 UNION ALL SELECT content_hash, (SELECT max(position) FROM collection_items WHERE collection_id = 2) + row_number() OVER (ORDER BY n) FROM listed WHERE content_hash NOT IN (SELECT content_hash FROM collection_items WHERE collection_id = 2)")
def _add(c):
    return annotate.add_to_catalog(c, 2, _listed(c)).collection_items.filter("collection_id = 2").select("content_hash", "position")


def _listed(c: Catalog) -> DataFrame:
    chosen = c.files.filter("path LIKE '/lib/%' AND (id - 1) % 45 = 0").select("content_hash").distinct()
    return ranked(chosen, F.desc("content_hash"), name="n").select((F.col("n") - 1).alias("ord"), "content_hash")


@register("catalog_reorder", _ORDERED + " SELECT i.content_hash, coalesce(l.n, i.position) AS position FROM collection_items i LEFT JOIN listed l USING (content_hash) WHERE collection_id = 1")
def _reorder(c):
    return annotate.set_catalog_order(c, 1, _listed(c)).collection_items.filter("collection_id = 1").select("content_hash", "position")


# --- export --------------------------------------------------------------------------------


@register("export_tags", "SELECT content_hash, string_agg(name, ',' ORDER BY fold, name) AS tags FROM tagged GROUP BY content_hash")
def _export_tags(c):
    rows = export.export_rows(c).filter("section = 'file_tags'").select(F.from_json("entry", "content_hash string, tags array<string>").alias("e"))
    return rows.select("e.content_hash", F.array_join("e.tags", ",").alias("tags"))


@register("export_doc", "SELECT 'ratings' AS section, content_hash AS place, '{\"content_hash\":\"' || content_hash || '\",\"rating\":' || rating || '}' AS entry FROM ratings UNION ALL SELECT 'comments', content_hash, '{\"content_hash\":\"' || content_hash || '\",\"body\":\"' || body || '\"}' FROM comments")
def _export_doc(c):
    return export.export_rows(c).filter("section IN ('ratings', 'comments')")


@register("import_merge", "SELECT content_hash, CASE WHEN content_hash = (SELECT min(content_hash) FROM ratings) THEN 0 ELSE rating END AS rating FROM ratings UNION ALL SELECT 'other', 3")
def _import(c):
    first = c.ratings.agg(F.min("content_hash").alias("h")).first()["h"]
    entries = ",".join(f'{{"content_hash":"{h}","rating":{r}}}' for h, r in ((first, 0), ("other", 3)) if h)
    text = f'{{"version":1,"file_tags":[],"ratings":[{entries}],"collections":[]}}'
    return export.import_export(c, export.parse_export(c.spark, text)).ratings.select("content_hash", "rating")


_E = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@register("xmp_packets", ", t AS (SELECT content_hash, string_agg('     <rdf:li>' || " + _E.format("name") + " || '</rdf:li>' || chr(10), '' ORDER BY fold, name) AS bag FROM tagged GROUP BY content_hash) SELECT p.path, p.path || '.xmp' AS sidecar, '<?xpacket begin=\"' || chr(65279) || '\" id=\"W5M0MpCehiHzreSzNTczkc9d\"?>' || chr(10) || '<x:xmpmeta xmlns:x=\"adobe:ns:meta/\" x:xmptk=\"quillmark\">' || chr(10) || ' <rdf:RDF xmlns:rdf=\"http://www.w3.org/1999/02/22-rdf-syntax-ns#\">' || chr(10) || '  <rdf:Description rdf:about=\"\"' || chr(10) || '    xmlns:xmp=\"http://ns.adobe.com/xap/1.0/\"' || chr(10) || '    xmlns:dc=\"http://purl.org/dc/elements/1.1/\">' || chr(10) || coalesce('   <xmp:Rating>' || r.rating || '</xmp:Rating>' || chr(10), '') || coalesce('   <dc:description>' || chr(10) || '    <rdf:Alt>' || chr(10) || '     <rdf:li xml:lang=\"x-default\">' || " + _E.format("c.body") + " || '</rdf:li>' || chr(10) || '    </rdf:Alt>' || chr(10) || '   </dc:description>' || chr(10), '') || coalesce('   <dc:subject>' || chr(10) || '    <rdf:Bag>' || chr(10) || t.bag || '    </rdf:Bag>' || chr(10) || '   </dc:subject>' || chr(10), '') || '  </rdf:Description>' || chr(10) || ' </rdf:RDF>' || chr(10) || '</x:xmpmeta>' || chr(10) || '<?xpacket end=\"w\"?>' || chr(10) AS packet FROM present p LEFT JOIN ratings r USING (content_hash) LEFT JOIN comments c USING (content_hash) LEFT JOIN t USING (content_hash) WHERE r.rating IS NOT NULL OR c.body IS NOT NULL OR t.bag IS NOT NULL")
def _xmp(c):
    return export.xmp_packets(c, query.present(c))


# --- scalar functions ----------------------------------------------------------------------


@register("exif_seconds", "SELECT id, CASE WHEN id % 13 <> 0 AND id % 40 BETWEEN 1 AND 31 THEN epoch(make_date((1990 + id % 40)::INT, (1 + id % 12)::INT, 1)::TIMESTAMP)::BIGINT + (id % 40 - 1) * 86400 + (id % 30) * 3600 + (id % 60) * 60 + id % 60 END AS seconds FROM own")
def _exif(c):
    i = F.col("id")
    month = F.when(i % 13 == 0, 13).otherwise(i % 12 + 1)
    text = F.format_string("%04d:%02d:%02d %02d:%02d:%02d", i % 40 + 1990, month, i % 40, i % 30, i % 60, i % 60)
    return c.files.filter("path LIKE '/lib/%'").select("id", fn.exif_seconds(text).alias("seconds"))


@register("camera_label", "SELECT id, CASE WHEN id % 3 = 0 THEN 'D' || (id % 9) WHEN id % 3 = 1 AND id % 2 = 0 THEN 'nikon D' || (id % 9) WHEN id % 3 = 1 THEN 'NIKON Z' || (id % 9) WHEN id % 4 = 0 THEN 'NIKON' END AS label FROM own")
def _camera(c):
    i = F.col("id")
    digit = (i % 9).cast("string")
    make = F.when((i % 3 == 1) | ((i % 3 == 2) & (i % 4 == 0)), "NIKON")
    model = F.when(i % 3 == 0, F.concat(F.lit("D"), digit)).when((i % 3 == 1) & (i % 2 == 0), F.concat(F.lit("nikon D"), digit)).when(i % 3 == 1, F.concat(F.lit("Z"), digit))
    return c.files.filter("path LIKE '/lib/%'").select("id", fn.camera_label(make, model).alias("label"))


@register("compose_orientation", "SELECT id, [6,7,8,5,2,3,4,1][least(greatest(id % 11 - 1, 1), 8)]::BIGINT AS cw, [8,5,6,7,4,1,2,3][least(greatest(id % 11 - 1, 1), 8)]::BIGINT AS ccw, [2,1,4,3,6,5,8,7][least(greatest(id % 11 - 1, 1), 8)]::BIGINT AS fh, [4,3,2,1,8,7,6,5][least(greatest(id % 11 - 1, 1), 8)]::BIGINT AS fv FROM own")
def _compose(c):
    state = F.col("id") % 11 - 1
    return c.files.filter("path LIKE '/lib/%'").select("id", *[fn.compose_orientation(state, o).alias(n) for n, o in (("cw", "rotate_cw"), ("ccw", "rotate_ccw"), ("fh", "flip_h"), ("fv", "flip_v"))])


@register("thumb_paths", "SELECT path, CASE WHEN id % 1200 <= 128 THEN 'normal' WHEN id % 1200 <= 256 THEN 'large' WHEN id % 1200 <= 512 THEN 'x-large' ELSE 'xx-large' END || '/' || md5('file://' || path) || '.png' AS thumb, 'file://' || path || '#' || CASE WHEN id % 1200 <= 128 THEN 128 WHEN id % 1200 <= 256 THEN 256 WHEN id % 1200 <= 512 THEN 512 ELSE 1024 END AS ram_key, NOT starts_with(path, '/run/user/') AS shareable FROM files")
def _thumbs(c):
    uri, target = F.concat(F.lit("file://"), F.col("path")), F.col("id") % 1200
    return c.files.select("path", fn.thumbnail_path(uri, target).alias("thumb"), fn.ram_key(uri, target).alias("ram_key"), fn.is_shareable("path").alias("shareable"))


@register("display_paths", "SELECT path, CASE WHEN starts_with(path, '/run/user/') THEN regexp_extract(path, '^/run/user/[^/]*/doc/[^/]*/(.*)$', 1) WHEN starts_with(path, '/lib/src1') THEN '~' || substr(path, 10) ELSE path END AS shown, regexp_matches(path, '^/run/user/[0-9]*/doc/') AS portal, path ILIKE '/run/user/%/doc/%' AS loose FROM files")
def _display(c):
    return c.files.select("path", fn.scope_display("path", "/lib/src1").alias("shown"), fn.is_portal_document("path").alias("portal"), fn.looks_like_portal("path").alias("loose"))


@register("metadata_panel", "SELECT path, strftime(make_timestamp(date_taken * 1000000), '%Y-%m-%d %H:%M') AS taken, CASE orientation WHEN 2 THEN 'Mirrored horizontally' WHEN 3 THEN 'Rotated 180°' WHEN 4 THEN 'Mirrored vertically' WHEN 5 THEN 'Mirrored, rotated 90° CCW' WHEN 6 THEN 'Rotated 90° CW' WHEN 7 THEN 'Mirrored, rotated 90° CW' WHEN 8 THEN 'Rotated 90° CCW' ELSE 'Normal' END AS turned, width || ' × ' || height AS dimensions, regexp_extract(path, '[^/]*$') AS name, repeat('★', (id % 6)::INT) AS stars, (SELECT count(*) FROM (SELECT 1) WHERE size < 0) = 0 AS sized FROM files")
def _panel(c):
    return c.files.select("path", fn.format_date("date_taken").alias("taken"), fn.orientation_label("orientation").alias("turned"), fn.dimensions_label("width", "height").alias("dimensions"), fn.file_name("path").alias("name"), fn.stars(F.col("id") % 6).alias("stars"), fn.human_size("size").isNotNull().alias("sized"))


@register("crc_and_distance", "SELECT a.phash AS a, b.phash AS b, bit_count(xor(a.phash, b.phash))::INT AS distance FROM own a JOIN own b ON b.id = a.id + 1")
def _distance(c):
    own = c.files.filter("path LIKE '/lib/%'").select("id", "phash")
    other = own.select((F.col("id") - 1).alias("id"), F.col("phash").alias("b"))
    return own.join(other, "id").select(F.col("phash").alias("a"), "b", fn.phash_distance("phash", "b").cast("int").alias("distance"))


@register("cache_eviction", "SELECT id, size, mtime FROM (SELECT id, size, mtime, sum(size) OVER (ORDER BY mtime DESC, id DESC) AS held, sum(size) OVER () AS total FROM own) WHERE held > 200000")
def _eviction(c):
    entries = c.files.filter("path LIKE '/lib/%'").select(F.col("id").alias("ord"), "size", F.col("mtime").alias("last_used"))
    return cache.evictions(entries, 200000).select(F.col("ord").alias("id"), "size", F.col("last_used").alias("mtime"))


@register("thumbnail_lookup", "SELECT path, CASE WHEN NOT starts_with(path, '/run/user/') AND id % 3 = 0 AND id % 2 = 0 THEN 'shared' WHEN id % 5 = 0 THEN 'private' ELSE 'decode' END AS found_in FROM files")
def _lookup(c):
    uri = F.concat(F.lit("file://"), F.col("path"))
    files = c.files.select("path", uri.alias("uri"), "mtime")
    shared = c.files.filter("id % 3 = 0").select(F.lit("shared").alias("cache"), fn.cache_key(uri).alias("key"), (F.col("mtime") - F.when(F.col("id") % 2 == 0, 0).otherwise(1)).alias("thumb_mtime"))
    private = c.files.filter("id % 5 = 0").select(F.lit("private").alias("cache"), fn.cache_key(uri).alias("key"), (F.col("mtime") + 5).alias("thumb_mtime"))
    return cache.cached_thumbnails(files, shared.unionByName(private)).select("path", "found_in")
