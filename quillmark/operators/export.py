"""Portable annotations: one JSON document, merges of it, and XMP sidecars."""

from __future__ import annotations

import json
import uuid
from functools import reduce

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions.columns import ascii_fold, sidecar_path, xml_escape
from ..plans.components import shared_folder, written
from ..sources import json_split
from ..sources.catalog import Catalog
from ..sources.schema import conform
from ..sources.shared_files import located, replacing, write_files
from . import annotate

EXPORT_VERSION = 2


def _list(**fields) -> ArrayType:
    return ArrayType(StructType([StructField(n, t) for n, t in fields.items()]))


EXPORT = StructType(
    [
        StructField("version", LongType()),
        StructField("file_tags", _list(content_hash=StringType(), tags=ArrayType(StringType()))),
        StructField("ratings", _list(content_hash=StringType(), rating=LongType())),
        StructField("comments", _list(content_hash=StringType(), body=StringType())),
        StructField("collections", _list(name=StringType(), kind=StringType(), query=StringType(), items=ArrayType(StringType()))),
    ]
)
#: The document's lists, in their order.
SECTIONS = ("file_tags", "ratings", "comments", "collections")
#: Replaces a name as toolkit in sidecars.
TOOLKIT = "quillmark"


def tags_by_hash(catalog: Catalog) -> DataFrame:
    """content_hash and its tag names, without regard to ASCII case in order."""
    joined = catalog.file_tags.join(catalog.tags, F.col("tag_id") == F.col("id"))
    names = F.sort_array(F.collect_list(F.struct(ascii_fold("name").alias("fold"), "name")))
    return joined.groupBy("content_hash").agg(F.transform(names, lambda x: x["name"]).alias("tags"))


def export_rows(catalog: Catalog) -> DataFrame:
    """The export as rows (section, place, entry as JSON): nothing of the size of the library is gathered.

    Orientations and crops are not part of an export.
    """
    items = F.sort_array(F.collect_list(F.struct("position", "content_hash")))
    lists = catalog.collection_items.groupBy("collection_id").agg(F.transform(items, lambda x: x["content_hash"]).alias("items"))
    collections = catalog.collections.join(lists, F.col("id") == F.col("collection_id"), "left").select(F.format_string("%020d", "id").alias("place"), "name", "kind", "query", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    sections = {
        "file_tags": tags_by_hash(catalog).select(F.col("content_hash").alias("place"), "content_hash", "tags"),
        "ratings": catalog.ratings.select(F.col("content_hash").alias("place"), "content_hash", "rating"),
        "comments": catalog.comments.select(F.col("content_hash").alias("place"), "content_hash", "body"),
        "collections": collections,
    }
    out = None
    for name, rows in sections.items():
        entry = F.to_json(F.struct(*[c for c in rows.columns if c != "place"]), {"ignoreNullFields": "false"})
        part = rows.select(F.lit(name).alias("section"), "place", entry.alias("entry"))
        out = part if out is None else out.unionByName(part)
    return out


def export_lines(catalog: Catalog) -> DataFrame:
    """The document's text as rows (part, step, place, line), which follow each other in this order."""
    rows = export_rows(catalog)
    number = reduce(lambda found, it: F.when(F.col("section") == it[1], it[0]).otherwise(found), enumerate(SECTIONS, 1), F.lit(0))
    first = rows.groupBy("section").agg(F.min("place").alias("first"))
    told = rows.join(F.broadcast(first), "section").select(number.alias("part"), F.lit(1).alias("step"), "place", F.concat(F.when(F.col("place") == F.col("first"), "").otherwise(","), "entry").alias("line"))
    frame = [(0, 0, "", f'{{"version":{EXPORT_VERSION}'), (len(SECTIONS) + 1, 0, "", "}")]
    frame += [(i, step, "", text) for i, name in enumerate(SECTIONS, 1) for step, text in ((0, f',"{name}":['), (2, "]"))]
    return told.unionByName(catalog.spark.createDataFrame(frame, told.schema))


def export_json(catalog: Catalog) -> str:
    """The document as one string, for small libraries; see write_export."""
    return "".join(r["line"] for r in export_lines(catalog).orderBy("part", "step", "place").collect())


def write_export(catalog: Catalog, path: str) -> None:
    """The document as one file, a line for each entry, at a path that executors see.

    The lines are sorted and written as part files by many tasks; one task then streams these, in order,
    into the file, which takes the path's place when it is complete.
    """
    spark = catalog.spark
    order = ("part", "step", "place")
    folder = f"{shared_folder(spark)}/quillmark/{uuid.uuid4().hex}-export"
    # Written first: sampling for the ranges would make the rows once more.
    lines = written(export_lines(catalog), "export-lines")
    laid = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    laid.select("line").write.text(folder)

    def joined(frames):
        for _ in frames:
            fs, at = located(folder)
            parts = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.base_name.startswith("part-"))
            with replacing(path) as out:
                for part in parts:
                    with fs.open_input_stream(part) as source:
                        while block := source.read(1 << 20):
                            out.write(block)
            yield pd.DataFrame({"parts": [len(parts)]})

    spark.range(1, numPartitions=1).mapInPandas(joined, "parts long").collect()


def read_export(spark: SparkSession, path: str, range_bytes: int = json_split.RANGE_BYTES) -> DataFrame:
    """The entries (section, ord, entry) of a document's lists, read in ranges by many tasks."""
    return json_split.entries(spark, path, range_bytes)


def parse_export(spark: SparkSession, text: str) -> DataFrame:
    """As read_export, for a document that is at hand; other than JSON is an error."""
    document = json.loads(text)
    rows = [(name, i, json.dumps(entry)) for name in SECTIONS for i, entry in enumerate(document.get(name) or [])]
    return spark.createDataFrame(rows, json_split.ENTRIES)


def import_export(catalog: Catalog, document: DataFrame) -> Catalog:
    """Merge a document's entries (section, ord, entry as JSON); nothing is deleted.

    Tags are created as needed and kept where they are; ratings and comments overwrite values only;
    collections are always appended. A rating outside 0..5, or an entry that is no object of its section's
    form, rejects the whole document. Lists that are absent (comments of version 1) are empty.
    """
    parsed = {f.name: f.dataType.elementType for f in EXPORT if f.name != "version"}
    entries = lambda name: document.filter(F.col("section") == name).select("ord", F.from_json(F.when(F.col("section") == name, F.col("entry")), parsed[name], {"mode": "FAILFAST"}).alias("e"))
    ratings = entries("ratings").select("e.content_hash", "e.rating")
    if not ratings.filter(~F.coalesce(F.col("rating").between(0, 5), F.lit(False))).isEmpty():
        raise ValueError("a rating is outside 0..5")
    tagged = written(entries("file_tags").select("ord", "e.content_hash", F.posexplode("e.tags").alias("nth", "name")), "import-tags")
    fold = ascii_fold("name")
    # The first spelling of each name, by partial minima: a name that most files have is no hot task.
    new = tagged.groupBy(fold.alias("fold")).agg(F.min(F.struct("ord", "nth", "name")).alias("one")).select("fold", "one.*").join(catalog.tags.select(fold.alias("fold")), "fold", "left_anti")
    added = annotate.next_ids(catalog.tags, new.select("ord", "nth", "name"), F.col("ord"), F.col("nth")).select("id", "name")
    tags = written(catalog.tags.unionByName(added), "tags")
    ids = tags.select(fold.alias("fold"), F.col("id").alias("tag_id"))
    uses = tagged.select("content_hash", fold.alias("fold")).distinct().join(ids, "fold").withColumn("created_at", F.lit(0))
    uses = conform(uses, "file_tags").join(catalog.file_tags, ["content_hash", "tag_id"], "left_anti")
    merged = {"tags": tags, "file_tags": catalog.file_tags.unionByName(conform(uses, "file_tags"))}
    for table, value in (("ratings", "rating"), ("comments", "body")):
        rows = annotate.latest(entries(table).select("ord", "e.content_hash", f"e.{value}"), ["content_hash"], "ord")
        rows = conform(rows.withColumn("updated_at", F.lit(0)), table)
        merged[table] = annotate.merged(catalog.table(table), rows, ["content_hash"], keep=["sync_state", "updated_at"])
    listed = annotate.next_ids(catalog.collections, entries("collections").select("ord", "e.*"), F.col("ord"))
    listed = written(listed.withColumn("created_at", F.lit(0)), "import-collections")
    merged["collections"] = catalog.collections.unionByName(conform(listed, "collections"))
    items = listed.select(F.col("id").alias("collection_id"), F.posexplode("items").alias("position", "content_hash"))
    items = items.groupBy("collection_id", "content_hash").agg(F.min("position").alias("position"))
    merged["collection_items"] = catalog.collection_items.unionByName(conform(items, "collection_items"))
    return catalog.with_tables(**merged)


# --- XMP -----------------------------------------------------------------------------------


def xmp_is_empty(rating: Column, comment: Column, tags: Column) -> Column:
    return rating.isNull() & (F.coalesce(comment, F.lit("")) == "") & (F.coalesce(F.size(tags), F.lit(0)) <= 0)


def xmp_packet(rating: Column, comment: Column, tags: Column) -> Column:
    """A complete sidecar; indentation and order are part of the format (fixed text)."""
    rated = F.when(rating.isNotNull(), F.concat(F.lit("   <xmp:Rating>"), F.least(F.greatest(rating, F.lit(0)), F.lit(5)).cast("string"), F.lit("</xmp:Rating>\n"))).otherwise("")
    told = F.when(F.coalesce(comment, F.lit("")) != "", F.concat(F.lit('   <dc:description>\n    <rdf:Alt>\n     <rdf:li xml:lang="x-default">'), xml_escape(comment), F.lit("</rdf:li>\n    </rdf:Alt>\n   </dc:description>\n"))).otherwise("")
    each = F.array_join(F.transform(tags, lambda t: F.concat(F.lit("     <rdf:li>"), xml_escape(t), F.lit("</rdf:li>\n"))), "")
    subjects = F.when(F.coalesce(F.size(tags), F.lit(0)) > 0, F.concat(F.lit("   <dc:subject>\n    <rdf:Bag>\n"), each, F.lit("    </rdf:Bag>\n   </dc:subject>\n"))).otherwise("")
    head = f'<?xpacket begin="﻿" id="W5M0MpCehiHzreSzNTczkc9d"?>\n<x:xmpmeta xmlns:x="adobe:ns:meta/" x:xmptk="{TOOLKIT}">\n <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">\n  <rdf:Description rdf:about=""\n    xmlns:xmp="http://ns.adobe.com/xap/1.0/"\n    xmlns:dc="http://purl.org/dc/elements/1.1/">\n'
    tail = '  </rdf:Description>\n </rdf:RDF>\n</x:xmpmeta>\n<?xpacket end="w"?>\n'
    return F.concat(F.lit(head), rated, told, subjects, F.lit(tail))


def xmp_packets(catalog: Catalog, files: DataFrame) -> DataFrame:
    """sidecar path and packet of each file (path, content_hash) that has something to tell."""
    joined = files.filter("content_hash != ''").select("path", "content_hash")
    for table in (catalog.ratings.select("content_hash", "rating"), catalog.comments.select("content_hash", "body"), tags_by_hash(catalog)):
        joined = joined.join(table, "content_hash", "left")
    parts = (F.col("rating"), F.col("body"), F.col("tags"))
    return joined.filter(~xmp_is_empty(*parts)).select("path", sidecar_path("path").alias("sidecar"), xmp_packet(*parts).alias("packet"))


def write_sidecars(packets: DataFrame) -> int:
    """Write every packet beside its file, on the executors (which must see the files' folders); how many."""
    return _write_sidecars(packets)


def write_selected_sidecars(catalog: Catalog, selection: DataFrame) -> tuple[int, int]:
    """Sidecars of selected files (path, content_hash): how many were written, and how many skipped.

    Skipped are files without a hash, with nothing to tell, or in a folder that cannot be written.
    """
    done = _write_sidecars(xmp_packets(catalog, selection))
    return done, selection.count() - done


def _write_sidecars(packets: DataFrame) -> int:
    # Written and counted by one job: packets are computed once.
    return write_files(packets.select(F.col("sidecar").alias("path"), F.encode("packet", "UTF-8").alias("content"))).filter("written").count()
