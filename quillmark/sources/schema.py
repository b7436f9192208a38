"""Fixed table schemas and their versions.

All times are unix seconds in BIGINT, all flags of the catalogue BOOLEAN. Annotation tables key on
content_hash, never on path: annotations follow content through renames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

_TYPES = {"string": StringType(), "long": LongType(), "double": DoubleType(), "boolean": BooleanType()}


def _struct(columns: str) -> StructType:
    return StructType([StructField(*_named(c.split())) for c in columns.split(", ")])


def _named(words: list[str]) -> tuple:
    return words[0], _TYPES[words[1]]


SCHEMAS: dict[str, StructType] = {
    name: _struct(ddl)
    for name, ddl in {
        "meta": "key string, value string",
        "files": "id long, path string, content_hash string, phash long, size long, mtime long, width long, height long, format string, date_taken long, camera string, orientation long, indexed_at long, missing boolean",
        "tags": "id long, name string",
        "file_tags": "content_hash string, tag_id long, sync_state string, source string, created_at long",
        "ratings": "content_hash string, rating long, sync_state string, updated_at long",
        "collections": "id long, name string, kind string, query string, created_at long",
        "collection_items": "collection_id long, content_hash string, position long",
        "comments": "content_hash string, body string, sync_state string, updated_at long",
        "orientations": "content_hash string, orientation long, sync_state string, updated_at long",
        "crops": "content_hash string, x double, y double, w double, h double, sync_state string, updated_at long",
    }.items()
}
FILE_COLUMNS = SCHEMAS["files"].names
ENRICHMENT_COLUMNS = ["phash", "width", "height", "format", "date_taken", "camera", "orientation"]
KEYS = {
    "meta": ["key"],
    "files": ["path"],
    "tags": ["id"],
    "file_tags": ["content_hash", "tag_id"],
    "ratings": ["content_hash"],
    "collections": ["id"],
    "collection_items": ["collection_id", "content_hash"],
    "comments": ["content_hash"],
    "orientations": ["content_hash"],
    "crops": ["content_hash"],
}
#: The column that a table's segments are sorted by.
SORT_KEYS = {name: "content_hash" if "content_hash" in keys else keys[0] for name, keys in KEYS.items()}
#: Tables that each schema version adds; a version without a table changes nothing that is stored.
VERSIONS: list[list[str]] = [["meta", "files", "tags", "file_tags", "ratings", "collections", "collection_items"], ["comments"], ["orientations"], ["crops"], []]
CURRENT_VERSION = len(VERSIONS)
#: Values of columns that older snapshots lack.
DEFAULTS = {"sync_state": "db-only", "source": "manual", "missing": False, "created_at": 0, "updated_at": 0}


def tables_at(version: int) -> list[str]:
    return [t for added in VERSIONS[:version] for t in added]


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with exactly the table's columns and types; absent ones get their defaults."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name) for f in SCHEMAS[table]])
