"""Registered queries over a stored index of perceptual hashes, against all pairs in SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from .plans.components import shared_folder
from .queries import register
from .sources.catalog import Catalog
from .sources.hash_index import HashIndex


def _fresh(c: Catalog) -> str:
    return f"{shared_folder(c.spark)}/indexes/{uuid4().hex}"


_ASKED = "phash IS NOT NULL AND path LIKE '/lib/src1/%'"


@register("phash_within", f", h AS (SELECT DISTINCT phash FROM files WHERE phash IS NOT NULL) SELECT a.phash AS query, b.phash AS hash, bit_count(xor(a.phash, b.phash))::INT AS distance FROM (SELECT DISTINCT phash FROM files WHERE {_ASKED}) a JOIN h b ON bit_count(xor(a.phash, b.phash)) <= 6")
def _within(c):
    """Everything within 6 bits of a source's hashes, from an index for distances up to 8."""
    index = HashIndex.create(c.spark, _fresh(c), c.files.select("phash"))
    return index.within(c.files.filter(_ASKED).select("phash"), 6)


@register("phash_classes", """, h AS (SELECT DISTINCT phash AS hash FROM files WHERE phash IS NOT NULL),
edges AS (SELECT a.hash AS a, b.hash AS b FROM h a JOIN h b ON bit_count(xor(a.hash, b.hash)) <= 8),
reached AS (SELECT hash AS a, hash AS b FROM h UNION SELECT r.a, e.b FROM reached r JOIN edges e ON e.a = r.b)
SELECT a AS hash, min(b) AS root FROM reached GROUP BY a""")
def _classes(c):
    """Classes of an index that got its hashes in three parts, the last of single files."""
    part = F.col("id") % 50
    index = HashIndex.create(c.spark, _fresh(c), c.files.filter(part > 9).select("phash"))
    for rows in (c.files.filter((part > 0) & (part <= 9)), c.files.filter(part == 0)):
        index = index.insert(rows.select("phash"))
    return index.classes()
