"""Registered queries over pictures that are drawn from the documents' digests: files, pixels and perceptual hashes."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .edit_queries import _own
from .functions import pixels
from .operators import cache
from .plans.components import shared_folder, written
from .queries import register
from .sources import images
from .sources.catalog import Catalog

#: A picture is 4 x 4 squares of so many pixels' length, one for each byte of the digest, grey.
SIDE = 8


def _bytes_sql(data: str, alpha: str = "ff") -> str:
    """The hexadecimal text of a picture's RGBA rows."""
    square = lambda k: f"repeat(repeat(substr({data}, {2 * k + 1}, 2), 3) || '{alpha}', {SIDE})"
    return " || ".join(f"repeat({' || '.join(square(4 * r + c) for c in range(4))}, {SIDE})" for r in range(4))


def _picture(digest: Column, alpha: str = "ff") -> Column:
    """RGBA rows of a picture."""
    square = lambda k: F.repeat(F.concat(F.repeat(F.substring(digest, 2 * k + 1, 2), F.lit(3)), F.lit(alpha)), F.lit(SIDE))
    return F.unhex(F.concat(*[F.repeat(F.concat(*[square(4 * r + c) for c in range(4)]), F.lit(SIDE)) for r in range(4)]))


def _pictures(c: Catalog, ending: Column, alpha: str = "ff") -> DataFrame:
    size = F.lit(4 * SIDE).cast("long")
    return _own(c).select(F.concat(F.regexp_replace("path", r"\.txt$", "."), ending).alias("path"), _picture(F.col("content_hash"), alpha).alias("data"), size.alias("width"), size.alias("height"))


_ENDING = "['jpg', 'png', 'JPEG'][1 + doc_id % 3]"


def _endings() -> Column:
    return F.element_at(F.array(*map(F.lit, ["jpg", "png", "JPEG"])), (F.col("doc_id") % 3 + 1).cast("int"))


@register("baked_files", f"SELECT regexp_replace(path, 'txt$', {_ENDING}) AS path, CASE WHEN doc_id % 3 = 1 THEN 'PNG' ELSE 'JPEG' END AS format, {4 * SIDE}::BIGINT AS width, {4 * SIDE}::BIGINT AS height, md5(CASE WHEN doc_id % 3 = 1 THEN {_bytes_sql('content_hash', '80')} ELSE {_bytes_sql('content_hash')} END) AS pixels FROM own")
def _baked(c):
    """Half-transparent pictures saved as JPEG (alpha is dropped) or PNG (kept), and every pixel read again."""
    read = pixels.decoded(pixels.baked(_pictures(c, _endings(), "80")))
    return read.select("path", "format", "width", "height", F.md5(F.lower(F.hex("data"))).alias("pixels"))


def _weights_sql(n: int) -> str:
    """Weights of the squares' rows or columns in each of n cells: three lobes of a windowed sine."""
    ratio = 4 * SIDE / n
    x = f"((k - ((i + 0.5) * {ratio!r} - 0.5)) / {ratio!r})"
    lobe = f"CASE WHEN abs({x}) < 1e-12 THEN 1.0 WHEN abs({x}) < 3 THEN sin(pi() * {x}) / (pi() * {x}) * sin(pi() * {x} / 3) / (pi() * {x} / 3) ELSE 0.0 END"
    inside = f"k >= greatest(floor((i + 0.5) * {ratio!r} - {3 * ratio!r}), 0) AND k < ceil((i + 0.5) * {ratio!r} + {3 * ratio!r})"
    return f"SELECT i, k // {SIDE} AS part, sum(w) / sum(sum(w)) OVER (PARTITION BY i) AS w FROM (SELECT i, k, {lobe} AS w FROM (SELECT unnest(range({n})) AS i) CROSS JOIN (SELECT unnest(range({4 * SIDE})) AS k) WHERE {inside}) GROUP BY i, k // {SIDE}"


_HASHED = f""", down AS ({_weights_sql(8)}), across AS ({_weights_sql(9)}),
squares AS (SELECT path, k // 4 AS r, k % 4 AS c, ('0x' || substr(content_hash, 2 * k::INT + 1, 2))::BIGINT AS v FROM own CROSS JOIN (SELECT unnest(range(16)) AS k)),
cells AS (
  SELECT path, d.i AS i, a.i AS j, least(greatest(floor(sum(d.w * a.w * v) + 0.5), 0), 255) AS v
  FROM squares s JOIN down d ON d.part = s.r JOIN across a ON a.part = s.c GROUP BY path, d.i, a.i),
bits AS (SELECT l.path, sum(CASE WHEN r.v > l.v THEN 1::HUGEINT << (8 * l.i + l.j)::INT ELSE 0 END) AS h FROM cells l JOIN cells r ON r.path = l.path AND r.i = l.i AND r.j = l.j + 1 GROUP BY l.path)
"""


@register("photo_hashes", _HASHED + f"SELECT regexp_replace(o.path, 'txt$', {_ENDING}) AS path, CASE WHEN doc_id % 3 = 1 THEN 'PNG' ELSE 'JPEG' END AS format, {4 * SIDE}::BIGINT AS width, {4 * SIDE}::BIGINT AS height, (CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END)::BIGINT AS phash FROM own o JOIN bits b ON b.path = o.path")
def _hashes(c):
    """What the enrichment makes of the pictures' files: headers, and hashes of their decoded and resampled pixels."""
    return images.enriched(pixels.baked(_pictures(c, _endings()))).select("path", "format", "width", "height", "phash")


@register("thumbnail_store", f"SELECT 'file://' || path AS uri, CASE WHEN doc_id % 4 = 3 THEN 'private' ELSE 'shared' END AS found_in, CASE WHEN doc_id % 2 = 0 THEN 1200 ELSE 100 END AS target, md5({_bytes_sql('content_hash')}) AS pixels FROM own")
def _stored(c):
    """Thumbnails of all pictures, written to both caches and found again; a quarter must not be shared."""
    root = f"{shared_folder(c.spark)}/caches-{uuid4().hex}"
    own = _own(c).select(F.concat(F.lit("file://"), "path").alias("uri"), F.when(F.col("doc_id") % 4 == 3, F.lit("/run/user/1/x")).otherwise(F.col("path")).alias("path"), "mtime", F.when(F.col("doc_id") % 2 == 0, 1200).otherwise(100).alias("target"), F.col("content_hash"))
    size = F.lit(4 * SIDE).cast("long")
    private, shared = (f"{root}/{name}" for name in ("private", "shared"))
    cache.store_thumbnails(own.select("*", _picture(F.col("content_hash")).alias("data"), size.alias("width"), size.alias("height")), private, shared)
    local = lambda path: "/" + path.removeprefix("file:").lstrip("/")
    found = written(cache.read_thumbnails(own, local(private), local(shared)), "thumbnails-read")
    pixel = pixels.decoded(found.select(F.col("uri").alias("path"), "content")).select(F.col("path").alias("uri"), F.md5(F.lower(F.hex("data"))).alias("pixels"))
    return found.select("uri", "found_in").join(pixel, "uri").join(own.select("uri", "target"), "uri").select("uri", "found_in", "target", "pixels")


_TURNS = {1: "0123456789abcdef", 3: "fedcba9876543210", 6: "c840d951ea62fb73", 8: "37bf26ae159d048c"}


def _turned_sql(turn: int) -> str:
    return " || ".join(f"substr(content_hash, {2 * int(k, 16) + 1}, 2)" for k in _TURNS[turn])


@register("rasters_turned", "SELECT path, md5(CASE doc_id % 4 " + " ".join(f"WHEN {i} THEN {_bytes_sql('(' + _turned_sql(t) + ')')}" for i, t in enumerate(_TURNS)) + " END) AS pixels FROM own")
def _turned(c):
    """The pictures turned upright by quarter turns, every pixel compared."""
    turn = reduce(lambda found, it: F.when(F.col("doc_id") % 4 == it[0], it[1]).otherwise(found), enumerate(_TURNS), F.lit(1))
    size, none = F.lit(4 * SIDE).cast("long"), F.lit(None).cast("double")
    rasters = _own(c).select("path", _picture(F.col("content_hash")).alias("data"), size.alias("width"), size.alias("height"), (4 * size).alias("stride"), turn.cast("long").alias("orientation"), *[none.alias(n) for n in "xywh"])
    return pixels.transformed(rasters).select("path", F.md5(F.lower(F.hex("data"))).alias("pixels"))


@register("picture_headers", "SELECT path, ['SVG', 'TIFF', 'JPEG XL'][1 + doc_id % 3] AS format, CASE doc_id % 3 WHEN 2 THEN 8 * (1 + doc_id % 32) ELSE 1 + doc_id % 200 END AS width, CASE doc_id % 3 WHEN 2 THEN 8 * (1 + doc_id % 32) ELSE 1 + doc_id % 100 END AS height, CASE WHEN doc_id % 3 = 1 AND doc_id % 10 BETWEEN 1 AND 8 THEN doc_id % 10 END AS orientation FROM own")
def _headers(c):
    """Drawings, TIFF files with an orientation, and square JPEG XL codestreams, as the enrichment reads them."""
    number, raw = F.col("doc_id"), lambda text: F.unhex(F.lit(text))
    width, height = number % 200 + 1, number % 100 + 1
    svg = F.encode(F.concat(F.lit("<?xml version='1.0'?><svg width='"), width.cast("string"), F.lit("px' height='"), height.cast("string"), F.lit("'/>")), "UTF-8")
    byte = lambda n: F.unhex(F.lpad(F.hex(n), 2, "0"))
    entry = lambda tag, n: F.concat(raw(tag + "0300" + "01000000"), byte(n), raw("000000"))
    tiff = F.concat(raw("49492a0008000000" + "0300"), entry("0001", width), entry("0101", height), entry("1201", number % 10), raw("00000000"))
    # One bit for sizes in eights, five for the height, and the shape of a square.
    jxl = F.concat(raw("ff0a"), byte(F.lit(65) + number % 32 * 2), raw("00" * 8))
    kind = number % 3
    content = F.when(kind == 0, svg).when(kind == 1, tiff).otherwise(jxl)
    return images.enriched(_own(c).select("path", content.alias("content"))).select("path", "format", "width", "height", "orientation")
