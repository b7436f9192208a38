"""Scalar functions of the catalogue, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions that count as images, in lower case.
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "webp", "avif", "heif", "heic", "jxl", "gif", "tiff", "tif", "bmp", "svg"]
# Media types of the same formats.
IMAGE_TYPES = ["image/jpeg", "image/png", "image/webp", "image/avif", "image/heif", "image/heic", "image/jxl", "image/gif", "image/tiff", "image/bmp", "image/svg+xml"]
# EXIF orientation after one operation, by the orientation 1 to 8 before it.
COMPOSED = {"rotate_cw": [6, 7, 8, 5, 2, 3, 4, 1], "rotate_ccw": [8, 5, 6, 7, 4, 1, 2, 3], "flip_h": [2, 1, 4, 3, 6, 5, 8, 7], "flip_v": [4, 3, 2, 1, 8, 7, 6, 5]}
# Names of EXIF orientations 1 to 8.
ORIENTATION_LABELS = ["Normal", "Mirrored horizontally", "Rotated 180°", "Mirrored vertically", "Mirrored, rotated 90° CCW", "Rotated 90° CW", "Mirrored, rotated 90° CW", "Rotated 90° CCW"]
# Thumbnail buckets and their folders.
BUCKETS = [(128, "normal"), (256, "large"), (512, "x-large"), (1024, "xx-large")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_fold(name) -> Column:
    """Lower case of ASCII letters only: names that differ in É and é stay different."""
    return F.translate(_col(name), UPPER, LOWER)


def trimmed(text) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")


def subtree_range(root: str) -> tuple[str, str]:
    """Half-open byte range of the paths below a folder ('0' follows '/')."""
    base = root.rstrip("/")
    return base + "/", base + "0"


def in_subtree(path, root: str) -> Column:
    low, high = subtree_range(root)
    return (_col(path) >= F.lit(low)) & (_col(path) < F.lit(high))


def extension(path) -> Column:
    """Lower-case extension; a leading dot does not make one."""
    return ascii_fold(F.regexp_extract(_col(path), r"[^/]\.([^./]+)$", 1))


def is_image_path(path) -> Column:
    return extension(path).isin(IMAGE_EXTENSIONS)


def is_supported_image(content_type) -> Column:
    return _col(content_type).isin(IMAGE_TYPES)


def is_portal_document(path) -> Column:
    """A sandbox's view of a document: the strict form."""
    return _col(path).rlike("^/run/user/[0-9]*/doc/")


def looks_like_portal(path) -> Column:
    """The loose form: any characters between, ASCII letters of either case."""
    return ascii_fold(path).like("/run/user/%/doc/%")


def is_shareable(path) -> Column:
    """Whether a thumbnail may go to the shared cache."""
    return _col(path).isNotNull() & (_col(path) != "/run/user") & ~_col(path).startswith("/run/user/")


def is_current(thumb_mtime, source_mtime) -> Column:
    return _col(thumb_mtime) >= _col(source_mtime)


def file_name(path) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def stem(path) -> Column:
    """The name without its last extension, if it has one."""
    name = file_name(path)
    return F.when(F.instr(name, ".") > 0, F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)).otherwise(name)


def default_bookmark_name(path) -> Column:
    name = F.regexp_extract(_col(path), r"([^/]+)/*$", 1)
    return F.when(name == "", _col(path)).otherwise(name)


def sidecar_path(path) -> Column:
    return F.concat(_col(path), F.lit(".xmp"))


def phash_distance(a, b) -> Column:
    return F.bit_count(_col(a).bitwiseXOR(_col(b)))


def days_from_civil(year, month, day) -> Column:
    """Days since 1970-01-01 in the proleptic Gregorian calendar; days beyond a month roll over."""
    y = _col(year) - F.when(_col(month) <= 2, 1).otherwise(0)
    era = F.floor(y / 400)
    yoe = y - era * 400
    shifted = _col(month) + F.when(_col(month) > 2, -3).otherwise(9)
    doy = F.floor((shifted * 153 + 2) / 5) + _col(day) - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return (era * 146097 + doe - 719468).cast("bigint")


def exif_seconds(text) -> Column:
    """Unix seconds (UTC) of 'Y:M:D h:m:s'; null if malformed, for year 0, and months or days out of range.

    Times of day are not range-checked and parts after the third are ignored.
    """
    whole = _col(text)
    at = F.instr(whole, " ")
    date = F.split(F.substring(whole, F.lit(1), at - 1), ":")
    time = F.split(F.substring(whole, at + 1, F.length(whole)), ":")
    part = lambda a, i: F.when(F.get(a, F.lit(i)).rlike(r"^[+-]?[0-9]{1,18}$"), F.get(a, F.lit(i)).cast("bigint"))
    y, mo, d, h, mi, s = (*(part(date, i) for i in range(3)), *(part(time, i) for i in range(3)))
    seconds = days_from_civil(y, mo, d) * 86400 + h * 3600 + mi * 60 + s
    return F.when((at > 0) & (y != 0) & mo.between(1, 12) & d.between(1, 31), seconds)


def camera_label(make, model) -> Column:
    make, model = _col(make), _col(model)
    both = F.when(F.startswith(F.lower(model), F.lower(make)), model).otherwise(F.concat(make, F.lit(" "), model))
    return F.when(make.isNull(), model).when(model.isNull(), make).otherwise(both)


def exif_text(text) -> Column:
    """Without surrounding NULs and white space; null if nothing is left."""
    return F.nullif(F.regexp_replace(_col(text), r"(?U)^[\x00\s]+|[\x00\s]+$", ""), F.lit(""))


def orientation_or_null(code) -> Column:
    return F.when(_col(code).between(1, 8), _col(code))


def compose_orientation(state, operation: str) -> Column:
    """The orientation after one more operation; states are clamped to 1..8."""
    table = F.array(*[F.lit(x).cast("bigint") for x in COMPOSED[operation]])
    return F.element_at(table, F.least(F.greatest(_col(state), F.lit(1)), F.lit(8)).cast("int"))


def orientation_label(code) -> Column:
    labels = F.array(*map(F.lit, ORIENTATION_LABELS))
    return F.when(_col(code).between(1, 8), F.element_at(labels, F.when(_col(code).between(1, 8), _col(code)).otherwise(1).cast("int"))).otherwise(F.lit("Normal"))


def clamp_rating(rating) -> Column:
    return F.least(F.greatest(_col(rating), F.lit(0)), F.lit(5)).cast("bigint")


def stars(rating) -> Column:
    return F.repeat(F.lit("★"), F.greatest(_col(rating), F.lit(0)).cast("int"))


def toggled_star(current, star) -> Column:
    return F.when(_col(current) == _col(star), F.lit(0)).otherwise(_col(star)).cast("bigint")


def xml_escape(text) -> Column:
    escaped = _col(text)
    for plain, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(shown))
    return escaped


def cache_key(uri) -> Column:
    return F.md5(_col(uri))


def bucket_pixels(target) -> Column:
    chosen = F.when(_col(target) <= BUCKETS[0][0], BUCKETS[0][0])
    for pixels, _ in BUCKETS[1:-1]:
        chosen = chosen.when(_col(target) <= pixels, pixels)
    return chosen.otherwise(BUCKETS[-1][0])


def bucket_dir(target) -> Column:
    pixels = bucket_pixels(target)
    chosen = F.when(pixels == BUCKETS[0][0], BUCKETS[0][1])
    for size, name in BUCKETS[1:]:
        chosen = chosen.when(pixels == size, name)
    return chosen


def thumbnail_path(uri, target) -> Column:
    return F.concat(bucket_dir(target), F.lit("/"), cache_key(uri), F.lit(".png"))


def ram_key(uri, target) -> Column:
    return F.concat(_col(uri), F.lit("#"), bucket_pixels(target).cast("string"))


def edit_key(orientation, crop) -> Column:
    """Suffix for edit instructions: '#oN' beyond the identity, '#cx,y,w,h' to three places."""
    turned = F.when(_col(orientation) > 1, F.concat(F.lit("#o"), _col(orientation).cast("string"))).otherwise("")
    c = _col(crop)
    cut = F.when(c.isNotNull(), F.format_string("#c%.3f,%.3f,%.3f,%.3f", c["x"], c["y"], c["w"], c["h"])).otherwise("")
    return F.concat(turned, cut)


def texture_cost(width, height) -> Column:
    return _col(width) * _col(height) * 4


def scope_display(path, home: str) -> Column:
    """A folder as its user thinks of it: documents of a sandbox by their tail, the home as '~'."""
    tail = F.regexp_extract(_col(path), r"(?s)^/run/user/[^/]*/doc/[^/]*/(.*)$", 1)
    portal = _col(path).rlike(r"(?s)^/run/user/[^/]*/doc/[^/]*/")
    return F.when(portal, tail).when(_col(path).startswith(home), F.concat(F.lit("~"), F.substring(_col(path), F.lit(len(home) + 1), F.length(_col(path))))).otherwise(_col(path))


def format_date(seconds) -> Column:
    return F.date_format(F.timestamp_seconds(_col(seconds)), "yyyy-MM-dd HH:mm")


def human_size(size) -> Column:
    """Decimal size with one place: '1 byte', '999 bytes', '1.2 kB', '3.4 MB'."""
    n = F.greatest(_col(size), F.lit(0))
    shown = F.when(n == 1, "1 byte").when(n < 1000, F.concat(n.cast("string"), F.lit(" bytes")))
    for power, unit in enumerate(["kB", "MB", "GB", "TB", "PB"], 1):
        shown = shown.when(n < 1000 ** (power + 1), F.format_string(f"%.1f {unit}", n / float(1000**power)))
    return shown.otherwise(F.format_string("%.1f EB", n / 1e18))


def dimensions_label(width, height) -> Column:
    return F.when(_col(width).isNotNull() & _col(height).isNotNull(), F.concat(_col(width).cast("string"), F.lit(" × "), _col(height).cast("string")))


def crop_within(existing, selected) -> Column:
    """A selection inside an existing crop, relative to the whole."""
    e, s = _col(existing), _col(selected)
    inside = F.struct((e["x"] + s["x"] * e["w"]).alias("x"), (e["y"] + s["y"] * e["h"]).alias("y"), (s["w"] * e["w"]).alias("w"), (s["h"] * e["h"]).alias("h"))
    return F.when(e.isNull(), s).otherwise(inside)


def fit_scale(width, height, view_width, view_height) -> Column:
    """The scale that shows a whole picture in a view."""
    return F.least(_col(view_width) / _col(width), _col(view_height) / _col(height))


def selection_rect(x0, y0, x1, y1, width, height, view_width, view_height) -> Column:
    """A dragged rectangle of the view as a part of the contained picture; null if they do not meet."""
    scale = fit_scale(width, height, view_width, view_height)
    w, h = _col(width) * scale, _col(height) * scale
    left, top = (_col(view_width) - w) / 2, (_col(view_height) - h) / 2
    cut = lambda v, low, size: F.least(F.greatest((_col(v) - low) / size, F.lit(0.0)), F.lit(1.0))
    xa, xb, ya, yb = cut(x0, left, w), cut(x1, left, w), cut(y0, top, h), cut(y1, top, h)
    rect = F.struct(F.least(xa, xb).alias("x"), F.least(ya, yb).alias("y"), F.abs(xb - xa).alias("w"), F.abs(yb - ya).alias("h"))
    return F.when((xa != xb) & (ya != yb), rect)


def clamp_zoom(zoom) -> Column:
    return F.least(F.greatest(_col(zoom), F.lit(0.05)), F.lit(20.0))


def collection_kind(text) -> Column:
    return F.when(_col(text) == "smart", "smart").otherwise("catalog")


def natural_key(name) -> Column:
    """Lower case with every run of digits padded to eight places, so that text order is number order."""
    runs = F.regexp_extract_all(F.lower(_col(name)), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))

    def padded(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=[0-9])", "")
        return F.when(run.rlike("^[0-9]"), F.when(F.length(digits) >= 8, digits).otherwise(F.lpad(digits, 8, "0"))).otherwise(run)

    return F.array_join(F.transform(runs, padded), "")


def crc32(data) -> Column:
    return F.crc32(_col(data))
