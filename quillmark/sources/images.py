"""Image headers and EXIF blocks: what an index keeps of a picture without decoding its pixels."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import camera_label, exif_seconds, exif_text, orientation_or_null
from ..functions.pixels import as_rgba, gradient_hash, orient, pixels_of_all

# EXIF tags.
MAKE, MODEL, ORIENTATION, DATE_TIME, EXIF_FOLDER, DATE_ORIGINAL = 0x010F, 0x0110, 0x0112, 0x0132, 0x8769, 0x9003
WIDTH, HEIGHT = 0x0100, 0x0101
# Brands of ISO media files that hold pictures.
BRANDS = {b"avif": "AVIF", b"avis": "AVIF", b"heic": "HEIF", b"heix": "HEIF", b"hevc": "HEIF", b"mif1": "HEIF", b"msf1": "HEIF"}
#: Formats of which pixels are decoded.
DECODED = ("JPEG", "PNG")
#: JPEG markers that carry the picture's size.
SIZE_MARKERS = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}


def exif_fields(blob: bytes) -> dict:
    """make, model, orientation, original and changed of a TIFF block; what cannot be read is absent."""
    blob = blob.removeprefix(b"Exif\0\0")
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(blob[:4])
    found: dict = {}
    if order is None:
        return found

    def folder(at: int, wanted: dict) -> None:
        try:
            (count,) = struct.unpack_from(order + "H", blob, at)
            for i in range(count):
                tag, kind, n, value = struct.unpack_from(order + "HHI4s", blob, at + 2 + 12 * i)
                name = wanted.get(tag)
                if name is None:
                    continue
                if kind == 2:
                    start = 0 if n <= 4 else struct.unpack(order + "I", value)[0]
                    found[name] = (value if n <= 4 else blob[start : start + n])[:n].split(b"\0")[0].decode("utf-8", "replace")
                elif kind in (3, 4):
                    found[name] = struct.unpack(order + ("H" if kind == 3 else "I"), value[: 2 if kind == 3 else 4])[0]
        except struct.error:
            return

    try:
        (first,) = struct.unpack_from(order + "I", blob, 4)
    except struct.error:
        return found
    folder(first, {MAKE: "make", MODEL: "model", ORIENTATION: "orientation", DATE_TIME: "changed", EXIF_FOLDER: "_exif"})
    if isinstance(at := found.pop("_exif", None), int):
        folder(at, {DATE_ORIGINAL: "original"})
    return found


def _jpeg(data: bytes) -> dict | None:
    at, found = 2, {"format": "JPEG"}
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF or 0xD0 <= marker <= 0xD9:
            at += 1 if marker == 0xFF else 2
            continue
        (size,) = struct.unpack_from(">H", data, at + 2)
        part = data[at + 4 : at + 2 + size]
        if marker == 0xE1 and part.startswith(b"Exif\0\0"):
            found["exif"] = part
        if marker in SIZE_MARKERS and len(part) >= 5:
            found["height"], found["width"] = struct.unpack_from(">HH", part, 1)
            return found
        at += 2 + size
    return None


def _png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 8 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        at += 12 + size


def _riff_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 12
    while at + 8 <= len(data):
        (size,) = struct.unpack_from("<I", data, at + 4)
        yield data[at : at + 4], data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def _exif(chunks: Iterator[tuple[bytes, bytes]], kind: bytes) -> dict:
    return next(({"exif": part} for name, part in chunks if name == kind), {})


def _tiff(data: bytes) -> dict | None:
    """The first folder's size; the file is its own EXIF block."""
    order = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "I", data, 4)
    (count,) = struct.unpack_from(order + "H", data, at)
    size: dict = {}
    for i in range(count):
        tag, kind, _, value = struct.unpack_from(order + "HHI4s", data, at + 2 + 12 * i)
        if tag in (WIDTH, HEIGHT) and kind in (3, 4):
            size[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), value[: 2 if kind == 3 else 4])[0]
    return {"format": "TIFF", "width": size[WIDTH], "height": size[HEIGHT], "exif": data} if len(size) == 2 else None


def _boxes(data: bytes) -> dict | None:
    """The largest picture that an ISO media file tells of (thumbnails and tiles are smaller)."""
    sizes = []

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            size, kind = struct.unpack_from(">I4s", data, at)
            head = 8
            if size == 1:
                (size,) = struct.unpack_from(">Q", data, at + 8)
                head = 16
            stop = end if size == 0 else min(end, at + size)
            if kind == b"ispe":
                sizes.append(struct.unpack_from(">II", data, at + head + 4))
            elif kind in (b"meta", b"iprp", b"ipco"):
                walk(at + head + (4 if kind == b"meta" else 0), stop)
            if stop <= at:
                return
            at = stop

    walk(0, len(data))
    if not sizes:
        return None
    width, height = max(sizes, key=lambda s: s[0] * s[1])
    return {"format": BRANDS[data[8:12]], "width": width, "height": height} | _media_exif(data)


def _children(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the boxes between two places: what stands behind their heads."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, at + 8)
            head = 16
        stop = end if size == 0 else min(end, at + size)
        if stop <= at:
            return
        yield kind, at + head, stop
        at = stop


def _number(data: bytes, at: int, size: int) -> int:
    if at + size > len(data):
        raise struct.error("cut off")
    return int.from_bytes(data[at : at + size], "big")


def _item_of_kind(data: bytes, start: int, end: int, kind: bytes) -> int | None:
    """The number of the first item of a kind in an ``iinf`` box."""
    version = data[start]
    at = start + (6 if version == 0 else 8)
    for box, a, _ in _children(data, at, end):
        if box == b"infe" and data[a] >= 2:
            wide = 4 if data[a] > 2 else 2
            if data[a + 6 + wide : a + 10 + wide] == kind:
                return _number(data, a + 4, wide)
    return None


def _item_bytes(data: bytes, start: int, item: int, inside: int | None) -> bytes:
    """An item's bytes by an ``iloc`` box; inside: where the ``idat`` box's bytes begin."""
    version = data[start]
    sizes = [data[start + 4] >> 4, data[start + 4] & 15, data[start + 5] >> 4, data[start + 5] & 15 if version else 0]
    wide = 4 if version == 2 else 2
    count, at = _number(data, start + 6, wide), start + 6 + wide
    for _ in range(count):
        number, at = _number(data, at, wide), at + wide
        method = 0
        if version:
            method, at = data[at + 1] & 15, at + 2
        base, at = _number(data, at + 2, sizes[2]), at + 2 + sizes[2]
        extents, at = _number(data, at, 2), at + 2
        out = []
        for _ in range(extents):
            at += sizes[3]
            offset, length = _number(data, at, sizes[0]), _number(data, at + sizes[0], sizes[1])
            at += sizes[0] + sizes[1]
            place = base + offset + (inside or 0 if method == 1 else 0)
            out.append(data[place : place + length])
        if number == item and method in (0, 1) and not (method == 1 and inside is None):
            return b"".join(out)
    return b""


def _behind_offset(block: bytes) -> dict:
    """The TIFF block of an EXIF item or box, which begins with the distance to it."""
    return {"exif": block[4 + _number(block, 0, 4) :]} if len(block) > 8 else {}


def _media_exif(data: bytes) -> dict:
    """The EXIF item of an ISO media file: its number by ``iinf``, its place by ``iloc``."""
    try:
        for kind, start, end in _children(data, 0, len(data)):
            if kind == b"meta":
                boxes = {k: (a, b) for k, a, b in _children(data, start + 4, end)}
                item = _item_of_kind(data, *boxes[b"iinf"], b"Exif")
                if item is not None:
                    return _behind_offset(_item_bytes(data, boxes[b"iloc"][0], item, boxes.get(b"idat", (None,))[0]))
    except (struct.error, KeyError, IndexError):
        pass
    return {}


class _LowBits:
    """Bits from the lowest of each byte on."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "little"), 8 * len(data)

    def take(self, n: int) -> int:
        if n > self.left:
            raise struct.error("cut off")
        out, self.value, self.left = self.value & (1 << n) - 1, self.value >> n, self.left - n
        return out


#: The shapes (width to height) that a JPEG XL size may name, from 1 on.
SHAPES = ((1, 1), (12, 10), (4, 3), (3, 2), (16, 9), (5, 4), (2, 1))


def _jxl_size(stream: bytes) -> tuple[int, int]:
    """Width and height of a JPEG XL codestream's header."""
    bits = _LowBits(stream[2:16])
    small = bits.take(1)
    edge = lambda: 8 * (1 + bits.take(5)) if small else 1 + bits.take((9, 13, 18, 30)[bits.take(2)])
    height = edge()
    shape = bits.take(3)
    if not shape:
        return edge(), height
    a, b = SHAPES[shape - 1]
    return height * a // b, height


def _jxl(data: bytes) -> dict | None:
    """A bare codestream, or one in boxes, whole or in parts."""
    if data[:2] == b"\xff\x0a":
        width, height = _jxl_size(data)
        return {"format": "JPEG XL", "width": width, "height": height}
    found: dict = {}
    for kind, start, end in _children(data, 0, len(data)):
        if kind in (b"jxlc", b"jxlp") and "width" not in found:
            stream = data[start + (4 if kind == b"jxlp" else 0) : end]
            if stream[:2] == b"\xff\x0a":
                found["width"], found["height"] = _jxl_size(stream)
        elif kind == b"Exif":
            found |= _behind_offset(data[start:end])
    return found | {"format": "JPEG XL"} if "width" in found else None


_SVG = re.compile(r"<(?:\w+:)?svg\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_SVG_SIZE = re.compile(r"(?<![\w:-])(width|height|viewBox)\s*=\s*[\"']\s*([^\"']*?)\s*[\"']")
#: Pixels of a unit of length.
UNITS = {"": 1.0, "px": 1.0, "pt": 4 / 3, "pc": 16.0, "in": 96.0, "cm": 96 / 2.54, "mm": 96 / 25.4}


def _svg(data: bytes) -> dict | None:
    """The size that a drawing's root tells in lengths, or by its view box."""
    root = _SVG.search(data[: 1 << 16].decode("utf-8", "replace"))
    if root is None:
        return None
    told = dict(_SVG_SIZE.findall(root[1]))
    size = {}
    box = re.split(r"[\s,]+", told.get("viewBox", ""))
    for i, name in enumerate(("width", "height")):
        length = re.fullmatch(r"([0-9]*\.?[0-9]+)\s*([a-z]*)", told.get(name, ""))
        if length and length[2] in UNITS:
            size[name] = round(float(length[1]) * UNITS[length[2]])
        elif len(box) == 4 and re.fullmatch(r"[0-9]*\.?[0-9]+", box[2 + i]):
            size[name] = round(float(box[2 + i]))
    return {"format": "SVG", **size} if len(size) == 2 else None


def probe(data: bytes) -> dict | None:
    """format, width, height and exif of a file's bytes; None if it is no image that is known."""
    try:
        if data[:2] == b"\xff\xd8":
            return _jpeg(data)
        if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
            width, height = struct.unpack_from(">II", data, 16)
            return {"format": "PNG", "width": width, "height": height} | _exif(_png_chunks(data), b"eXIf")
        if data[:4] in (b"II*\0", b"MM\0*"):
            return _tiff(data)
        if data[4:8] == b"ftyp" and data[8:12] in BRANDS:
            return _boxes(data)
        if data[:2] == b"\xff\x0a" or data[4:12] == b"JXL \r\n\x87\n":
            return _jxl(data)
        if data.lstrip()[:1] == b"<" or data[:3] == b"\xef\xbb\xbf":
            return _svg(data)
        if data[:6] in (b"GIF87a", b"GIF89a"):
            width, height = struct.unpack_from("<HH", data, 6)
            return {"format": "GIF", "width": width, "height": height}
        if data[:2] == b"BM" and len(data) >= 26:
            width, height = struct.unpack_from("<ii", data, 18)
            return {"format": "BMP", "width": width, "height": abs(height)}
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            if data[12:16] == b"VP8X":
                width, height = (1 + int.from_bytes(data[i : i + 3], "little") for i in (24, 27))
            elif data[12:16] == b"VP8L":
                bits = int.from_bytes(data[21:25], "little")
                width, height = 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
            else:
                width, height = (v & 0x3FFF for v in struct.unpack_from("<HH", data, 26))
            return {"format": "WebP", "width": width, "height": height} | _exif(_riff_chunks(data), b"EXIF")
    except (struct.error, IndexError):
        pass
    return None


def with_contents(paths: DataFrame) -> DataFrame:
    """path and content of files that the executors see; null content where a file cannot be read."""

    def run(frames):
        for frame in frames:
            for path in frame["path"]:  # one file at a time is held
                try:
                    with open(path, "rb") as file:
                        content = file.read()
                except OSError:
                    content = None
                yield pd.DataFrame({"path": [path], "content": pd.Series([content], dtype=object)})

    return paths.select("path").mapInPandas(run, "path string, content binary")


def pixel_hash(image: np.ndarray | None, orientation: int | None = None) -> int | None:
    """The perceptual hash of a picture's upright pixels, without alpha."""
    if image is None:
        return None
    rgb = as_rgba(image)[:, :, :3]
    turned = orient(rgb, orientation) if orientation else None
    rgb = np.ascontiguousarray(rgb if turned is None else turned)
    return gradient_hash(rgb.tobytes(), rgb.shape[1], rgb.shape[0])


def enriched(contents: DataFrame) -> DataFrame:
    """path and the decode-derived columns of rows (path, content).

    A file that cannot be read as an image gets 0 x 0, which also marks it as done. phash is that of the
    upright pixels where they can be decoded here (JPEG; PNG of 8 bits a channel, not interlaced), else null.
    """

    def run(frames):
        for frame in frames:
            out = []
            told = [probe(bytes(content)) if content is not None else None for content in frame["content"]]
            pixels = pixels_of_all(c if t and t["format"] in DECODED else None for c, t in zip(frame["content"], told, strict=True))
            for path, found, image in zip(frame["path"], told, pixels, strict=True):
                exif = exif_fields((found or {}).get("exif", b""))
                seen = found or {"width": 0, "height": 0, "format": None}
                out.append((path, seen["width"], seen["height"], seen["format"], exif.get("make"), exif.get("model"), exif.get("original", exif.get("changed")), exif.get("orientation"), pixel_hash(image, exif.get("orientation"))))
            yield pd.DataFrame(out, columns=["path", "width", "height", "format", "make", "model", "taken", "orientation", "phash"]).astype({"orientation": "Int64", "phash": "Int64"})

    raw = contents.select("path", "content").mapInPandas(run, "path string, width long, height long, format string, make string, model string, taken string, orientation long, phash long")
    return raw.select("path", "phash", "width", "height", "format", exif_seconds("taken").alias("date_taken"), camera_label(exif_text("make"), exif_text("model")).alias("camera"), orientation_or_null("orientation").alias("orientation"))
