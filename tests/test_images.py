"""Headers and EXIF of further formats, and pixels of PNG."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from quillmark.functions import pixels
from quillmark.plans import components
from quillmark.sources import images


def _folder(order, *entries):
    out = struct.pack(order + "H", len(entries))
    for tag, kind, value in entries:
        out += struct.pack(order + "HHI", tag, kind, 1) + struct.pack(order + ("HH" if kind == 3 else "I"), *((value, 0) if kind == 3 else (value,)))
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + out + b"\0" * 4


@pytest.mark.parametrize("order", "<>")
def test_tiff(order):
    data = _folder(order, (images.WIDTH, 3, 640), (images.HEIGHT, 4, 480), (images.ORIENTATION, 3, 6))
    found = images.probe(data)
    assert (found["format"], found["width"], found["height"]) == ("TIFF", 640, 480)
    assert images.exif_fields(found["exif"]) == {"orientation": 6}
    assert images.probe(data[:12]) is None and images.probe(_folder(order, (images.WIDTH, 3, 640))) is None


def test_exif_of_png_and_webp():
    blob = _folder("<", (images.ORIENTATION, 3, 8))
    image = np.zeros((2, 3, 4), np.uint8)
    png = pixels.encode_png(image)
    with_exif = png[:33] + pixels.png_chunk(b"eXIf", blob) + png[33:]
    assert images.exif_fields(images.probe(with_exif)["exif"]) == {"orientation": 8} and "exif" not in images.probe(png)
    vp8x = struct.pack("<4sI", b"VP8X", 10) + b"\0" * 4 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    body = b"WEBP" + vp8x + struct.pack("<4sI", b"EXIF", len(blob)) + blob
    found = images.probe(b"RIFF" + struct.pack("<I", len(body)) + body)
    assert (found["width"], found["height"]) == (100, 50) and images.exif_fields(found["exif"]) == {"orientation": 8}


def test_iso_media():
    box = lambda kind, body: struct.pack(">I4s", 8 + len(body), kind) + body
    ispe = lambda w, h: box(b"ispe", b"\0" * 4 + struct.pack(">II", w, h))
    for brand, name in ((b"avif", "AVIF"), (b"heic", "HEIF")):
        data = box(b"ftyp", brand + b"\0" * 4) + box(b"meta", b"\0" * 4 + box(b"iprp", box(b"ipco", ispe(160, 120) + ispe(4000, 3000))))
        assert images.probe(data) == {"format": name, "width": 4000, "height": 3000}
    assert images.probe(box(b"ftyp", b"avif")) is None


def _filtered(image, kinds):
    """The image as PNG with a filter for each line, by the definition of the filters."""
    height, width, step = image.shape
    raw = image.reshape(height, -1).astype(int)
    out = b""
    for y in range(height):
        line = []
        for i in range(width * step):
            a = raw[y, i - step] if i >= step else 0
            b = raw[y - 1, i] if y else 0
            c = raw[y - 1, i - step] if y and i >= step else 0
            p = a + b - c
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((raw[y, i] - [0, a, b, (a + b) // 2, near][kinds[y % len(kinds)]]) % 256)
        out += bytes([kinds[y % len(kinds)], *line])
    header = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[step], 0, 0, 0)
    half = zlib.compress(out)
    chunks = [(b"IHDR", header), (b"IDAT", half[:20]), (b"IDAT", half[20:]), (b"IEND", b"")]
    return pixels.PNG + b"".join(pixels.png_chunk(k, d) for k, d in chunks)


@pytest.mark.parametrize("step", [1, 2, 3, 4])
@pytest.mark.parametrize("kinds", [(0,), (1,), (2,), (3,), (4,), (4, 1, 3, 2, 0)])
def test_png_pixels(step, kinds):
    image = np.random.default_rng(step).integers(0, 256, (7, 5, step), dtype=np.uint8)
    assert (pixels.decode_png(_filtered(image, kinds)) == image).all()


def test_what_is_not_decoded():
    png = pixels.encode_png(np.zeros((2, 2, 4), np.uint8))
    assert pixels.decode_png(png[:24] + bytes([16]) + png[25:]) is None
    assert pixels.decode_png(b"") is None and pixels.decode_png(png[:40]) is None and pixels.decode_png(b"no png at all" * 9) is None


def test_enrichment_hashes_pixels(spark):
    ramp = np.repeat(np.arange(0, 250, 5, dtype=np.uint8)[None, :, None], 40, axis=0).repeat(4, axis=2)
    rows = [("up", bytearray(pixels.encode_png(ramp))), ("down", bytearray(pixels.encode_png(np.ascontiguousarray(ramp[:, ::-1])))), ("gif", bytearray(b"GIF89a" + bytes([1, 0, 2, 0]))), ("none", None)]
    got = {r["path"]: r["phash"] for r in images.enriched(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"up": -1, "down": 0, "gif": None, "none": None}


def test_tables_are_cleared_since_a_mark(spark):
    kept = components.written(spark.range(3), "kept")
    mark = components.written_so_far()
    gone, last = (components.written(spark.range(n), "x") for n in (4, 5))
    assert components.clear_written(spark, mark, keep=1) == 1
    assert kept.count() == 3 and last.count() == 5
    with pytest.raises(Exception, match="(?i)exist|found"):
        gone.count()


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def media(brand: bytes, block: bytes, version: int, inside: bool, split: bool) -> bytes:
    """An ISO media picture of 40 x 30 whose EXIF item lies in ``idat``, or behind the boxes, in one part or two."""
    item = struct.pack(">I", 0) + block
    cuts = [item[:7], item[7:]] if split else [item]
    wide = ">I" if version == 2 else ">H"
    kinds = b"".join(box(b"infe", bytes([2, 0, 0, 0]), struct.pack(">HH", i, 0), kind, b"\0") for i, kind in ((1, b"hvc1"), (7, b"Exif")))
    iinf = box(b"iinf", b"\0\0\0\0", struct.pack(">H", 2), kinds)
    sizes = box(b"iprp", box(b"ipco", box(b"ispe", b"\0\0\0\0", struct.pack(">II", 40, 30))))

    def made(base: int) -> bytes:
        def entry(number: int, parts: list[tuple[int, int]], method: int) -> bytes:
            return struct.pack(wide, number) + (struct.pack(">H", method) if version else b"") + struct.pack(">HI", 0, base if number == 7 and not method else 0) + struct.pack(">H", len(parts)) + b"".join(struct.pack(">II", *p) for p in parts)

        at, parts = 0, []
        for c in cuts:
            parts.append((at, len(c)))
            at += len(c)
        iloc = box(b"iloc", bytes([version, 0, 0, 0, 0x44, 0x40]), struct.pack(wide, 2), entry(1, [(0, 1)], 0), entry(7, parts, 1 if inside else 0))
        return box(b"ftyp", brand, b"\0\0\0\0", b"mif1") + box(b"meta", b"\0\0\0\0", iinf, iloc, sizes, box(b"idat", *(cuts if inside else [])))

    head = made(0)
    return made(len(head) + 8) + box(b"mdat", b"" if inside else item)


@pytest.mark.parametrize("brand,name", [(b"heic", "HEIF"), (b"avif", "AVIF")])
@pytest.mark.parametrize("version,inside,split", [(0, False, False), (1, True, False), (1, False, True), (2, True, True)])
def test_exif_of_media_items(brand, name, version, inside, split):
    block = b"II*\0" + struct.pack("<IHHHIHHI", 8, 1, 0x0112, 3, 1, 6, 0, 0)
    data = media(brand, block, version, inside, split)
    found = images.probe(data)
    assert (found["format"], found["width"], found["height"]) == (name, 40, 30)
    assert images.exif_fields(found["exif"]) == {"orientation": 6}
    assert all((images.probe(data[:n]) or {}).get("width") in (None, 40) for n in range(0, len(data), 5))


def jxl(width: int, height: int, shape: int = 0) -> bytes:
    bits = []
    put = lambda v, n: bits.extend(v >> i & 1 for i in range(n))

    def edge(v: int, small: bool) -> None:
        if small:
            return put(v // 8 - 1, 5)
        k = next(k for k, n in enumerate((9, 13, 18, 30)) if v <= 1 << n)
        put(k, 2)
        put(v - 1, (9, 13, 18, 30)[k])

    small = not (width % 8 or height % 8 or max(width, height) > 256)
    put(small, 1)
    edge(height, small)
    put(shape, 3)
    if not shape:
        edge(width, small)
    bits += [0] * 40
    return b"\xff\x0a" + bytes(sum(b << i for i, b in enumerate(bits[k : k + 8])) for k in range(0, len(bits) // 8 * 8, 8))


@pytest.mark.parametrize("width,height,shape", [(256, 8, 0), (300, 200, 0), (5000, 9000, 0), (100_000, 1, 0), (500, 500, 1), (160, 120, 3), (1920, 1080, 5)])
def test_sizes_of_jpeg_xl(width, height, shape):
    stream = jxl(width, height, shape)
    boxed = struct.pack(">I", 12) + b"JXL \r\n\x87\n" + box(b"ftyp", b"jxl ") + box(b"Exif", b"\0\0\0\0", b"II*\0" + struct.pack("<IHHHIHHI", 8, 1, 0x0112, 3, 1, 8, 0, 0)) + box(b"jxlp", b"\0\0\0\0", stream)
    assert images.probe(stream) == {"format": "JPEG XL", "width": width, "height": height}
    found = images.probe(boxed)
    assert (found["width"], found["height"]) == (width, height) and images.exif_fields(found["exif"]) == {"orientation": 8}
    assert images.probe(stream[:3]) is None


def test_sizes_of_drawings():
    told = {
        "<svg width='10' height=\"20px\"/>": (10, 20),
        "\ufeff<?xml version='1.0'?><!-- x --><svg:svg viewBox='0 0 30.4 40' width='100%'>": (30, 40),
        "<svg xmlns='a>b' width='1in' height='72pt'>": (96, 96),
        "<svg stroke-width='3' height='5' viewBox='0,0,7,9'>": (7, 5),
    }
    assert {t: (f["width"], f["height"]) for t in told if (f := images.probe(t.encode()))} == told
    assert images.probe(b"<html><body>") is None and images.probe(b"<svg>") is None
