"""Pixel operators on RGBA8 rasters, in numpy; rows of a DataFrame pass through mapInPandas."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import jpeg

PNG = b"\x89PNG\r\n\x1a\n"
#: Pictures are coded together up to so many samples; a larger one is coded alone.
TOGETHER = 1 << 19


def raster(data: bytes, width: int, height: int, stride: int | None = None, channels: int = 4) -> np.ndarray | None:
    """height x width x channels, without row padding; None if malformed."""
    row = width * channels
    stride = row if stride is None else stride
    if width <= 0 or height <= 0 or stride < row or len(data) < stride * height:
        return None
    return np.frombuffer(data, np.uint8, stride * height).reshape(height, stride)[:, :row].reshape(height, width, channels)


def _half_up(x: float) -> int:
    return int(np.floor(x + 0.5))


def resize(image: np.ndarray, longest: int) -> np.ndarray:
    """Longest edge at most ``longest``, by averages over boxes; smaller images stay as they are."""
    height, width, _ = image.shape
    if max(width, height) <= longest:
        return image
    scale = longest / max(width, height)
    new_w, new_h = max(1, _half_up(width * scale)), max(1, _half_up(height * scale))
    sums = np.zeros((height + 1, width + 1, image.shape[2]))
    sums[1:, 1:] = image.cumsum(0, dtype=np.float64).cumsum(1)
    edges = lambda n, size: (np.floor(np.arange(n) * size / n).astype(int), np.maximum(np.ceil((np.arange(n) + 1) * size / n).astype(int), 1))
    (top, bottom), (left, right) = edges(new_h, height), edges(new_w, width)
    total = sums[bottom][:, right] - sums[top][:, right] - sums[bottom][:, left] + sums[top][:, left]
    area = ((bottom - top)[:, None] * (right - left)[None, :])[:, :, None]
    return np.floor(total / area + 0.5).astype(np.uint8)


def orient(image: np.ndarray, orientation: int) -> np.ndarray | None:
    """The upright image of an EXIF orientation 2 to 8; None otherwise."""
    turned = {2: lambda x: x[:, ::-1], 3: lambda x: x[::-1, ::-1], 4: lambda x: x[::-1], 5: lambda x: x.swapaxes(0, 1), 6: lambda x: np.rot90(x, -1), 7: lambda x: np.rot90(x, 2).swapaxes(0, 1), 8: lambda x: np.rot90(x)}
    return turned[orientation](image) if orientation in turned else None


def crop(image: np.ndarray, rect: tuple[float, float, float, float]) -> np.ndarray | None:
    """A normalised rectangle of the image; None if nothing is left."""
    height, width, _ = image.shape
    x, y, w, h = (min(1.0, max(0.0, v)) for v in rect)
    x0, y0 = _half_up(x * width), _half_up(y * height)
    part = image[y0 : y0 + _half_up(h * height), x0 : x0 + _half_up(w * width)]
    return part if part.shape[0] and part.shape[1] else None


@lru_cache(32)
def lanczos(size: int, new: int) -> np.ndarray:
    """new x size weights of the windowed sine of three lobes; its support grows with the ratio. Not to be written to."""
    ratio = size / new
    wide = max(ratio, 1.0)
    out = np.zeros((new, size))
    for i in range(new):
        centre = (i + 0.5) * ratio
        left = min(max(int(np.floor(centre - 3 * wide)), 0), size - 1)
        right = min(max(int(np.ceil(centre + 3 * wide)), left + 1), size)
        x = (np.arange(left, right) - (centre - 0.5)) / wide
        row = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
        out[i, left:right] = row / row.sum()
    return out


def gradient_hash(rgb: bytes, width: int, height: int) -> int | None:
    """64-bit difference hash as a signed integer: each of 8 x 8 grey cells against its right neighbour.

    Grey is a whole-number mean with the weights of the sRGB primaries; the picture is resampled to 9 x 8
    cells, rows first, and a bit is set where the right cell is the brighter one, first cell lowest.
    """
    if len(rgb) != width * height * 3 or not rgb:
        return None
    image = np.frombuffer(rgb, np.uint8).reshape(height, width, 3).astype(np.int64)
    grey = image @ np.array([2126, 7152, 722]) // 10000
    cells = lanczos(height, 8) @ grey @ lanczos(width, 9).T
    cells = np.clip(np.floor(cells + 0.5), 0, 255)
    bits = (cells[:, 1:] > cells[:, :-1]).ravel()
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little", signed=True)


def gradient_hashes(rasters: DataFrame) -> DataFrame:
    """path and phash of RGBA rasters (path, data, width, height, stride); null if malformed."""

    def run(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                image = raster(bytes(r.data), int(r.width), int(r.height), None if pd.isna(r.stride) else int(r.stride))
                out.append((r.path, None if image is None else gradient_hash(np.ascontiguousarray(image[:, :, :3]).tobytes(), image.shape[1], image.shape[0])))
            yield pd.DataFrame({"path": [p for p, _ in out], "phash": pd.array([h for _, h in out], dtype="Int64")})

    return rasters.mapInPandas(run, "path string, phash long")


def png_chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def add_text_chunks(png: bytes, entries: list[tuple[str, str]]) -> bytes | None:
    """The PNG with text chunks after its header; None if it is not one."""
    if len(png) < 20 or png[:8] != PNG or png[12:16] != b"IHDR":
        return None
    end = 20 + struct.unpack(">I", png[8:12])[0]
    if len(png) < end:
        return None
    return png[:end] + b"".join(png_chunk(b"tEXt", k.encode() + b"\0" + t.encode()) for k, t in entries) + png[end:]


def encode_png(image: np.ndarray) -> bytes:
    """Lossless."""
    height, width, channels = image.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, -1)], axis=1).tobytes()
    header = struct.pack(">IIBBBBB", width, height, 8, 6 if channels == 4 else 2, 0, 0, 0)
    return PNG + png_chunk(b"IHDR", header) + png_chunk(b"IDAT", zlib.compress(rows)) + png_chunk(b"IEND", b"")


#: Channels of the PNG colour types that are decoded (fixed values).
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode_png(png: bytes) -> np.ndarray | None:
    """height x width x channels of a PNG of 8 bits a channel that is not interlaced; None otherwise."""
    if png[:8] != PNG or len(png) < 33:
        return None
    width, height, depth, colour, _, _, interlaced = struct.unpack_from(">IIBBBBB", png, 16)
    if depth != 8 or interlaced or colour not in CHANNELS or not width or not height:
        return None
    at, parts = 8, []
    while at + 8 <= len(png):
        size, kind = struct.unpack_from(">I4s", png, at)
        if kind == b"IDAT":
            parts.append(png[at + 8 : at + 8 + size])
        at += 12 + size
    step = CHANNELS[colour]
    row = width * step
    try:
        data = zlib.decompress(b"".join(parts))
    except zlib.error:
        return None
    if len(data) < height * (row + 1):
        return None
    lines = np.frombuffer(data, np.uint8, height * (row + 1)).reshape(height, row + 1)
    out = np.zeros((height, row), np.uint8)
    above = np.zeros(row, np.uint8)
    for y in range(height):
        kind, line = int(lines[y, 0]), lines[y, 1:]
        if kind > 4:
            return None
        if kind == 1:
            line = line.reshape(width, step).cumsum(axis=0, dtype=np.uint64).astype(np.uint8).ravel()
        elif kind == 2:
            line = line + above
        elif kind:
            line = _unfiltered(line, above, step, kind)
        out[y] = above = line
    return out.reshape(height, width, step)


def _unfiltered(line: np.ndarray, above: np.ndarray, step: int, kind: int) -> np.ndarray:
    """A line of filter 3 (the mean of left and above) or 4 (whichever of the neighbours is nearest)."""
    left, up, corner = [0] * step, above.tolist(), [0] * step
    out = []
    for i, x in enumerate(line.tolist()):
        c = i % step
        a, b = left[c], up[i]
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - corner[c]
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - corner[c]), 2, corner[c]))[2]
            corner[c] = b
        left[c] = (x + guess) & 255
        out.append(left[c])
    return np.array(out, np.uint8)


def transformed(rasters: DataFrame, longest: int | None = None) -> DataFrame:
    """Rows (path, data, width, height, stride, orientation, crop x, y, w, h): oriented, cropped, shrunk.

    Malformed rasters and empty crops give null data with 0 x 0.
    """

    def run(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                image = raster(bytes(r.data), int(r.width), int(r.height), None if pd.isna(r.stride) else int(r.stride))
                if image is not None and not pd.isna(r.orientation):
                    turned = orient(image, int(r.orientation))
                    image = image if turned is None else turned
                if image is not None and not any(pd.isna(v) for v in (r.x, r.y, r.w, r.h)):
                    image = crop(image, (r.x, r.y, r.w, r.h))
                if image is not None and longest:
                    image = resize(image, longest)
                out.append((r.path, None if image is None else np.ascontiguousarray(image).tobytes(), 0 if image is None else image.shape[1], 0 if image is None else image.shape[0]))
            yield pd.DataFrame(out, columns=["path", "data", "width", "height"])

    return rasters.mapInPandas(run, "path string, data binary, width long, height long")


def baked(rasters: DataFrame) -> DataFrame:
    """path and content of rows (path, data, width, height): files of upright rasters by their paths' endings.

    ``jpg`` and ``jpeg`` (in any case) are JPEG of quality 90 without alpha, all others PNG. Null content
    for malformed rasters.
    """

    def run(frames):
        for frame in frames:
            out: list = [None] * len(frame)
            waiting: dict[tuple, list] = {}  # of one size: places and pictures

            def flush(shape: tuple) -> None:
                places, images = zip(*waiting.pop(shape), strict=True)
                for i, content in zip(places, jpeg.encode_all(np.stack(images)), strict=True):
                    out[i] = content

            held = 0
            for i, r in enumerate(frame.itertuples(index=False)):
                image = None if r.data is None else raster(bytes(r.data), int(r.width), int(r.height))
                if image is None:
                    continue
                if r.path.rsplit(".", 1)[-1].lower() not in ("jpg", "jpeg"):
                    out[i] = encode_png(image)
                    continue
                waiting.setdefault(image.shape, []).append((i, image))
                held += image.size
                if held >= TOGETHER:
                    for shape in list(waiting):
                        flush(shape)
                    held = 0
            for shape in list(waiting):
                flush(shape)
            yield pd.DataFrame({"path": frame["path"], "content": pd.Series(out, dtype=object)})

    return rasters.select("path", "data", "width", "height").mapInPandas(run, "path string, content binary")


def decoded(files: DataFrame) -> DataFrame:
    """Rasters (path, data in RGBA, width, height) of rows (path, content), and the format of what was read:
    PNG and JPEG; null data and format for others."""

    def run(frames):
        for frame in frames:
            out = []
            for path, content, image in zip(frame["path"], frame["content"], pixels_of_all(frame["content"]), strict=True):
                if image is None:
                    out.append((path, None, 0, 0, None))
                else:
                    out.append((path, as_rgba(image).tobytes(), image.shape[1], image.shape[0], "JPEG" if content[:2] == b"\xff\xd8" else "PNG"))
            yield pd.DataFrame(out, columns=["path", "data", "width", "height", "format"])

    return files.select("path", "content").mapInPandas(run, "path string, data binary, width long, height long, format string")


def pixels_of_all(contents: Iterable[bytes | None]) -> Iterator[np.ndarray | None]:
    """Samples of PNGs and JPEGs as they are stored, in order; None for anything else."""
    waiting: list = []
    held = 0
    for content in contents:
        content = b"" if content is None else bytes(content)
        read = jpeg.parsed(content) if content[:2] == b"\xff\xd8" else decode_png(content)
        waiting.append(read)
        held += 0 if read is None else read.samples if isinstance(read, jpeg.Parsed) else read.size
        if held >= TOGETHER:
            yield from _images(waiting)
            waiting, held = [], 0
    yield from _images(waiting)


def _images(read: list) -> list[np.ndarray | None]:
    made = iter(jpeg.images([r for r in read if isinstance(r, jpeg.Parsed)]))
    return [next(made) if isinstance(r, jpeg.Parsed) else r for r in read]


def as_rgba(image: np.ndarray) -> np.ndarray:
    """Samples of 1 to 4 channels (grey, grey and alpha, colour, colour and alpha) as RGBA."""
    depth = image.shape[2]
    colour = image[:, :, :3] if depth > 2 else np.repeat(image[:, :, :1], 3, axis=2)
    alpha = image[:, :, -1:] if depth in (2, 4) else np.full_like(image[:, :, :1], 255)
    return np.ascontiguousarray(np.concatenate([colour, alpha], axis=2))
