"""JPEG against pictures of known samples: sequential files of the encoder, progressive ones written here."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from quillmark.functions import jpeg, pixels
from quillmark.registry import queries
from quillmark.sources import images


def picture(height: int, width: int, depth: int = 3) -> np.ndarray:
    y, x = np.mgrid[0:height, 0:width]
    return np.stack([np.clip(128 + 90 * np.sin(x / 17 + k) + 30 * np.cos(y / (11 + k)), 0, 255) for k in range(depth)], 2).astype(np.uint8)


def off(a, b) -> int:
    return int(np.abs(a.astype(int) - b.astype(int)).max())


@pytest.mark.parametrize("shape", [(1, 1, 3), (8, 8, 3), (17, 33, 3), (50, 70, 1), (64, 65, 4)])
@pytest.mark.parametrize("chroma,restart", [(1, 0), (1, 3), (2, 0), (2, 1)])
def test_sequential_round_trip(shape, chroma, restart):
    image = picture(*shape)
    read = jpeg.decode(jpeg.encode(image, 100, chroma, restart))
    kept = image[:, :, :3] if shape[2] > 2 else image
    assert read.shape == kept.shape and off(read, kept) <= (2 if chroma == 1 else 6)
    grey = lambda x: x[:, :, 0].astype(float) if x.shape[2] == 1 else x @ np.array([0.299, 0.587, 0.114])
    assert np.abs(grey(read) - grey(kept)).max() <= 2


def test_error_stays_within_the_quantiser():
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (40, 56, 1), dtype=np.uint8)
    for quality in (10, 50, 90, 100):
        steps = jpeg.quantiser(jpeg.LUMA_STEPS, quality).astype(float)
        read = jpeg.decode(jpeg.encode(image, quality)).astype(float)
        # Half a step for each coefficient, and rounding and clipping of samples.
        assert np.sqrt(((read - image) ** 2).mean()) <= np.sqrt((steps**2).mean()) / 2 + 0.5


def test_all_symbols_and_long_codes():
    """Runs of zeros, full blocks, and code lengths that must be cut to 16."""
    rng = np.random.default_rng(5)
    image = np.where(rng.random((96, 96, 1)) < 0.02, 255, 0).astype(np.uint8)
    assert off(jpeg.decode(jpeg.encode(image, 100)), image) <= 2
    counts = {i: 1 << i for i in range(24)}
    lengths = jpeg._lengths(counts)
    assert max(lengths.values()) <= 16 and sum(2.0**-n for n in lengths.values()) < 1


def test_what_is_damaged_gives_none():
    data = jpeg.encode(picture(40, 40), 90)
    assert jpeg.decode(b"") is None and jpeg.decode(b"\xff\xd8") is None and jpeg.decode(b"no jpeg") is None
    assert all(jpeg.decode(data[:n]) is None for n in range(0, len(data) - 3, 41))
    twelve = bytearray(data)
    twelve[data.index(b"\xff\xc0") + 4] = 12
    assert jpeg.decode(bytes(twelve)) is None
    rng = np.random.default_rng(9)
    for _ in range(60):  # never an exception
        cut = bytearray(data)
        cut[rng.integers(2, len(cut))] = rng.integers(256)
        jpeg.decode(bytes(cut))


# --- progressive files ---------------------------------------------------------------------


def levels_of(image: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Quantised coefficients of a grey picture in zigzag order, and its blocks across and down."""
    height, width = image.shape
    rows, columns = -(-height // 8), -(-width // 8)
    full = np.pad(image.astype(float), ((0, 8 * rows - height), (0, 8 * columns - width)), "edge")
    blocks = full.reshape(rows, 8, columns, 8).swapaxes(1, 2).reshape(-1, 8, 8) - 128
    return np.rint((jpeg.COSINES @ blocks @ jpeg.COSINES.T).reshape(-1, 64) / steps).astype(int)[:, jpeg.ZIGZAG], columns, rows


def scan(kind: int, items: list[tuple], first: int, last: int, high: int, low: int) -> bytes:
    """A scan of (symbol or None, bits as text): its table, header and data."""
    seen = sorted({s for s, _ in items if s is not None})
    body, codes, sizes = jpeg._codes({s: 1 + sum(x == s for x, _ in items) for s in seen}) if seen else (bytes(16), None, None)
    bits = "".join(("" if s is None else format(int(codes[s]), f"0{sizes[s]}b")) + more for s, more in items)
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    table = jpeg._segment(0xC4, bytes([16 * kind]) + body) if seen else b""
    return table + jpeg._segment(0xDA, bytes([1, 1, 0, first, last, 16 * high + low])) + data


def magnitude(v: int) -> tuple[int, str]:
    n = abs(v).bit_length()
    return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""


def cut(v: int, low: int) -> int:
    """Towards zero, as the alternating coefficients are."""
    return (abs(v) >> low) * (1 if v > 0 else -1)


def dc_first(levels, low):
    out, last = [], 0
    for v in levels[:, 0].tolist():
        n, bits = magnitude((v >> low) - last)
        out.append((n, bits))
        last = v >> low
    return out


def ends(run: int) -> list[tuple]:
    n = run.bit_length() - 1
    return [(16 * n, format(run - (1 << n), f"0{n}b") if n else "")] if run else []


def ac_first(levels, first, last, low):
    out, waiting = [], 0
    for block in levels.tolist():
        gap, found = 0, False
        for k in range(first, last + 1):
            v = cut(block[k], low)
            if not v:
                gap += 1
                continue
            out += ends(waiting)
            waiting = 0
            out += [(0xF0, "")] * (gap // 16)
            n, bits = magnitude(v)
            out.append((16 * (gap % 16) + n, bits))
            gap = 0
        if gap:
            waiting += 1
        if waiting == 0x7FFF:
            out += ends(waiting)
            waiting = 0
    return out + ends(waiting)


def ac_more(levels, first, last, low):
    """One bit more of known coefficients; each block ends on its own."""
    out = []
    for block in levels.tolist():
        now = [abs(v) >> low for v in block]
        new = [k for k in range(first, last + 1) if now[k] == 1]
        k = first
        for at in new:
            gap, bits = 0, ""
            pending = []
            while k < at:
                if now[k] > 1:
                    bits += str(now[k] & 1)
                else:
                    gap += 1
                    if gap == 16:  # the rest of a long gap's corrections follow its code
                        nxt = k + 1
                        while nxt < at and now[nxt] > 1:
                            nxt += 1
                        pending.append((0xF0, None, bits))
                        gap, bits = 0, ""
                k += 1
            out += [(s, b) for s, _, b in pending]
            out.append((16 * gap + 1, ("1" if block[at] > 0 else "0") + bits))
            k = at + 1
        if k <= last:
            out.append((0, "".join(str(now[j] & 1) for j in range(k, last + 1) if now[j] > 1)))
    return out


def progressive(image: np.ndarray, steps: np.ndarray) -> bytes:
    levels, columns, rows = levels_of(image, steps)
    height, width = image.shape
    out = b"\xff\xd8" + jpeg._segment(0xDB, b"\0" + steps[jpeg.ZIGZAG].astype(np.uint8).tobytes())
    out += jpeg._segment(0xC2, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0]))
    out += scan(0, dc_first(levels, 1), 0, 0, 0, 1)
    out += scan(1, ac_first(levels, 1, 5, 2), 1, 5, 0, 2) + scan(1, ac_first(levels, 6, 63, 2), 6, 63, 0, 2)
    out += scan(1, ac_more(levels, 1, 63, 1), 1, 63, 2, 1)
    out += scan(0, [(None, str(v & 1)) for v in levels[:, 0].tolist()], 0, 0, 1, 0)
    out += scan(1, ac_more(levels, 1, 63, 0), 1, 63, 1, 0)
    return out + b"\xff\xd9"


@pytest.mark.parametrize("shape,quality,noise", [((8, 8), 100, 0), ((24, 40), 90, 0), ((33, 50), 100, 30), ((64, 64), 75, 60)])
def test_progressive_equals_sequential(shape, quality, noise):
    rng = np.random.default_rng(shape[1])
    image = np.clip(picture(*shape, 1)[:, :, 0].astype(int) + rng.integers(-noise, noise + 1, shape), 0, 255).astype(np.uint8)
    steps = jpeg.quantiser(jpeg.LUMA_STEPS, quality)
    read = jpeg.decode(progressive(image, steps))
    assert read is not None and (read == jpeg.decode(jpeg.encode(image[:, :, None], quality))).all()


# --- what the catalogue makes of it -----------------------------------------------------------


def test_photographs_are_hashed(spark):
    image = picture(60, 90)
    exif = b"Exif\0\0II*\0" + struct.pack("<IHHHIHH", 8, 1, 0x0112, 3, 1, 6, 0) + bytes(4)
    data = jpeg.encode(image, 95)
    tagged = data[:2] + jpeg._segment(0xE1, exif) + data[2:]
    turned = jpeg.encode(np.ascontiguousarray(np.rot90(image, -1)), 95)
    rows = spark.createDataFrame([("a", data), ("tagged", tagged), ("turned", turned), ("cut", data[:300]), ("small", jpeg.encode(image[::2, ::2], 70))], "path string, content binary")
    got = {r.path: r for r in images.enriched(rows).collect()}
    far = lambda a, b: bin((got[a].phash ^ got[b].phash) & (1 << 64) - 1).count("1")
    assert far("a", "small") <= 8 and far("tagged", "turned") <= 4 and far("a", "turned") > 8
    assert got["tagged"].orientation == 6 and got["cut"].phash is None and (got["a"].width, got["a"].height) == (90, 60)


def test_baking_and_reading(spark):
    image = np.dstack([picture(20, 30), np.full((20, 30), 77, np.uint8)])
    rows = spark.createDataFrame([(p, image.tobytes(), 30, 20) for p in ("/a.jpg", "/a.JPEG", "/a.png", "/a")] + [("/bad.jpg", b"xx", 30, 20)], "path string, data binary, width long, height long")
    read = {r.path: r for r in pixels.decoded(pixels.baked(rows)).collect()}
    back = {p: np.frombuffer(r.data, np.uint8).reshape(20, 30, 4) for p, r in read.items() if r.data is not None}
    assert (back["/a.png"] == image).all() and (back["/a"] == image).all() and read["/bad.jpg"].data is None
    assert all(off(back[p][:, :, :3], image[:, :, :3]) <= 6 and (back[p][:, :, 3] == 255).all() for p in ("/a.jpg", "/a.JPEG"))


@pytest.mark.parametrize("size,new", [(2, 9), (9, 9), (16, 8), (100, 9), (7, 8), (1, 9)])
def test_resampling_weights(size, new):
    weights = pixels.lanczos(size, new)
    assert np.allclose(weights.sum(axis=1), 1)
    assert np.allclose(weights[::-1, ::-1], weights)  # mirrored pictures give mirrored cells
    if size == new:
        assert np.allclose(weights, np.eye(size))
    flat = np.full((size, size, 3), 99, np.uint8)
    assert pixels.gradient_hash(flat.tobytes(), size, size) == 0


def test_pictures_are_coded_together(monkeypatch):
    """Pictures of one or many sizes, with what cannot be read between them, as each one alone, in blocks."""
    several = [picture(20, 33, 4), 255 - picture(20, 33, 4), np.full((20, 33, 4), 128, np.uint8)]
    for chroma, restart in ((1, 0), (2, 2)):
        assert jpeg.encode_all(np.stack(several), 90, chroma, restart) == [jpeg.encode(x, 90, chroma, restart) for x in several]
    contents = [*map(jpeg.encode, several), None, jpeg.encode(picture(9, 9, 1)), jpeg.encode(several[0])[:200], pixels.encode_png(several[1]), jpeg.encode(several[2], 50, 2), b"no picture"]
    alone = [list(pixels.pixels_of_all([c]))[0] for c in contents]
    assert [x is None for x in alone] == [False, False, False, True, False, True, False, False, True]
    for together in (1, 3000, 1 << 19):
        monkeypatch.setattr(pixels, "TOGETHER", together)
        read = list(pixels.pixels_of_all(contents))
        assert all((a is None and b is None) or (a == b).all() for a, b in zip(read, alone, strict=True))


def test_each_picture_is_made_and_read_once(spark):
    """baked_files: one pass that encodes, one that decodes, and no join that would repeat the first."""
    plan = queries()["baked_files"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 2 and "Join" not in plan
