"""JPEG pixels in numpy: sequential and progressive Huffman decoding, and baseline encoding.

Entropy-coded data is read symbol by symbol; everything else (dequantisation, cosine transforms, chroma
sampling, colours) works on all blocks of a component at once, and on all pictures of one layout: small
pictures cost hardly more than their symbols. Some twenty bytes are held for each sample of the pictures
that are given together; callers bound these. Arithmetic coding, lossless frames and samples of other than 8 bits
are not read; damaged or cut data gives None, never half a picture.
"""

from __future__ import annotations

import struct
from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np


def _zigzag() -> np.ndarray:
    """Places of an 8 x 8 block along its anti-diagonals, in turn downwards and upwards."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()
#: Rows of the orthonormal cosine transform of 8 samples.
COSINES = np.array([[np.sqrt((1 if k else 0.5) / 4) * np.cos((2 * n + 1) * k * np.pi / 16) for n in range(8)] for k in range(8)])
# Quantiser steps for quality 50 of the format's annex, in rows.
LUMA_STEPS = """
16 11 10 16 24 40 51 61
12 12 14 19 26 58 60 55
14 13 16 24 40 57 69 56
14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77
24 35 55 64 81 104 113 92
49 64 78 87 103 121 120 101
72 92 95 98 112 100 103 99
"""
CHROMA_STEPS = """
17 18 24 47 99 99 99 99
18 21 26 66 99 99 99 99
24 26 56 99 99 99 99 99
47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
"""
_EMPTY = bytes(128)
#: Zero bytes behind a scan, so that its last symbols can be read in whole words.
_PADDING = b"\0" * 16


class _Table:
    """A Huffman table by its next 16 bits: symbol and length of the code that they start with."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.symbol, self.length = bytearray(1 << 16), bytearray(1 << 16)
        code = at = 0
        for size, n in enumerate(counts, 1):
            for symbol in symbols[at : at + n]:
                first, many = code << 16 - size, 1 << 16 - size
                self.symbol[first : first + many] = bytes([symbol]) * many
                self.length[first : first + many] = bytes([size]) * many
                code += 1
            at += n
            code <<= 1


@lru_cache(64)
def _table(counts: bytes, symbols: bytes) -> _Table:
    return _Table(counts, symbols)


class _Bits:
    """Bits of one restart interval, without the zero that follows each byte 255."""

    def __init__(self, data: bytes):
        self.data, self.at = data.replace(b"\xff\0", b"\xff") + _PADDING, 0
        self.end = 8 * (len(self.data) - len(_PADDING))

    def symbol(self, table: _Table) -> int:
        at = self.at
        code = int.from_bytes(self.data[at >> 3 : (at >> 3) + 3], "big") >> 8 - (at & 7) & 0xFFFF
        size = table.length[code]
        self.at = at + size
        if not size or self.at > self.end:
            raise ValueError("no code")
        return table.symbol[code]

    def take(self, n: int) -> int:
        at = self.at
        self.at = at + n
        if self.at > self.end:
            raise ValueError("data ends")
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 4], "big") >> 32 - n - (at & 7) & (1 << n) - 1

    def signed(self, n: int) -> int:
        if not n:
            return 0
        value = self.take(n)
        return value if value >> n - 1 else value - (1 << n) + 1


class _Component:
    def __init__(self, ident: int, across: int, down: int, steps: int):
        self.ident, self.across, self.down, self.steps = ident, across, down, steps
        self.dc = self.ac = 0
        self.last = 0

    def lay(self, width: int, height: int, most_across: int, most_down: int) -> None:
        """Blocks that hold samples, and blocks as whole units of the picture have them."""
        self.columns = -(-(-(-width * self.across // most_across)) // 8)
        self.rows = -(-(-(-height * self.down // most_down)) // 8)
        units = -(-width // (8 * most_across)), -(-height // (8 * most_down))
        self.stride = units[0] * self.across
        self.blocks = [array("h", _EMPTY) for _ in range(self.stride * units[1] * self.down)]


class _Scan:
    """One pass over some components: which coefficients, and which of their bits."""

    def __init__(self, first: int, last: int, high: int, low: int, progressive: bool, dc: dict, ac: dict):
        self.first, self.last, self.high, self.low = first, last, high, low
        self.dc, self.ac, self.skip = dc, ac, 0
        if not progressive:
            self.block = self._whole
        elif not first:
            self.block = self._dc_more if high else self._dc_first
        else:
            self.block = self._ac_more if high else self._ac_first

    def _difference(self, bits: _Bits, c: _Component) -> int:
        c.last += bits.signed(bits.symbol(self.dc[c.dc]))
        return c.last

    def _whole(self, bits: _Bits, c: _Component, block: array) -> None:
        block[0] = self._difference(bits, c)
        table, k = self.ac[c.ac], 1
        while k < 64:
            symbol = bits.symbol(table)
            run, size = symbol >> 4, symbol & 15
            if size:
                k += run
                block[k] = bits.signed(size)
                k += 1
            elif run == 15:
                k += 16
            else:
                return

    def _dc_first(self, bits: _Bits, c: _Component, block: array) -> None:
        block[0] = self._difference(bits, c) << self.low

    def _dc_more(self, bits: _Bits, c: _Component, block: array) -> None:
        block[0] |= bits.take(1) << self.low

    def _ac_first(self, bits: _Bits, c: _Component, block: array) -> None:
        if self.skip:
            self.skip -= 1
            return
        table, k = self.ac[c.ac], self.first
        while k <= self.last:
            symbol = bits.symbol(table)
            run, size = symbol >> 4, symbol & 15
            if size:
                k += run
                block[k] = bits.signed(size) << self.low
                k += 1
            elif run == 15:
                k += 16
            else:
                self.skip = (1 << run) - 1 + (bits.take(run) if run else 0)
                return

    def _ac_more(self, bits: _Bits, c: _Component, block: array) -> None:
        """One more bit of the coefficients that are known, and new ones of one bit between them."""
        one, k, last = 1 << self.low, self.first, self.last

        def refine(at: int) -> None:
            if bits.take(1) and not abs(block[at]) & one:
                block[at] += one if block[at] > 0 else -one

        if not self.skip:
            table = self.ac[c.ac]
            while k <= last:
                symbol = bits.symbol(table)
                run, size = symbol >> 4, symbol & 15
                value = 0
                if size:
                    value = one if bits.take(1) else -one
                elif run < 15:
                    self.skip = (1 << run) + (bits.take(run) if run else 0)
                    break
                while k <= last:
                    if block[k]:
                        refine(k)
                    elif run:
                        run -= 1
                    else:
                        break
                    k += 1
                if value:
                    block[k] = value
                k += 1
        if self.skip:
            for at in range(k, last + 1):
                if block[at]:
                    refine(at)
            self.skip -= 1

    def run(self, intervals: list[bytes], chosen: list[_Component], units: tuple[int, int], interval: int) -> None:
        """Units in the order of the scan: of one component its own blocks, of several the blocks of each."""
        if len(chosen) == 1:
            c = chosen[0]
            order = [[(c, y * c.stride + x)] for y in range(c.rows) for x in range(c.columns)]
        else:
            order = [[(c, (y * c.down + v) * c.stride + x * c.across + u) for c in chosen for v in range(c.down) for u in range(c.across)] for y in range(units[1]) for x in range(units[0])]
        step = interval or len(order)
        if len(intervals) * step < len(order):
            raise ValueError("data ends")
        for i, at in enumerate(range(0, len(order), step)):
            bits, self.skip = _Bits(intervals[i]), 0
            for c in chosen:
                c.last = 0
            for unit in order[at : at + step]:
                for c, place in unit:
                    self.block(bits, c, c.blocks[place])


def _entropy(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The restart intervals of a scan that starts here, and where the next marker is."""
    found, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise ValueError("data ends")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker == 0:
            at += 2
        else:
            found.append(data[start:at])
            if not 0xD0 <= marker <= 0xD7:
                return found, at
            at = start = at + 2


def _upsampled(plane: np.ndarray, across: int, down: int) -> np.ndarray:
    """Each sample stretched; of two for one, three quarters come from the nearer sample."""
    for axis, times in ((plane.ndim - 1, across), (plane.ndim - 2, down)):
        if times == 2:
            first, last = (np.take(plane, [i], axis) for i in (0, -1))
            before, after = np.concatenate([first, np.delete(plane, -1, axis)], axis), np.concatenate([np.delete(plane, 0, axis), last], axis)
            both = np.stack([(3 * plane + before) / 4, (3 * plane + after) / 4], axis + 1)
            shape = list(plane.shape)
            shape[axis] *= 2
            plane = both.reshape(shape)
        elif times > 1:
            plane = np.repeat(plane, times, axis)
    return plane


def _coloured(planes: list[np.ndarray], transform: int | None) -> np.ndarray:
    """Grey or RGB samples of the components; inks are subtracted from white."""
    if len(planes) == 1:
        return planes[0][..., None]
    rgb = np.stack(planes[:3], axis=-1)
    if transform if transform is not None else len(planes) == 3:
        y, b, r = rgb[..., 0], rgb[..., 1] - 128, rgb[..., 2] - 128
        rgb = np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], axis=-1)
    if len(planes) == 4:  # inks are stored inverted
        rgb = np.clip(rgb, 0, 255) * planes[3][..., None] / 255
    return rgb


def decode(data: bytes) -> np.ndarray | None:
    """height x width x (1 or 3) samples of a JPEG; None if it cannot be read."""
    read = parsed(data)
    return None if read is None else images([read])[0]


@dataclass
class Parsed:
    """Coefficients of a picture, by component, with their steps; pictures of one layout are alike but for these."""

    layout: tuple
    levels: list[bytes]
    steps: list[np.ndarray]

    @property
    def samples(self) -> int:
        return sum(map(len, self.levels)) // 2


def parsed(data: bytes) -> Parsed | None:
    """What a JPEG's entropy-coded data holds; None if it cannot be read."""
    try:
        return _parsed(data)
    except (ValueError, IndexError, KeyError, OverflowError, StopIteration, struct.error):
        return None


def _parsed(data: bytes) -> Parsed | None:
    if data[:2] != b"\xff\xd8":
        return None
    steps: dict[int, np.ndarray] = {}
    dc: dict[int, _Table] = {}
    ac: dict[int, _Table] = {}
    components: list[_Component] = []
    at, interval, transform, scans = 2, 0, None, 0
    while True:
        while data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xD9:
            break
        (size,) = struct.unpack_from(">H", data, at + 2)
        part, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while part:
                wide = part[0] >> 4
                steps[part[0] & 15] = np.frombuffer(part, ">u2" if wide else ">u1", 64, 1).astype(np.float64)
                part = part[65 + 64 * wide :]
        elif marker == 0xC4:
            while part:
                n = sum(part[1:17])
                (ac if part[0] >> 4 else dc)[part[0] & 15] = _table(part[1:17], part[17 : 17 + n])
                part = part[17 + n :]
        elif marker == 0xDD:
            (interval,) = struct.unpack_from(">H", part)
        elif marker == 0xEE and part[:5] == b"Adobe":
            transform = part[11]
        elif marker in (0xC0, 0xC1, 0xC2):
            progressive = marker == 0xC2
            depth, height, width, n = struct.unpack_from(">BHHB", part)
            if depth != 8 or not width or not height or n not in (1, 3, 4) or components:
                return None
            components = [_Component(part[6 + 3 * i], part[7 + 3 * i] >> 4, part[7 + 3 * i] & 15, part[8 + 3 * i]) for i in range(n)]
            if n == 1:
                components[0].across = components[0].down = 1
            most = max(c.across for c in components), max(c.down for c in components)
            if any(not c.across or not c.down or most[0] % c.across or most[1] % c.down for c in components):
                return None
            for c in components:
                c.lay(width, height, *most)
            units = -(-width // (8 * most[0])), -(-height // (8 * most[1]))
        elif 0xC3 <= marker <= 0xCF and marker != 0xC8:
            return None
        elif marker == 0xDA:
            chosen = []
            for i in range(part[0]):
                c = next(c for c in components if c.ident == part[1 + 2 * i])
                c.dc, c.ac = part[2 + 2 * i] >> 4, part[2 + 2 * i] & 15
                chosen.append(c)
            first, last, bit = part[1 + 2 * part[0] : 4 + 2 * part[0]]
            intervals, at = _entropy(data, at)
            _Scan(first, last, bit >> 4, bit & 15, progressive, dc, ac).run(intervals, chosen, units, interval)
            scans += 1
    if not scans:
        return None
    shape = tuple((most[0] // c.across, most[1] // c.down, c.columns, c.rows, c.stride) for c in components)
    return Parsed((height, width, transform, shape), [b"".join(c.blocks) for c in components], [steps[c.steps] for c in components])


def images(pictures: list[Parsed]) -> list[np.ndarray]:
    """Samples of parsed pictures; those of one layout are transformed together."""
    groups: dict[tuple, list[int]] = {}
    for i, picture in enumerate(pictures):
        groups.setdefault(picture.layout, []).append(i)
    out: list = [None] * len(pictures)
    for (height, width, transform, shape), members in groups.items():
        n, planes = len(members), []
        for k, (across, down, columns, rows, stride) in enumerate(shape):
            raw = np.frombuffer(b"".join(pictures[i].levels[k] for i in members), np.int16).reshape(n, -1, 64) * np.stack([pictures[i].steps[k] for i in members])[:, None]
            square = np.empty_like(raw)
            square[:, :, ZIGZAG] = raw
            samples = COSINES.T @ square.reshape(-1, 8, 8) @ COSINES + 128
            plane = samples.reshape(n, -1, stride, 8, 8).swapaxes(2, 3).reshape(n, -1, 8 * stride)[:, : 8 * rows, : 8 * columns]
            planes.append(_upsampled(np.clip(np.rint(plane), 0, 255), across, down)[:, :height, :width])
        found = np.clip(np.rint(_coloured(planes, transform)), 0, 255).astype(np.uint8)
        for i, image in zip(members, found, strict=True):
            out[i] = image
    return out


# --- encoding ------------------------------------------------------------------------------


def quantiser(steps: str, quality: int) -> np.ndarray:
    """Steps of a quality from 1 to 100, by the usual scale."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(steps.split(), int) * scale + 50) // 100, 1, 255)


def _lengths(counts: dict[int, int]) -> dict[int, int]:
    """Lengths of Huffman codes, of 16 bits at most; the code of ones only stays free."""
    groups = sorted((n, [s]) for s, n in counts.items()) + [(0, [256])]
    length = dict.fromkeys([*counts, 256], 0)
    while len(groups) > 1:
        groups.sort(key=lambda g: (-g[0], len(g[1])))
        (a, one), (b, two) = groups.pop(), groups.pop()
        for s in one + two:
            length[s] += 1
        groups.append((a + b, one + two))
    used = [0] * (max(length.values()) + 1)
    for n in length.values():
        used[n] += 1
    for n in range(len(used) - 1, 16, -1):
        while used[n]:
            # Two of the longest become one shorter, and a code further up is split for the other.
            up = next(k for k in range(n - 2, 0, -1) if used[k])
            used[n] -= 2
            used[n - 1] += 1
            used[up + 1] += 2
            used[up] -= 1
    by_use = sorted(counts, key=lambda s: (length[s], s))
    sizes = [n for n, many in enumerate(used) for _ in range(many)][: len(by_use)]
    return dict(zip(by_use, sizes, strict=True))


@lru_cache(256)
def _codes_of(counts: tuple[tuple[int, int], ...]) -> tuple[bytes, np.ndarray, np.ndarray]:
    return _codes(dict(counts))


def _codes(counts: dict[int, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The table's segment body, and code and length by symbol."""
    lengths = _lengths(counts)
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, size, of, sizes = 0, 0, np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for s in order:
        code <<= lengths[s] - size
        size = lengths[s]
        of[s], sizes[s] = code, size
        code += 1
    return bytes(sum(n == k for n in lengths.values()) for k in range(1, 17)) + bytes(order), of, sizes


def _sizes(values: np.ndarray) -> np.ndarray:
    """Bits of the magnitudes."""
    return np.ceil(np.log2(np.abs(values) + 1)).astype(np.int64)


def _symbols(blocks: np.ndarray) -> tuple[np.ndarray, ...]:
    """(block, order, symbol, value) of the alternating coefficients in zigzag order, with ends and long gaps."""
    block, place = np.nonzero(blocks[:, 1:])
    place = place + 1
    start = np.r_[True, block[1:] != block[:-1]] if len(block) else np.zeros(0, bool)
    gap = place - np.where(start, 0, np.r_[0, place[:-1]]) - 1
    value = blocks[block, place]
    long = gap // 16
    extra = np.repeat(np.arange(len(block)), long)
    last = np.zeros(len(blocks), np.int64)
    np.maximum.at(last, block, place)
    ends = np.flatnonzero(last < 63)
    parts = [
        (block, place * 4 + 2, gap % 16 * 16 + _sizes(value), value),
        (block[extra], place[extra] * 4 + 1, np.full(len(extra), 0xF0), np.zeros(len(extra), np.int64)),
        (ends, np.full(len(ends), 64 * 4), np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)),
    ]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode(image: np.ndarray, quality: int = 90, chroma: int = 1, restart: int = 0) -> bytes:
    """A baseline JPEG of height x width x 1, 3 or 4 samples; the fourth, alpha, is dropped.

    chroma: columns and rows that share a sample of colour difference (1 or 2). restart: units between
    restart markers, 0 for none. Huffman tables are made for the picture.
    """
    return encode_all(image[None], quality, chroma, restart)[0]


def encode_all(images: np.ndarray, quality: int = 90, chroma: int = 1, restart: int = 0) -> list[bytes]:
    """The JPEG of each of n pictures of one size (n x height x width x samples), as encode makes it."""
    n, height, width, depth = images.shape
    rgb = images[..., : 1 if depth < 3 else 3].astype(np.float64)
    planes = [rgb[..., 0]]
    if depth >= 3:
        r, g, b = np.moveaxis(rgb, 3, 0)
        y = 0.299 * r + 0.587 * g + 0.114 * b
        planes = [y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128]
    unit = 8 * chroma if depth >= 3 else 8
    units = -(-width // unit), -(-height // unit)
    tables = [quantiser(LUMA_STEPS, quality), quantiser(CHROMA_STEPS, quality)]
    found, factors = [], []
    for i, plane in enumerate(planes):
        full = np.pad(plane, ((0, 0), (0, units[1] * unit - height), (0, units[0] * unit - width)), "edge")
        if i and chroma > 1:
            full = full.reshape(n, full.shape[1] // chroma, chroma, -1, chroma).mean(axis=(2, 4))
        factor = chroma if not i and depth >= 3 else 1
        blocks = full.reshape(n, units[1], factor, 8, units[0], factor, 8).transpose(0, 1, 4, 2, 5, 3, 6).reshape(-1, 8, 8) - 128
        levels = np.rint((COSINES @ blocks @ COSINES.T).reshape(-1, 64) / tables[min(i, 1)]).astype(np.int64)[:, ZIGZAG]
        found.append(levels)
        factors.append(factor)
    each = [f * f for f in factors]
    starts = np.concatenate([[0], np.cumsum(each)])
    all_units = units[0] * units[1]
    rows = []
    for i, levels in enumerate(found):
        number = np.arange(len(levels))
        of_unit = number // each[i]  # units are numbered through the pictures
        place = of_unit * starts[-1] + starts[i] + number % each[i]  # the block's place in the scans
        # Differences start anew with a picture and behind a restart marker.
        parted = of_unit // all_units * (all_units + 1) + (of_unit % all_units // restart if restart else 0)
        first = np.ones(len(levels), bool)
        first[1:] = parted[1:] != parted[:-1]
        difference = levels[:, 0].copy()
        difference[1:] -= np.where(first[1:], 0, levels[:-1, 0])
        block, order, symbol, value = _symbols(levels)
        zeros = np.zeros(len(levels), np.int64)
        rows.append([np.concatenate(x) for x in ((place, place[block]), (zeros, order), (_sizes(difference), symbol), (difference, value), (zeros + 2 * min(i, 1), np.full(len(block), 2 * min(i, 1) + 1)))])
    place, order, symbol, value, which = (np.concatenate(x) for x in zip(*rows, strict=True))
    sort = np.lexsort((order, place))
    place, symbol, value, which = (x[sort] for x in (place, symbol, value, which))
    picture = place // (starts[-1] * all_units)
    n_tables = 2 * min(len(planes), 2)
    table = picture * n_tables + which
    seen, many = np.unique(table * 256 + symbol, return_counts=True)
    cuts = np.searchsorted(seen, np.arange(n * n_tables + 1) * 256).tolist()
    pairs = list(zip((seen % 256).tolist(), many.tolist(), strict=True))
    made = [_codes_of(tuple(pairs[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    code, length = np.stack([m[1] for m in made])[table, symbol], np.stack([m[2] for m in made])[table, symbol]
    more = _sizes(value)
    bits = np.where(value < 0, value + (1 << more) - 1, value).astype(np.uint64)
    code, length = code << more.astype(np.uint64) | bits, length + more
    steps = b"".join(_segment(0xDB, bytes([t]) + tables[t][ZIGZAG].astype(np.uint8).tobytes()) for t in range(min(len(planes), 2)))
    shape = b"".join(bytes([i + 1, 17 * f, min(i, 1)]) for i, f in enumerate(factors))
    before = b"\xff\xd8" + steps + _segment(0xC0, struct.pack(">BHHB", 8, height, width, len(planes)) + shape)
    after = _segment(0xDD, struct.pack(">H", restart)) if restart else b""
    after += _segment(0xDA, bytes([len(planes)]) + b"".join(bytes([i + 1, 17 * min(i, 1)]) for i in range(len(planes))) + b"\0\x3f\0")
    # Each picture's scan, cut into its restart intervals.
    intervals = -(-all_units // restart) if restart else 1
    interval = picture * intervals + (place // starts[-1] % all_units // restart if restart else 0)
    packed = _packed(code, length, np.searchsorted(interval, np.arange(1, n * intervals)))
    out = []
    for p in range(n):
        head = b"".join(_segment(0xC4, bytes([16 * (k % 2) + k // 2]) + made[p * n_tables + k][0]) for k in range(n_tables))
        scan = b"".join((bytes([0xFF, 0xD0 + (i - 1) % 8]) if i else b"") + part for i, part in enumerate(packed[p * intervals : (p + 1) * intervals]))
        out.append(before + head + after + scan + b"\xff\xd9")
    return out


def _packed(code: np.ndarray, length: np.ndarray, cuts: np.ndarray | tuple = ()) -> list[bytes]:
    """Codes one behind the other, cut before some, each part filled up with ones, and a zero behind each byte 255."""
    out = []
    for at in range(0, len(code), 1 << 16):
        wide = code[at : at + (1 << 16)].astype(">u4").view(np.uint8).reshape(-1, 4)
        held = np.arange(32)[None, :] >= 32 - length[at : at + (1 << 16), None]
        out.append(np.unpackbits(wide, axis=1)[held])
    bits = np.concatenate(out)
    ends = np.concatenate([[0], np.cumsum(length)])
    ends = ends[np.concatenate([[0], np.asarray(cuts, np.int64), [len(length)]])].tolist()
    ones = np.ones(8, np.uint8)
    return [np.packbits(np.concatenate([bits[a:b], ones[: (a - b) % 8]])).tobytes().replace(b"\xff", b"\xff\0") for a, b in zip(ends[:-1], ends[1:], strict=True)]
