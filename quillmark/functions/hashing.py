"""Content hashes. BLAKE3 follows its published specification, vectorised over chunks in numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the BLAKE3 specification.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
COLUMNS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15))
DIAGONALS = ((0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK = 1024, 64


def _compress(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """n chaining values (8 x n) from n blocks (16 x n)."""
    n = words.shape[1]
    v = np.empty((16, n), np.uint32)
    v[:8] = cv
    v[8:12] = np.array(IV[:4], np.uint32)[:, None]
    v[12], v[13] = (counter & np.uint64(0xFFFFFFFF)).astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32)
    v[14], v[15] = size, flags
    m = words

    def turn(x: np.ndarray, by: int) -> np.ndarray:
        return (x >> np.uint32(by)) | (x << np.uint32(32 - by))

    for _ in range(7):
        for i, (a, b, c, d) in enumerate((*COLUMNS, *DIAGONALS)):
            v[a] += v[b] + m[2 * i]
            v[d] = turn(v[d] ^ v[a], 16)
            v[c] += v[d]
            v[b] = turn(v[b] ^ v[c], 12)
            v[a] += v[b] + m[2 * i + 1]
            v[d] = turn(v[d] ^ v[a], 8)
            v[c] += v[d]
            v[b] = turn(v[b] ^ v[c], 7)
        m = m[list(PERMUTATION)]
    return v[:8] ^ v[8:]


def _subtree(data: bytes, first: int = 0, root: bool = True) -> np.ndarray:
    """Chaining value (8) of the tree over data, whose first chunk has the number first."""
    chunks = max(1, -(-len(data) // CHUNK))
    words = np.frombuffer(data.ljust(chunks * CHUNK, b"\0"), "<u4").reshape(chunks, 16, 16).transpose(1, 2, 0)
    last = len(data) - (chunks - 1) * CHUNK
    sizes = np.full(chunks, CHUNK)
    sizes[-1] = last
    blocks = np.maximum(1, -(-sizes // BLOCK))
    cv = np.repeat(np.array(IV, np.uint32)[:, None], chunks, axis=1)
    number = np.arange(first, first + chunks, dtype=np.uint64)
    for i in range(int(blocks.max())):
        live = np.flatnonzero(blocks > i)
        size = np.minimum(BLOCK, sizes[live] - i * BLOCK).astype(np.uint32)
        flags = np.where(i == 0, CHUNK_START, 0) | np.where(blocks[live] == i + 1, CHUNK_END | (ROOT if root and chunks == 1 else 0), 0)
        cv[:, live] = _compress(cv[:, live], words[i][:, live], number[live], size, flags.astype(np.uint32))
    while cv.shape[1] > 1:
        # Pairs of neighbours; an odd last one moves up: the left subtree is the largest power of two.
        pairs = cv.shape[1] // 2
        up = _parents(cv[:, 0 : 2 * pairs : 2], cv[:, 1 : 2 * pairs : 2], root and cv.shape[1] == 2)
        cv = np.concatenate([up, cv[:, 2 * pairs :]], axis=1)
    return cv[:, 0]


def _parents(left: np.ndarray, right: np.ndarray, root: bool) -> np.ndarray:
    """Chaining values (8 x n) of n parents."""
    n = left.shape[1]
    start = np.repeat(np.array(IV, np.uint32)[:, None], n, axis=1)
    flags = np.full(n, PARENT | (ROOT if root else 0), np.uint32)
    return _compress(start, np.concatenate([left, right]), np.zeros(n, np.uint64), np.full(n, BLOCK, np.uint32), flags)


def _hex(cv: np.ndarray) -> str:
    return cv.astype("<u4").tobytes().hex()


def blake3(data: bytes) -> str:
    """64 hex digits."""
    return _hex(_subtree(data))


#: Chunks that blake3_stream hashes at once, a power of two: it holds so many KiB of a file.
GROUP = 1024


def blake3_stream(file, group: int = GROUP) -> str:
    """blake3 of a binary file object, a group of chunks at a time.

    Complete groups are complete subtrees; those of equal size are merged as soon as both are known, so
    that a stack of about log2 of the groups is all that is kept.
    """
    size = group * CHUNK
    data, done, stack = file.read(size), 0, []
    while len(data) == size and (following := file.read(size)):
        cv, done = _subtree(data, done * group, False), done + 1
        merged = done
        while merged % 2 == 0:
            cv, merged = _parents(stack.pop()[:, None], cv[:, None], False)[:, 0], merged // 2
        stack.append(cv)
        data = following
    cv = _subtree(data, done * group, not stack)
    while stack:
        left = stack.pop()
        cv = _parents(left[:, None], cv[:, None], not stack)[:, 0]
    return _hex(cv)


def content_hash(content: Column, method: str = "blake3") -> Column:
    """Hex digest of a BINARY column: blake3, or a function that Spark has itself."""
    if method == "md5":
        return F.md5(content)
    if method == "sha256":
        return F.sha2(content, 256)

    @F.pandas_udf("string")
    def hashed(parts: pd.Series) -> pd.Series:
        return parts.map(lambda b: None if b is None else blake3(bytes(b)))

    return hashed(content)


def hash_file(path: str, method: str = "blake3") -> str:
    """Of a file that this machine sees, read in parts of bounded size."""
    with open(path, "rb") as file:
        if method == "blake3":
            return blake3_stream(file)
        return hashlib.file_digest(file, method).hexdigest()
