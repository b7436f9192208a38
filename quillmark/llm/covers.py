"""Suffixes of many short strings, sorted bucket by bucket with a difference cover.

A difference cover of period v is a set D of residues such that any two residues have a common shift
into D: for suffixes i and j there is a shift below v that takes both to sampled positions. The order
of strings of ``length`` bytes that start at i and j is then told by their first v bytes, the ranks of
the samples that the shift leads to, and the few bytes that these ranks do not reach. Ranks are places
in the sorted list of the sampled strings, made once for a block by doubling; so a tie over hundreds of
bytes costs one look-up, and memory is a few words for each byte of the block, however long ties are.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np

MAX_PERIOD = 64


def period(length: int) -> int:
    """A power of two that leaves most of a string to the samples' ranks."""
    return min(MAX_PERIOD, 1 << max(0, (length // 4).bit_length() - 1))


@cache
def cover(v: int) -> tuple[int, ...]:
    """Residues 0..r-1 and the multiples of r, r about the root of v: every difference is q r - s."""
    r = math.isqrt(v - 1) + 1
    return tuple(sorted({*range(r), *range(0, v, r)} & set(range(v))))


@cache
def shifts(v: int) -> np.ndarray:
    """shifts[a, b]: the least shift that takes residues a and b into the cover."""
    inside = np.zeros(2 * v, bool)
    inside[[c + k for c in cover(v) for k in (0, v)]] = True
    steps = np.array([[inside[a + d] for d in range(v)] for a in range(v)])
    both = steps[:, None, :] & steps[None, :, :]
    assert both.any(axis=2).all()
    return both.argmax(axis=2)


def words_of(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position on as one number whose order is that of the bytes."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out |= padded[k : k + len(text)].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def _first(words: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """Keys, most significant first, that order the ``width`` bytes (a power of two) from positions at on."""
    if width < 8:
        return [words[at] >> np.uint64(64 - 8 * width)]
    return [words[at + k] for k in range(0, width, 8)]


def _dense(keys: list[np.ndarray]) -> np.ndarray:
    """Places (from 1, ties equal) in the order of the keys."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), np.int64)
    new[1:] = 0
    for k in keys:
        sorted_k = k[order]
        new[1:] |= sorted_k[1:] != sorted_k[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def sample_ranks(words: np.ndarray, v: int, times: int) -> np.ndarray:
    """For each position, the rank of the v * times bytes from it on among sampled positions; 0 elsewhere."""
    n = len(words)
    sampled = np.zeros(n, bool)
    for c in cover(v):
        sampled[c::v] = True
    at = np.flatnonzero(sampled[: max(0, n - v)])

    def spread(ranks: np.ndarray, beyond: int) -> np.ndarray:
        out = np.zeros(n + beyond, np.int64)
        out[at] = ranks
        return out

    power, width = _dense(_first(words, at, v)) if len(at) else np.zeros(0, np.int64), v
    found, done, left = None, 0, times
    while True:
        if left & 1:
            if found is None:
                found = power
            else:
                # What is known of the first ``done`` bytes, then of the ``width`` that follow.
                found = _dense([found, spread(power, done)[at + done]])
            done += width
        left >>= 1
        if not left:
            return spread(found, 0)
        power = _dense([power, spread(power, width)[at + width]])
        width *= 2


def sorted_suffixes(text: np.ndarray, start: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings of ``length`` bytes from positions ``start`` on, in order inside each group.

    Returns indices into start, and for each place whether its string equals the one before it in the
    group. Groups come in ascending order. Every string must end inside the text.
    """
    v = period(length)
    times = max(1, (length - v + 1) // v)
    reach = v * times
    words = words_of(np.concatenate([text, np.zeros(length + v, np.uint8)]))
    ranks = sample_ranks(words, v, times)
    step = shifts(v)
    order = np.lexsort([*_first(words, start, v)[::-1], group])
    same = np.zeros(len(order), bool)
    if not len(order):
        return order, same
    keys = [group, *_first(words, start, v)]
    for k in keys:
        k = k[order]
        same[1:] |= k[1:] != k[:-1]
    same[1:] = ~same[1:]
    same[0] = False
    # Runs that tie in their first v bytes are parted by a middle element until all of a run are equal.
    place = np.flatnonzero(same | np.append(same[1:], False))
    run = np.cumsum(~same[place])
    while len(place):
        head = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        size = np.diff(np.append(head, len(run)))
        number = np.repeat(np.arange(len(head)), size)
        i = start[order[place]]
        j = i[(head + size // 2)[number]]
        shift = step[i % v, j % v]
        sign = np.sign(ranks[i + shift] - ranks[j + shift])
        for done in range(0, length - reach, 8):
            tie = np.flatnonzero(sign == 0)
            tie = tie[shift[tie] + reach + done < length]
            if not len(tie):
                break
            at = np.minimum(shift[tie] + reach + done, length - 8)
            a, b = words[i[tie] + at], words[j[tie] + at]
            sign[tie] = (a > b).astype(np.int64) - (a < b)
        moved = np.argsort(3 * number + sign + 1, kind="stable")
        order[place] = order[place[moved]]
        part = (3 * number + sign + 1)[moved]
        fresh = np.append(True, part[1:] != part[:-1])
        same[place[fresh]] = False
        # Equal ones are in place, and so is what stands alone.
        count = np.bincount(np.cumsum(fresh) - 1)[np.cumsum(fresh) - 1]
        more = (sign[moved] != 0) & (count > 1)
        place, run = place[more], part[more]
    return order, same


def tied(texts: list[bytes], low: np.ndarray, high: np.ndarray, bucket: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, distance) of strings that another text of the bucket has at the same distance.

    Text t holds the strings of ``length`` bytes at distances high[t] down to low[t], one byte apart.
    """
    counts = high - low + 1
    sizes = np.array([len(t) for t in texts], np.int64)
    number = np.repeat(np.arange(len(texts)), counts)
    local = np.arange(len(number)) - np.repeat(np.cumsum(counts) - counts, counts)
    distance = high[number] - local
    start = (np.cumsum(sizes) - sizes)[number] + local
    # Only strings of one bucket and distance can tie; what is alone there needs no place in an order.
    widest = int(high.max(initial=0)) + 1
    _, group, alike = np.unique(bucket[number] * widest + distance, return_inverse=True, return_counts=True)
    several = alike[group] > 1
    number, distance, start, group = number[several], distance[several], start[several], group[several]
    order, same = sorted_suffixes(np.frombuffer(b"".join(texts), np.uint8), start, group, length)
    hit = order[same | np.append(same[1:], False)] if len(order) else order
    return number[hit], distance[hit]
