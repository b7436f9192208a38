"""Difference covers, sorted suffixes, and op10 with large buckets, hot keys and long texts."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quillmark.llm import covers, suffixdedup

from .test_suffixdedup import SCHEMA, brute, made


@pytest.mark.parametrize("v", [1, 2, 4, 8, 16, 32, 64])
def test_any_two_residues_have_a_common_shift(v):
    step = covers.shifts(v)
    for a in range(v):
        for b in range(v):
            assert (a + step[a, b]) % v in covers.cover(v) and (b + step[a, b]) % v in covers.cover(v)
    assert len(covers.cover(v)) <= 2 * v**0.5 + 1


@pytest.mark.parametrize("length", [1, 2, 3, 5, 8, 9, 12, 16, 31, 40, 64, 100, 400])
@pytest.mark.parametrize("letters", ["ab", "a", "abcdefgh"])
def test_sorted_as_by_comparison(length, letters):
    rng = random.Random(length)
    base = "".join(rng.choice(letters) for _ in range(200))
    text = "".join(base[rng.randrange(200) :][: rng.randrange(1, 200)] for _ in range(20)).encode() * (2 if length > 100 else 1)
    text = text if len(text) > length else text * (length // len(text) + 2)
    start = np.array([i for i in range(len(text) - length + 1) if rng.random() < 0.8] or [0], np.int64)
    group = np.array([rng.randrange(3) for _ in start], np.int64)
    order, same = covers.sorted_suffixes(np.frombuffer(text, np.uint8), start, group, length)
    got = [(group[k], text[start[k] : start[k] + length]) for k in order]
    assert sorted(order.tolist()) == list(range(len(start))) and got == sorted(got)
    assert same.tolist() == [False] + [a == b for a, b in zip(got, got[1:])]


def test_ranks_are_places_of_sampled_strings():
    rng = random.Random(4)
    text = bytes(rng.choice(b"ab") for _ in range(3000))
    v, times = 16, 5
    ranks = covers.sample_ranks(covers.words_of(np.frombuffer(text, np.uint8)), v, times)
    at = [i for i in range(len(text) - v * times) if i % v in covers.cover(v)]
    strings = sorted({text[i : i + v * times] for i in at})
    by_rank = {s: ranks[i] for i in at for s in [text[i : i + v * times]]}
    assert all(ranks[i] == by_rank[text[i : i + v * times]] for i in at)
    assert [by_rank[s] for s in strings] == sorted(by_rank.values())


@pytest.mark.parametrize("bucket,hot", [(1, 1000), (3, 1000), (4096, 3), (2, 2)])
def test_large_buckets_and_hot_keys_give_the_same(spark, monkeypatch, bucket, hot):
    monkeypatch.setattr(suffixdedup, "BUCKET", bucket)
    monkeypatch.setattr(suffixdedup, "HOT_ROWS", hot)
    rows = made(7, 60, 40, "abcdefé ")
    rows += [rows[3], (3, rows[4][1], "same id", 1), (None, rows[6][1], None, None), (80, "z" * 200, "run", 0), (83, "pq" * 80, "self", 0)]
    got = suffixdedup.dedup_substrings(spark.createDataFrame(rows, SCHEMA), 40, 8, digest=True)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 40)


def test_long_texts(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    story = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = story(20_000)
    rows = [(1, long, "", 0), (2, story(4000) + long[30_000:31_000] + story(4000), "", 0), (3, long[:50_000] + "!" + long[50_000:], "", 0), (4, story(15_000), "", 0)]
    rows += [(5, "ab" * 50_000, "", 0), (6, "x" + "ab" * 300, "", 0)]
    got = suffixdedup.dedup_substrings(spark.createDataFrame(rows, SCHEMA), digest=True)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 400)


def test_strings_that_fool_a_rolling_hash(spark):
    """Thue and Morse's sequence and its complement collide under polynomials modulo 2**64."""
    bits = [0]
    while len(bits) < 1024:
        bits += [1 - b for b in bits]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    rng = random.Random(1)
    ends = ["".join(rng.choice("cdefgh") for _ in range(500)) for _ in range(4)]
    rows = [(1, ends[0] + one + ends[1], "", 0), (2, ends[2] + two + ends[3], "", 0)]
    got = suffixdedup.dedup_substrings(spark.createDataFrame(rows, SCHEMA), digest=True)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 400)
