"""The stored index of hashes against all pairs, and what an insertion reads."""

from __future__ import annotations

import random

import pytest

from quillmark.sources import hash_index
from quillmark.sources.hash_index import HashIndex
from quillmark.sources.versions import CommitConflict


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def made(seed: int, groups: int, size: int) -> list[int]:
    """Hashes in groups of neighbours, chains between some of them."""
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        h = rng.getrandbits(64)
        for _ in range(size):
            out.append(signed(h))
            for _ in range(rng.choice([1, 3, 8, 9])):
                h ^= 1 << rng.randrange(64)
    return out


def far(a: int, b: int) -> int:
    return ((a ^ b) & (1 << 64) - 1).bit_count()


def classes(values: list[int], most: int) -> dict[int, int]:
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if far(a, b) <= most:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {v: top(v) for v in values}


def table(spark, values):
    return spark.createDataFrame([(v,) for v in values], "phash long")


@pytest.mark.parametrize("most,n_bands", [(8, 3), (0, None)])
def test_search_equals_all_pairs(spark, tmp_path, most, n_bands):
    values = made(most, 30, 4)
    index = HashIndex.create(spark, str(tmp_path), table(spark, [*values, None, values[0]]), most, n_bands)
    asked = values[::3] + [1, None, values[0]]
    for radius in {0, most // 2, most}:
        got = sorted(map(tuple, index.within(table(spark, asked), radius).collect()))
        assert got == sorted((a, b, far(a, b)) for a in {x for x in asked if x is not None} for b in set(values) if far(a, b) <= radius)
    with pytest.raises(ValueError):
        index.within(table(spark, asked), most + 1)


@pytest.mark.parametrize("seed", range(1))
def test_classes_after_insertions(spark, tmp_path, seed):
    values = made(seed, 25, 5)
    random.Random(seed).shuffle(values)
    index = HashIndex.create(spark, str(tmp_path), table(spark, values[:60]))
    for part in (values[60:], values[:5]):
        index = index.insert(table(spark, part))
    assert {r.hash: r.root for r in index.classes().collect()} == classes(sorted(set(values)), 8)
    assert HashIndex(spark, str(tmp_path), 1).hashes().count() == len(set(values[:60]))
    with pytest.raises(CommitConflict):
        HashIndex(spark, str(tmp_path), 1).insert(table(spark, [5]))


def test_an_insertion_compares_new_hashes_only(spark, tmp_path, monkeypatch):
    values = made(7, 60, 5)
    index = HashIndex.create(spark, str(tmp_path), table(spark, values))
    new = made(8, 5, 4)
    compared, asked = [], []
    pairs, within = hash_index.close_pairs, HashIndex.within
    monkeypatch.setattr(hash_index, "close_pairs", lambda rows, most: compared.append(rows.count()) or pairs(rows, most))
    monkeypatch.setattr(HashIndex, "within", lambda self, rows, most=None: asked.append(rows.count()) or within(self, rows, most))
    after = index.insert(table(spark, [*new, *values[:50]]))
    assert compared == asked == [len(set(new))] and after.hashes().count() == len(set(values) | set(new))


def test_an_empty_index(spark, tmp_path):
    index = HashIndex.create(spark, str(tmp_path), table(spark, []))
    assert index.within(table(spark, [1])).count() == 0 and index.classes().count() == 0
    assert [tuple(r) for r in index.insert(table(spark, [3])).classes().collect()] == [(3, 3)]
    assert HashIndex(spark, str(tmp_path / "none")).within(table(spark, [1])).count() == 0
