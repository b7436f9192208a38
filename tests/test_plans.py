from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillmark.plans.components import clear_written, components, written
from quillmark.plans.hamming import close_pairs
from quillmark.plans.ranking import ranked


def brute_roots(edges):
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return sorted(label.items())


@pytest.mark.parametrize("kind", ["random", "path", "star", "loops", "none"])
def test_components(spark, kind):
    rng = random.Random(1)
    edges = {
        "random": [(rng.randrange(120), rng.randrange(120)) for _ in range(90)],
        "path": [(i * 7 % 97, (i + 1) * 7 % 97) for i in range(96)],
        "star": [(500, i) for i in range(300)],
        "loops": [(1, 1), (2, 3), (3, 2)],
        "none": [],
    }[kind]
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == brute_roots([e for e in edges if e[0] != e[1]])


@pytest.mark.parametrize("most", [0, 1, 5, 8, 20])
def test_close_pairs_are_exact(spark, most):
    rng = random.Random(most)
    bases = [rng.getrandbits(64) for _ in range(12)]
    values = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(7))) & (2**64 - 1) for b in bases for _ in range(8)] + [0, 1, 2**64 - 1, 2**63]
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    got = close_pairs(spark.createDataFrame([(v,) for v in signed + signed[:9] + [None]], "hash long"), most)
    distinct = sorted(set(signed))
    want = [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= most]
    assert sorted(map(tuple, got.collect())) == want


def test_any_distance_beyond_64_links_all(spark):
    got = close_pairs(spark.createDataFrame([(v,) for v in (5, -1, 9)], "hash long"), 64)
    assert sorted(map(tuple, got.collect())) == [(-1, 5), (-1, 9)]


def test_ranked_is_a_global_order(spark):
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("k"), "id").repartition(7)
    got = ranked(df, F.col("k").desc(), F.col("id")).collect()
    want = sorted(((r.k, r.id) for r in got), key=lambda x: (-x[0], x[1]))
    assert [(r.k, r.id) for r in sorted(got, key=lambda r: r.rank)] == want
    assert sorted(r.rank for r in got) == list(range(1, 1001))
    assert ranked(df.limit(0), F.col("id")).count() == 0


def test_intermediate_tables_can_be_cleared(spark):
    table = written(spark.range(3), "three")
    assert table.count() == 3 and clear_written(spark) >= 1 and clear_written(spark) == 0
