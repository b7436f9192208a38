from __future__ import annotations

from collections import Counter, defaultdict
from fractions import Fraction

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.llm import pfair

SCHEMA = "doc_id long, text string, source string, mix_slot string, row int"


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(max_size=3), st.floats(0.001, 100), min_size=1, max_size=12), st.integers(1, 60))
def test_every_prefix_is_within_one_block(weights, frame):
    slots = pfair.shares(weights, frame)
    size = sum(slots.values())
    assert set(slots) == set(weights) and min(slots.values()) >= 1
    run = Counter()
    for t, s in enumerate(pfair.frame_schedule(slots), 1):
        run[s] += 1
        assert all(abs(run[x] - m * t / size) < 1 for x, m in slots.items())
    assert run == Counter(slots)


def hash64(doc_id, text):
    import struct

    seed = 42
    if doc_id is not None:
        seed = xxhash.xxh64(struct.pack("<q", doc_id), seed=seed).intdigest()
    if text is not None:
        seed = xxhash.xxh64(text.encode(), seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def brute(rows, weights, block, frame):
    groups = defaultdict(list)
    for d, t, s, *_ in rows:
        groups[s].append((hash64(d, t), d is not None, d or 0, t is not None, t or "", d))
    mean = sum(weights.values()) / len(weights) if weights else 0
    target = {s: weights.get(s, mean) if weights else len(g) ** 0.5 for s, g in groups.items()}
    slots = pfair.shares(target, frame)
    order = pfair.frame_schedule(slots)
    at = {s: [i for i, x in enumerate(order) if x == s] for s in slots}
    out = []
    for s, group in groups.items():
        for rank, g in enumerate(sorted(group)):
            b = rank // block
            out.append((g[5], s, b // slots[s] * len(order) + at[s][b % slots[s]], rank % block))
    return sorted(out, key=repr)


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0}])
def test_matches_brute_force(spark, weights):
    rows = [(i, f"text {i}", "a" if i % 3 else "b" if i % 2 else "c", "clash", i) for i in range(700)]
    rows += [(5000 + i, None, None, None, None) for i in range(9)] + [(None, "x", "a", "", 0), rows[4], rows[4], rows[5]]
    got = pfair.mix(spark.createDataFrame(rows, SCHEMA), weights, 4, 30)
    assert got.columns == ["doc_id", "text", "source", "row", "mix_slot", "mix_place"]
    assert sorted(((r.doc_id, r.source, r.mix_slot, r.mix_place) for r in got.collect()), key=repr) == brute(rows, weights, 4, 30)


def test_mixed_order_keeps_rows_and_deviation(spark, tmp_path):
    rows = [(i, f"text {i}", "abc"[min(2, i % 4)], "", i) for i in range(2000)]
    docs = spark.createDataFrame(rows, SCHEMA).drop("mix_slot")
    pfair.mixed_order(docs, {"a": 1.0, "b": 1.0, "c": 2.0}, 4).write.parquet(str(tmp_path / "out"))
    got = [r for f in sorted((tmp_path / "out").glob("part-*")) for r in spark.read.parquet(str(f)).collect()]
    assert sorted(r.doc_id for r in got) == list(range(2000))
    run = Counter()
    for t, r in enumerate(got[:1600], 1):
        run[r.source] += 1
        assert all(abs(run[s] - w * t) < 8 for s, w in (("a", 0.25), ("b", 0.25), ("c", 0.5)))


def test_empty_table(spark):
    assert pfair.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def in_windows(target, placed):
    """Whether every block stands between its release and its deadline, by the exact target weights."""
    whole = sum(map(Fraction, target.values()))
    weight = {s: Fraction(w) / whole for s, w in target.items()}
    return all(k // weight[s] <= slot < -(-(k + 1) // weight[s]) for s, k, slot in placed)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text(max_size=3), st.tuples(st.floats(0.0001, 100), st.integers(0, 300)), min_size=1, max_size=12))
def test_exact_schedule_keeps_every_window(given_sources):
    target, blocks = ({s: x[i] for s, x in given_sources.items()} for i in (0, 1))
    placed = list(pfair.exact_schedule(target, blocks))
    assert Counter(s for s, _, _ in placed) == Counter({s: n for s, n in blocks.items() if n})
    assert len({slot for *_, slot in placed}) == len(placed) and in_windows(target, placed)


@pytest.mark.parametrize("target", [{"big": 100_000**0.5} | {f"s{i}": 300**0.5 for i in range(20)}, {"big": 0.9} | {f"s{i}": 0.0005 for i in range(200)}, {"a": 0.9995, "b": 0.0005}])
def test_deviation_from_target_weights_over_many_frames(target):
    slots = 30_000
    whole = sum(map(Fraction, target.values()))
    # So many blocks that no source runs out before the end.
    placed = list(pfair.exact_schedule(target, {s: int(Fraction(w) / whole * slots) + 2 for s, w in target.items()}))
    first = [s for s, _, slot in placed if slot < slots]
    assert len(first) == slots and in_windows(target, placed)
    run, share = Counter(), {s: float(w / whole) for s, w in target.items()}
    for t, s in enumerate(first, 1):
        run[s] += 1
        if t % 97 == 0 or t == slots:
            assert all(abs(run[x] - w * t) < 1 + 1e-6 for x, w in share.items())


def test_mix_follows_the_target_of_skewed_sources(spark):
    rows = [(i, f"text {i}", "big", "", i) for i in range(8000)] + [(10_000 + i, f"small {i}", f"s{i % 20}", "", i) for i in range(480)]
    got = pfair.mix(spark.createDataFrame(rows, SCHEMA), block=2).collect()
    blocks = defaultdict(set)
    for r in got:
        blocks[r.source].add(r.mix_slot)
    assert len(got) == len(rows) and Counter(len(b) for b in blocks.values()) == {4000: 1, 12: 20}
    placed = [(s, k, slot) for s, b in blocks.items() for k, slot in enumerate(sorted(b))]
    assert in_windows({"big": 8000**0.5} | {f"s{i}": 24**0.5 for i in range(20)}, placed)
