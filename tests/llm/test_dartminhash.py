from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillmark.llm import dartminhash as dm

SCHEMA = "doc_id long, text string, node string, t1 int"


def weights(text: str, n: int = 5) -> Counter:
    words = text.lower().split()
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def similarity(a: str, b: str) -> float:
    x, y = weights(a), weights(b)
    top = sum((x & y).values())
    return top / max(1, sum(x.values()) + sum(y.values()) - top)


def brute(rows):
    texts = sorted({t for _, t, *_ in rows if t is not None})
    label = {t: t for t in texts}

    def root(t):
        while label[t] != t:
            t = label[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if similarity(a, b) >= 0.8:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    ids: dict = {}
    for d, t, *_ in rows:
        if t is not None and d is not None:
            ids.setdefault(root(t), []).append(d)
    return sorted(((d, min(ids.get(root(t), [None]), key=lambda x: (x is None, x)) if t is not None else d) for d, t, *_ in rows), key=repr)


def made(seed: int, n: int, edits: float):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randrange(3, 160))] for _ in range(12)]
    rows = []
    for d in range(n):
        words = list(rng.choice(bases))
        for i in range(len(words)):
            if rng.random() < edits:
                words[i] = rng.choice(vocabulary)
        rows.append((d, " ".join(words), "clash", d))
    return rows


def test_grams_are_the_words():
    texts = ["a b c d e f", "", "A  B\nc d E", "one two", "x y z x y z x y z x y z", "   "]
    owner, element = dm.grams(texts)
    assert [int((owner == i).sum()) for i in range(6)] == [sum(weights(t).values()) for t in texts]
    assert len(set(element.tolist())) == len(set().union(*(weights(t) for t in texts)))


@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_agree_as_weighted_jaccard(weighted):
    rng = np.random.default_rng(4)
    n = 600
    x = rng.uniform(0.1, 4.0, n) if weighted else np.ones(n)
    y = np.where(rng.random(n) < 0.7, x, rng.uniform(0.1, 4.0, n) if weighted else 0)
    want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    el = dm.mix64(np.arange(n))
    owner = np.concatenate([np.zeros(n, int), np.ones(int((y > 0).sum()), int)])
    got = dm.signatures(owner, np.concatenate([el, el[y > 0]]), np.concatenate([x, y[y > 0]]), 2, 2048)
    assert (got > 0).all()
    assert abs((got[0] == got[1]).mean() - want) < 0.05


@pytest.mark.parametrize("seed,edits", [(1, 0.0), (2, 0.01), (3, 0.03)])
def test_classes_match_brute_force(spark, seed, edits):
    rows = made(seed, 120, edits)
    rows += [rows[4], rows[4], (4, rows[5][1], "same id", 1), (None, rows[6][1], None, None), (None, None, "n", 0), (300, None, "n", 0), (301, "", "e", 0), (302, "", "e", 0), (303, " ", "e", 0), (304, "One two", "e", 0), (305, "one  two", "e", 0)]
    got = dm.near_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=repr) == brute(rows)
    kept = dm.one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "node", "t1"]
    classes = {repr(c) if t is not None else repr((d, i)) for i, ((d, c), t) in enumerate(_classes(rows))}
    left = [tuple(r) for r in kept.collect()]
    assert len(left) == len(classes) and set(left) <= {tuple(r) for r in rows}


def _classes(rows):
    """((doc_id, class), text); a class without any doc_id is told by its text."""
    texts = sorted({(t, d) for d, t, *_ in rows if t is not None}, key=repr)
    ids = dict.fromkeys(t for t, _ in texts)
    for t in ids:
        ids[t] = min(s for s in ids if s == t or _linked(rows, s, t))
    return [((d, ids.get(t)), t) for d, t, *_ in rows]


def _linked(rows, s, t):
    if _linked.rows is not rows:
        texts = sorted({x for _, x, *_ in rows if x is not None})
        label = {x: x for x in texts}
        changed = True
        links = [(a, b) for i, a in enumerate(texts) for b in texts[:i] if similarity(a, b) >= 0.8]
        while changed:
            changed = False
            for a, b in links:
                low = min(label[a], label[b])
                changed |= label[a] != low or label[b] != low
                label[a] = label[b] = low
        _linked.rows, _linked.label = rows, label
    return _linked.label[s] == _linked.label[t]


_linked.rows = None


def test_loose_and_blocked_buckets(spark, monkeypatch):
    """The same classes when mixed buckets are compared in blocks, and one class of many copies."""
    rows = made(5, 90, 0.035)
    want = brute(rows)
    monkeypatch.setattr(dm, "LOOSE_TEXTS", -1)
    monkeypatch.setattr(dm, "BLOCK_TEXTS", 4)
    got = dm.near_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=repr) == want


@pytest.mark.parametrize("seed,edits,known", [(6, 0.004, False), (7, 0.008, True), (8, 0.012, True)])
def test_blocks_link_what_is_alike_without_pairs(monkeypatch, seed, edits, known):
    """A text meets all texts of a block at once; blocks give the components that single pairs give, as forests."""
    texts = sorted({t for _, t, *_ in made(seed, 80, edits)} | {"one two", "one", "a a a a a a a a"})
    sets = dm.Multisets(texts)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if sets.alike(i, j, 0.8)]

    def classes(links):
        label = np.arange(len(texts))
        for i, j in links:
            label[label == label[i]] = label[j]
        return [int(np.flatnonzero(label == x)[0]) for x in label]

    want = classes(pairs)
    roots = classes(pairs[::3]) if known else list(range(len(texts)))
    members = [{"node": i, "root": r, "part": i % 3, "text": t} for i, (t, r) in enumerate(zip(texts, roots, strict=True))]
    blocks = [(low, high) for high in range(3) for low in range(high + 1)]
    rows = [{"low": low, "high": high, "members": [m for m in members if m["part"] in (low, high)]} for low, high in blocks]
    monkeypatch.setattr(dm.Multisets, "alike", None)
    links = []
    for row in rows:
        found = [(x["a"], x["b"]) for out in dm._forests(0.8, 5)([pa.RecordBatch.from_pylist([row])]) for x in out.to_pylist()]
        assert len(found) < max(1, len({m["root"] for m in row["members"]}))
        assert all(row["low"] == row["high"] or a % 3 != b % 3 for a, b in found)
        links += found
    assert classes([*links, *enumerate(roots)]) == want
    assert len(pairs) > 20 and len(set(want)) > 10


def test_empty_table(spark):
    assert dm.near_classes(spark.createDataFrame([], SCHEMA)).count() == 0
