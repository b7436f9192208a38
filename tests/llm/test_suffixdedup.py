from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from quillmark.llm import suffixdedup

SCHEMA = "doc_id long, text string, spans string, tid int"


def brute(rows, length):
    datas = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(d[i : i + length] for d in datas for i in range(len(d) - length + 1))
    out = []
    for (doc_id, *_), d in zip(rows, datas, strict=True):
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((doc_id, len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def made(seed: int, n: int, size: int, letters: str):
    rng = random.Random(seed)
    word = lambda m: "".join(rng.choice(letters) for _ in range(m))
    passages = [word(rng.randrange(size // 2, 3 * size)) for _ in range(5)]
    rows = []
    for d in range(n):
        parts = []
        for _ in range(rng.randrange(5)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p))
            parts += [rng.choice([p, p[cut:], p[:cut], word(rng.randrange(2 * size))]), word(rng.randrange(3))]
        rows.append((d, "".join(parts), "clash", d))
    return rows


@pytest.mark.parametrize("length,k,letters", [(40, 8, "ab"), (40, 8, "abcdefé "), (64, 16, "aé€"), (400, 32, "abcdefgh ")])
def test_matches_brute_force(spark, length, k, letters):
    rows = made(length, 40, length, letters)
    near = rows[5][1][: 3 * length] + "!" + rows[5][1][3 * length :]
    rows += [rows[3], rows[3], (3, rows[4][1], "same id", 1), (None, rows[6][1], None, None), (77, None, "n", 0), (78, "", "e", 0), (79, "short", "s", 0), (80, "z" * (5 * length), "run", 0), (81, "z" * length, "run", 0), (82, near, "near", 0), (83, "pq" * (2 * length), "self", 0)]
    got = suffixdedup.dedup_substrings(spark.createDataFrame(rows, SCHEMA), length, k, digest=True)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, length)


def test_hot_passage_between_different_texts(spark):
    rng = random.Random(3)
    word = lambda m: "".join(rng.choice("abcdefgh ") for _ in range(m))
    passage = word(700)
    rows = [(i, word(500) + passage + word(500), "", 0) for i in range(150)]
    got = suffixdedup.dedup_substrings(spark.createDataFrame(rows, SCHEMA), digest=True)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 400)


def test_spans_and_kept_bytes(spark):
    shared = "s" + "hared passage " * 40
    rows = [(1, "one " + shared + " end", "", 0), (2, "two " + shared, "", 0)]
    got = {r.doc_id: r for r in suffixdedup.dedup_substrings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [tuple(s) for s in got[1].spans] == [(3, 4 + len(shared) + 1)] or [tuple(s) for s in got[1].spans] == [(3, 4 + len(shared))]
    assert bytes(got[1].kept) + bytes(got[2].kept) and got[2].n_bytes == len(rows[1][1])


def test_empty_table(spark):
    assert suffixdedup.dedup_substrings(spark.createDataFrame([], SCHEMA), digest=True).count() == 0
