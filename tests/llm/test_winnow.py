from __future__ import annotations

import hashlib

import pytest
import xxhash

from quillmark.llm import winnow

SCHEMA = "doc_id long, text string, range string, guest int"


def brute(text: str, k: int, w: int) -> list[tuple[int, int]]:
    text = text or ""
    if not text:
        return []
    grams = [text[i : i + k] for i in range(max(1, len(text) - k + 1))]
    hashes = [(xxhash.xxh64(g.encode("utf-32-be"), seed=42).intdigest()) >> (winnow.POS_BITS + 1) for g in grams]
    if len(hashes) <= w:
        windows = [range(len(hashes))]
    else:
        windows = [range(i, i + w) for i in range(len(hashes) - w + 1)]
    return sorted({min((hashes[i], -i) for i in win)[::-1] for win in windows}, reverse=True)


def like(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


TEXTS = [None, "", "a", "short one", "aaaa " * 60, "lorem ipsum dolor sit amet " * 9, "é€😀 ünï " * 40, "x" * 3000, "lorem ipsum dolor sit amet " * 9, "the quick brown fox jumps over the lazy dog and runs on and on " * 5 + "end"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 7 % 11 + 100 * i, t, "clash", 1) for i, t in enumerate(TEXTS)]
    rows += [(rows[5][0], "another text under the same id " * 8, "c", 0), (None, "without an id " * 9, None, None), rows[8]]
    return rows


@pytest.mark.parametrize("k,w", [(3, 4), (20, 16)])
def test_selects_what_brute_force_selects(spark, docs, k, w):
    got = winnow.fingerprints(spark.createDataFrame(docs, SCHEMA), k, w).collect()
    assert len(got) == len(docs)
    want = sorted([(d[0] is None, d[0] or 0, len(d[1] or ""), [(-p, h) for p, h in brute(d[1], k, w)]) for d in docs])
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars, [(f.pos, f.hash) for f in r.fingerprint]) for r in got) == want


@pytest.mark.parametrize("k,w", [(3, 4), (5, 2)])
def test_edits_and_neighbours(spark, docs, k, w):
    got = winnow.compare_with_edits(spark.createDataFrame(docs, SCHEMA), k, w).collect()
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, (d[1] or "").encode()), reverse=True)
    want = []
    for i, d in enumerate(order):
        text, after = d[1] or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        own, new = brute(text, k, w), brute(edited, k, w)
        as_text = lambda f: hashlib.sha256(",".join(str(h << winnow.POS_BITS | (winnow.POS + p)) for p, h in f).encode()).hexdigest()
        want.append((str(d[0]), len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(new), round(like(own, new), 9), round(like(own, brute(after, k, w)), 9)))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert winnow.compare_with_edits(none).count() == 0
    assert winnow.fingerprints(none).count() == 0


def test_shared_passage_shares_a_fingerprint(spark):
    shared = "abcdefghij klmnopqrst uvwxyz 012345"  # k + w - 1 code points
    rows = [(1, "q" * 37 + shared + "r" * 50), (2, "start " * 9 + shared + " end" * 9)]
    got = {r.doc_id: {f.hash for f in r.fingerprint} for r in winnow.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] & got[2]
