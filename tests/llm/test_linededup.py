from __future__ import annotations

import random
import re

import pytest
import xxhash

from quillmark.llm import linededup

SCHEMA = "doc_id long, text string, lines string, key int"


def hash64(text: str) -> int:
    value = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return value - (1 << 64) if value >> 63 else value


def brute(rows, run=3, words=50):
    """rows with later copies of runs of at least ``run`` lines or of more than ``words`` words deleted."""
    docs = sorted({(d, t) for d, t, *_ in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0, hash64(r[1])))
    seen, gone = set(), {}
    for d, t in docs:
        full = [(i, x.strip(" ")) for i, x in enumerate(t.split("\n")) if x.strip(" ")]
        for s in range(len(full)):
            for n in range(1, min(run, len(full) - s) + 1):
                part = full[s : s + n]
                if n == run or sum(len(re.findall(r"\S+", x, re.A)) for _, x in part) > words:
                    key = tuple(x for _, x in part)
                    if key in seen:
                        gone.setdefault((d, t), set()).update(i for i, _ in part)
                    seen.add(key)
    out = []
    for d, t, *rest in rows:
        left = gone.get((d, t), set())
        out.append((d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in left) if t is not None else None, *rest, len(t.split("\n")) if t is not None else 0, len(left)))
    return out


def made(seed: int, n: int):
    rng = random.Random(seed)
    shared = [f"shared line {i}" for i in range(9)]
    rows = []
    for d in range(n):
        lines = [rng.choice(shared) if rng.random() < 0.8 else rng.choice(["", "  ", f"own {rng.random()}"]) for _ in range(rng.randrange(12))]
        rows.append((d, "\n".join(lines), f"x{d}", d))
    return rows


@pytest.mark.parametrize("k,w", [(1, 3), (2, 2), (3, 1), (2, 4)])
def test_matches_brute_force(spark, k, w):
    rows = made(k * 10 + w, 60)
    rows += [(5, None, "n", 1), (None, rows[3][1], None, None), rows[7], (7, rows[8][1], "same id", 2), (99, "a\nb\nc\na\nb\nc\na\nb\nc", "self", 3), (98, "one", "s", 4), (97, "", "e", 5)]
    random.Random(1).shuffle(rows)
    got = linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA), k, w)
    assert got.columns == ["doc_id", "text", "lines", "key", "n_lines", "n_removed"]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, brute(rows, k + w - 1)))


def test_very_long_text_and_one_hot_group(spark):
    long = "\n".join(f"line {i % 700} {i // 700}" for i in range(20000))
    rows = [(0, long, "", 0)] + [(i, "hot a\nhot b\nhot c\nhot d", "", 0) for i in range(1, 500)]
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].text == long and got[1].n_removed == 0
    assert all(got[i].text == "" and got[i].n_removed == 4 for i in range(2, 500))


def test_empty_table(spark):
    assert linededup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def whole_brute(rows):
    """(doc_id, text, lines deleted) by the operator's default rule."""
    return sorted((d, t, gone) for d, t, *_, gone in brute(rows))


def test_passages_of_one_or_two_lines_go_by_their_words(spark):
    line = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    long, edge, half, rest = line("long", 51), line("edge", 50), line("half", 30), line("rest", 21)
    texts = [long, f"own one\n{long}\nown two", f"  {long} ", f"{half}\n\n{rest}", f"x\n{half}\n \n{rest}\ny", f"{rest}\n{half}", half, edge, edge, f"a\n{edge}\nb", f"{long}\ntail", f"{long}\ntail", f"{long}\n{long}"]
    rng = random.Random(5)
    parts = [long, edge, half, rest, "tail", "", "own", "\t".join(long.split())]
    texts += ["\n".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(80)]
    rows = [(i, t, "", 0) for i, t in enumerate(texts)]
    got = sorted((r.doc_id, r.text, r.n_removed) for r in linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == whole_brute(rows)
    left = {d: t for d, t, _ in got}
    assert left[1] == "own one\nown two" and left[2] == "" and left[4] == "x\n \ny" and left[8] == edge and left[11] == ""
