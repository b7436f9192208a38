from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from quillmark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row) -> str:
    doc_id, text, lang, source, n = row
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))


def levels_of(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def path(levels: list[list[str]], index: int) -> list[tuple[str, str]]:
    out = []
    for nodes in levels[:-1]:
        run = index // 8 * 8
        out.append(("".join(nodes[run:index]), "".join(nodes[index + 1 : run + 8])))
        index //= 8
    return out


def brute(rows):
    by_lang: dict = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        own = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, levels_of([leaf(r) for r in own])))
    top = levels_of([levels[-1][0] for _, levels in trees])
    root = top[-1][0]
    out = []
    for t, (own, levels) in enumerate(trees):
        for i, r in enumerate(own):
            steps = path(levels, i) + path(top, t)
            changed = r
            if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                changed = (r[0], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1]), *r[2:])
            folded = leaf(changed)
            for left, right in steps:
                folded = digest(left, folded, right)
            out.append((r[0], leaf(r), levels[-1][0], root, digest(*(x for s in steps for x in s)), folded, folded == root))
    return out


def made(seed: int, n: int, langs):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "Äb C", "lower only", f"Text {rng.random()}\n É"])
        rows.append((rng.choice([None, i, i, i, i // 2]), text, rng.choice(langs), rng.choice([None, "", "src1"]), rng.choice([None, i])))
    return rows + rows[: n // 5]


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("n,langs", [(1, ["en"]), (8, [None]), (9, ["en"]), (70, ["en", None, "", "é", "z"]), (600, ["en", "en", "en", "de"]), (40, [f"l{i}" for i in range(30)])])
def test_matches_brute_force(spark, n, langs):
    rows = made(n, n, langs)
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got.columns == COLUMNS
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute(rows)))


def test_many_ranges_and_a_hot_language(spark):
    rows = [(i, f"Text {i}", "hot" if i % 10 else f"l{i % 70}", "s", i) for i in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(tuple, merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == sorted(brute(rows))
    assert 0 < sum(not r[-1] for r in got) < len(got) / 2


def test_extra_columns_and_long_texts(spark):
    rows = [(i, "Long É " * (200_000 if i == 1 else 1), "en", None, i) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("leaf", "tree", "index", "range", "at", "copy", "tampered", "n", "digests"):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    assert sorted(map(tuple, merkle.manifest(df).collect())) == sorted(brute(rows))


def test_empty_table(spark):
    got = merkle.manifest(spark.createDataFrame([], SCHEMA))
    assert got.columns == COLUMNS and got.count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_forest_is_a_commutative_monoid(seed):
    """Leaves dealt to parts at random, summed in any order and shape, give one root and every run once."""
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 7, 8, 9, 63, 64, 65, 130, 513]) for _ in range(rng.randrange(1, 20))]
    leaves = [(t, n, 0, i, hashlib.sha256(f"{t}/{i}".encode()).digest()) for t, n in enumerate(sizes) for i in range(n)]
    parts = [merkle.Forest(len(sizes)) for _ in range(rng.randrange(1, 9))]
    rng.shuffle(leaves)
    for node in leaves:
        rng.choice(parts).add(*node)
    while len(parts) > 1:
        a, b = (parts.pop(rng.randrange(len(parts))) for _ in range(2))
        parts.append(a.merge(b))
    trees = [levels_of([hashlib.sha256(f"{t}/{i}".encode()).hexdigest() for i in range(n)]) for t, n in enumerate(sizes)]
    top = levels_of([x[-1][0] for x in trees])
    assert parts[0].root.hex() == top[-1][0] and not parts[0].open
    runs = sum(len(nodes) for levels in [*trees, top] for nodes in levels[1:])
    assert len(parts[0].closed) == len({x[:3] for x in parts[0].closed}) == runs


def test_contiguous_parts_leave_few_nodes_open():
    forest = merkle.Forest(1)
    for i in range(1_000, 30_000):
        forest.add(0, 100_000, 0, i, b"x" * 32)
    assert len(list(forest.nodes())) <= 2 * 7 * merkle.height(100_000)
