from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillmark.llm import urlfilter

SCHEMA = "page_id long, url string, html string"
RULES = [("com", "/", True), ("example.com", "/en/", False), ("www.example.com", "/en/", True), ("net", "/es/", False), ("net", "/fr/", False)]


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = lambda s, marks: next((i for i, c in enumerate(s) if c in marks), len(s))
    at = cut(rest, "/?#")
    host = "".join(c.lower() if c.isascii() else c for c in rest[:at])
    return host, rest[at : at + cut(rest[at:], "?#")]


def rule_of(host, path):
    fits = [(len(h + p), h + p, allow) for h, p, allow in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute(rows, order=urlfilter.ORDER, least=urlfilter.LEAST_SHARE):
    urls = [(r[0], *parsed(r[1])) for r in rows]
    texts = Counter(h + p for _, h, p in urls if h + p)
    allow = {h + p: rule_of(h, p)[1] for _, h, p in urls}
    spare = {t: hashlib.md5(t.encode()).hexdigest()[0] < "3" for t in texts}

    def grams(text):
        marked = "\u0002" + text + "\u0003"
        return [marked[end - size : end] for end in range(2, len(marked) + 1) for size in range(1, min(order + 1, end) + 1)]

    counts = {True: Counter(), False: Counter()}
    for t, n in texts.items():
        if allow[t] is not None and not spare[t]:
            for g in grams(t):
                counts[allow[t]][g] += n
    every = set(counts[True]) | set(counts[False])
    total = {y: sum(n for g, n in c.items() if len(g) == 1) for y, c in counts.items()}
    kept = {g for g in every if any(counts[y][g] >= total[y] * least for y in total)} if all(total.values()) else set()
    followers = {y: defaultdict(Counter) for y in counts}
    for y, c in counts.items():
        for g, n in c.items():
            followers[y][g[:-1]][g[-1]] += n
    characters = sum(len(g) == 1 for g in every)

    def chance(y, g):
        shorter = chance(y, g[1:]) if len(g) > 1 else 1 / characters
        seen = followers[y].get(g[:-1], {})
        n, t = sum(seen.values()), len(seen)
        return (counts[y][g] + t * shorter) / (n + t) if n + t else shorter

    def score(text):
        total = 0.0
        marked = "\u0002" + text + "\u0003"
        for end in range(2, len(marked) + 1):
            known = [g for size in range(1, min(order + 1, end) + 1) if (g := marked[end - size : end]) in kept]
            if known:
                g = max(known, key=len)
                total += math.log(chance(True, g)) - math.log(chance(False, g))
        limit = urlfilter.STEPS * urlfilter.FARTHEST
        return max(-limit, min(limit, math.floor(round(total / (len(text) + 1), 9) * urlfilter.STEPS)))

    steps = {t: score(t) for t in texts if allow[t] is None or spare[t]}
    known = [(steps[t], n, allow[t]) for t, n in texts.items() if spare[t] and allow[t] is not None]
    yes, no = (sum(n for _, n, a in known if a == y) for y in (True, False))
    limit = urlfilter.STEPS * urlfilter.FARTHEST
    right = lambda k: sum(n * (no if a else yes) for s, n, a in known if (s >= k) == a)
    ends = sorted({s + d for s, _, _ in known for d in (0, 1)} | {0})
    best = max(map(right, range(-limit, limit + 2) if len(known) < 20 else ends))
    cut = min((k for k in range(-limit, limit + 2) if right(k) == best), key=lambda k: (abs(k), k))
    out = []
    for page, h, p in urls:
        rule, verdict = rule_of(h, p)
        ok = verdict if rule else (steps[h + p] >= cut if h + p else True)
        out.append((page, h, p, rule, "allow" if ok else "block"))
    return out


def pages(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        host = rng.choice(["a.example", "www.example", "m.b", "spam-farm.x", "blog.tion"]) + rng.choice([".com", ".net", ".org", ".NET", ".org"])
        path = rng.choice(["/en/", "/es/", "/fr/", "/de/"]) + rng.choice([str(i), "x.html", "é"])
        rows.append((i, f"http{rng.choice(['', 's'])}://{host}{path}{rng.choice(['', '?q=1', '#top'])}", "<html>"))
    return rows


@pytest.mark.parametrize("seed,n,order,least", [(1, 150, 5, 2.0**-14), (2, 120, 2, 0.01), (3, 60, 0, 0.5)])
def test_matches_brute_force(spark, seed, n, order, least):
    rows = pages(seed, n) + [(900, None, None), (901, "no scheme", ""), (902, "http://", ""), (None, "ftp://COM/", ""), (903, "x://y?://z/", ""), (903, "x://y?://z/", ""), (904, "a://b://c/d", "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("host", "text", "key", "n", "gram", "size", "step", "allow")})
    got = urlfilter.judged(df, order=order, least=least)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute(rows, order, least)))


def test_rules(spark):
    urls = {
        "http://x.com/a": ("com/", "allow"),
        "http://com/": ("com/", "allow"),
        "http://example.com/en/1": ("example.com/en/", "block"),
        "http://EXAMPLE.com/en/1": ("example.com/en/", "block"),
        "http://a.example.com/en/": ("example.com/en/", "block"),
        "http://notexample.com/en/": ("com/", "allow"),
        "http://www.example.com/en/1?x": ("www.example.com/en/", "allow"),
        "http://m.www.example.com/en/1": ("www.example.com/en/", "allow"),
        "http://example.com/EN/1": ("com/", "allow"),
        "http://a.net/es/": ("net/es/", "block"),
        "http://net/fr/x#y": ("net/fr/", "block"),
        "http://a.net/es": (None, "allow"),
        "http://x.com": (None, "allow"),
        "http://x.com?/": (None, "allow"),
        "http://x.com:80/": (None, "allow"),
    }
    got = urlfilter.judged(spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], SCHEMA)).collect()
    found = {u: (r.rule, r.verdict) for r in got for i, u in enumerate(urls) if i == r.page_id}
    assert {u: v for u, v in found.items() if v[0]} == {u: v for u, v in urls.items() if v[0]}
    assert {u: v[0] for u, v in found.items()} == {u: v[0] for u, v in urls.items()}


def test_learned_verdicts_follow_the_corpus(spark):
    rows = [(i, f"http://good-{i % 37}.com/news/{i}", "") for i in range(300)] + [(1000 + i, f"http://casino-{i % 37}.net/es/win/{i}", "") for i in range(300)]
    rows += [(2000 + i, f"http://good-{i}.org/news/{i}", "") for i in range(40)] + [(3000 + i, f"http://casino-{i}.org/es/win/{i}", "") for i in range(40)]
    got = {r.page_id: r.verdict for r in urlfilter.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(got[2000 + i] == "allow" for i in range(40)) >= 38 and sum(got[3000 + i] == "block" for i in range(40)) >= 38


def test_very_long_urls_and_copies(spark):
    long = "http://a.net/es/" + "é/" * 30_000
    rows = [(1, long, ""), (2, long.replace("net/es", "org/x"), "")] + [(i, "http://b.com/same", "") for i in range(3, 400)] + [(i, "http://b.org/same", "") for i in range(400, 800)]
    got = urlfilter.judged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 799 and {r.verdict for r in got if 3 <= r.page_id < 400} == {"allow"}
    assert len({r.verdict for r in got if r.page_id >= 400}) == 1


def test_empty_table_and_one_class(spark):
    assert urlfilter.judged(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(i, f"http://x{i}.net/es/1", "") for i in range(30)] + [(99, "http://y.org/", "")]
    got = {r.page_id: r.verdict for r in urlfilter.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got.pop(99) == "allow" and set(got.values()) == {"block"}
