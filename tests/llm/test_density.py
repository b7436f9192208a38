"""Composite text density: against a plain computation, and that it decides what the main text is."""

from __future__ import annotations

import math
import random

from quillmark.llm import htmltext


def plain(tree):
    """(chars, tags, link chars, link tags, density, total) of a nested (tag, children) by recursion; no roles."""

    def counts(node):
        tag, children = node
        c = t = lc = lt = 0
        for child in children:
            if isinstance(child, str):
                c += len(child)
            else:
                kc, kt, klc, klt = counts(child)
                c, t, lc, lt = c + kc, t + kt + 1, lc + klc, lt + klt + (child[0] == "a")
        return c, t, c if tag == "a" else lc, lt

    body = counts(tree)
    share = body[2] / max(1, body[0])

    def density(node):
        c, t, lc, lt = counts(node)
        if not c:
            return 0.0
        t, lt = max(1, t), max(1, lt)
        linked = c / max(1, lc) * t / lt
        odds = max(1.0, linked) + (math.e - 1 if lc == 0 else 0)
        return c / t * max(0.0, math.log(odds) / math.log(c / max(1, c - lc) * lc + share * c + math.e))

    out = []
    page = density(tree)

    def walk(node):
        out.append((*counts(node), density(node), sum(density(k) for k in node[1] if not isinstance(k, str) and density(k) > page and k[0] not in ("b", "span", "a"))))
        for k in node[1]:
            if not isinstance(k, str):
                walk(k)

    walk(tree)
    return out


def grown(rng, depth=0):
    tag = rng.choice(["div", "p", "b", "a", "section", "span"]) if depth else "div"
    children = []
    for _ in range(rng.randrange(1, 4)):
        if depth > 3 or rng.random() < 0.5:
            children.append("x" * rng.randrange(1, 90))
        else:
            children.append(grown(rng, depth + 1))
    return tag, children


def built(tree, parent=None):
    node = htmltext.Node(tree[0], False, parent)
    node.children = [c if isinstance(c, str) else built(c, node) for c in tree[1]]
    return node


def test_densities_of_small_trees():
    rng = random.Random(2)
    for _ in range(200):
        tree = grown(rng)
        nodes = htmltext._nodes(built(tree))
        htmltext.measure(nodes)
        got = [(n.chars, n.tags, n.link_chars, n.link_tags, round(n.density, 9), round(n.total, 9)) for n in nodes]
        assert got == [(*w[:4], round(w[4], 9), round(w[5], 9)) for w in plain(tree)]
        assert round(nodes[0].best.total, 9) == max(g[5] for g in got) or not nodes[0].total


WORDS = "A sentence of the story that goes on for some while, so that it is told in full."
PAGE = "<body><div><a href=1>Home</a> <a href=2>News</a> <a href=3>Shop</a> <a href=4>More of it</a></div><div><h1>Title</h1>{}</div><div><a href=5>Imprint</a> <a href=6>Contact</a></div></body>"


def test_pages_without_any_name():
    page = PAGE.format("".join(f"<p>{WORDS}</p>" for _ in range(5)))
    assert htmltext.main_text(page) == "\n".join(["Title", *[WORDS] * 5])


def plain_core(tree):
    """Path of the core of a tree without names: largest sum of parts, by recursion over (tag, children)."""
    told = plain(tree)
    places, at = {}, iter(range(len(told)))

    def walk(node, path):
        places[path] = told[next(at)]
        for i, k in enumerate(node[1]):
            if not isinstance(k, str):
                walk(k, (*path, i))

    walk(tree, ())
    density, total = ({p: v[i] for p, v in places.items()} for i in (4, 5))
    if not any(total.values()):
        best = max(density.values())
        return max(p for p in density if density[p] == best) if best else None
    parts = [p for p in places if p]
    if not parts:
        return ()
    part = max(sorted(parts), key=lambda p: total[p])
    others = total[()] - (density[part[:1]] if density[part[:1]] > density[()] else 0)
    return part if total[part] and total[part] >= others else ()


def test_core_of_small_trees():
    rng = random.Random(4)
    found = set()
    for _ in range(400):
        tree = grown(rng)
        root = built(tree)
        nodes = htmltext._nodes(root)
        htmltext.measure(nodes)
        core = htmltext._core(root, htmltext._standing(nodes))
        want = plain_core(tree)
        if want is None:
            assert core is None
            continue
        node = root
        for i in want:
            node = node.children[i]
        assert core is node or (round(core.total, 9), round(core.density, 9)) == (round(node.total, 9), round(node.density, 9))
        found.add(len(want))
    assert len(found) > 2


def _pages():
    import pyarrow.parquet as pq

    from ..conftest import DATA

    return [p for p in pq.read_table(f"{DATA}/pages.parquet").column("html").to_pylist() if p]


def test_density_finds_what_names_are_not_needed_for(monkeypatch):
    """Ablations on the whole table: without names few pages change, without density most do."""
    pages = _pages()
    whole = [htmltext.main_text(p) for p in pages]
    with monkeypatch.context() as m:
        m.setattr(htmltext, "ROLES", frozenset())
        m.setattr(htmltext, "MAYBE", frozenset())
        m.setattr(htmltext, "BOILERPLATE", frozenset({"head"}))
        assert sum(htmltext.main_text(p) != w for p, w in zip(pages, whole)) < len(pages) / 10
    for formula in (lambda *counts: 0.0, lambda *counts: 1.0):
        with monkeypatch.context() as m:
            m.setattr(htmltext, "density", formula)
            assert sum(htmltext.main_text(p) != w for p, w in zip(pages, whole)) > len(pages) / 2


def test_words_of_articles_tell_a_role_of_links_only():
    long = " ".join(["word"] * 60)
    kept = {f"<section class='discussion'><h2>Discussion</h2><p>{long}</p></section>": f"Discussion\n{long}", f"<section class='search'><p>{long}</p></section>": long, "<div class='share'><p>Price of one share was ten.</p></div>": "Price of one share was ten.", "<div class='share'><a href=1>Send</a> <a href=2>Post</a></div>": "", "<div class='related'><a href=1>Another story</a></div>": ""}
    for inside, text in kept.items():
        page = f"<body><nav><a href=1>x</a></nav><article><h1>T</h1><p>{long}</p>{inside}<p>{long}</p></article></body>"
        assert htmltext.main_text(page) == "\n".join(x for x in ("T", long, text, long) if x)


def test_parts_of_one_article_come_together():
    part = f"<p>{WORDS}</p>" * 4
    for page in (f"<body><nav><a href=1>Home</a></nav><section>{part}</section><section>{part}</section><footer>Imprint</footer></body>", f"<body><div><a href=1>Home</a> <a href=2>News</a></div><div class='page'><div>{part}</div><div>{part}</div></div></body>"):
        assert htmltext.main_text(page) == "\n".join([WORDS] * 8)


def test_an_article_is_not_taken_by_its_name_alone():
    """The long story is the main text, whichever element is called article."""
    teaser = "<article><p>Read more.</p></article>"
    page = f"<body>{teaser}<div>" + f"<p>{WORDS}</p>" * 6 + f"</div>{teaser}</body>"
    assert htmltext.main_text(page).count(WORDS) == 6


def test_words_inside_of_names_tell_no_role():
    for inside, text in ((f"<div class='share-price'><p>{WORDS}</p></div>", WORDS), ("<div class='promotion-history'><p>Price of one share was 10.</p></div>", "Price of one share was 10."), ("<p>where <math><mi>x</mi></math> is the root</p>", "where x is the root")):
        page = f"<article><p>{WORDS}</p>{inside}<p>{WORDS}</p></article>"
        assert htmltext.main_text(page) == "\n".join([WORDS, text, WORDS])
