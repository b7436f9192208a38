from __future__ import annotations

import random

import pytest

from quillmark.llm import htmltext

SCHEMA = "page_id long, url string, html string, text string, n_chars int"
LONG = ["The first paragraph tells at some length what happened &amp; why it matters to all who read it.", "A second one follows,   with\n white space and <b>bold</b> and <a href='/x'>linked</a> words in it.", "Short.", "The last paragraph closes the story with a &copy; sign, an &eacute; and a final &#8211; dash."]
WANT = ["The first paragraph tells at some length what happened & why it matters to all who read it.", "A second one follows, with white space and bold and linked words in it.", "Short.", "The last paragraph closes the story with a © sign, an é and a final – dash."]
NAV = "<nav><ul><li><a href='/a'>Home</a><li><a href='/b'>News of the day</a></ul></nav>"
JUNK = {
    "semantic": (NAV + "<header>Site name and motto</header>", "<aside>Side text with some words in it.</aside><footer>All rights reserved, and so on and on.</footer>"),
    "classes": ("<div class='top-menu'><a href=1>One</a> <a href=2>Two</a></div><div id='cookie-notice'>We use cookies on this site, so please agree to it now.</div>", "<div class='sidebar'><p>Things of the side, told in a sentence.</p></div><div class='comments'><p>A reader says that this is quite wrong in many ways indeed.</p></div><div id='footer'>Imprint and contact and more words</div>"),
    "forms": ("<script>if (a < b) document.write('<p>no</p>')</script><style>p{}</style><form><label>Name</label><input><select><option>x<option>y</select></form>", "<noscript>Enable scripts to read the comments of other readers.</noscript><section class='reply-list'><article class='comment'><p>Another comment, rather long, of a reader who liked it.</p></article></section>"),
}
WRAPS = {
    "article": "<article><h1>Title</h1>{}</article>",
    "main": "<main><h1>Title</h1><div>{}</div></main>",
    "div": "<div class='content'><h1>Title</h1>{}</div>",
    "nested": "<div><div class='post'><h1>Title</h1><div class='body'>{}</div></div></div>",
    "sections": "<article><header><h1>Title</h1></header><section>{}</section></article>",
}


@pytest.mark.parametrize("junk", JUNK)
@pytest.mark.parametrize("wrap", WRAPS)
@pytest.mark.parametrize("closed", [True, False])
def test_layouts(junk, wrap, closed):
    before, after = JUNK[junk]
    body = "".join(f"<p>{p}" + ("</p>" if closed else "\n") for p in LONG)
    page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{before}<!-- <p>gone</p> -->{WRAPS[wrap].format(body)}{after}</body></html>"
    assert htmltext.main_text(page) == "\n".join(["Title", *WANT])


def test_two_sections_short_blocks_and_inner_boilerplate():
    page = "<body>" + NAV + "<article><h1>T</h1><section><p>" + "</p><p>".join(LONG) + "</p></section><div class='ad'>Buy this thing now, it is cheap and good.</div><section><h2>More</h2><p>Tiny.</p><ul><li>one item</li><li>two</li></ul></section></article>"
    assert htmltext.main_text(page) == "\n".join(["T", *WANT, "More", "Tiny.", "one item", "two"])


def test_breaks_tables_and_cut_off_pages():
    assert htmltext.main_text("<article><p>one<br>two<br/>three</p><table><tr><td>a<td>b<tr><td>c</table></article>") == "one two three\na\nb\nc"
    assert htmltext.main_text("<body><article><p>Some text that is cut of") == "Some text that is cut of"
    assert htmltext.main_text("<body><article><p>Some text</p><p>cut <a hre") == "Some text\ncut"
    assert htmltext.main_text("plain text &lt;b&gt; only") == "plain text <b> only"
    assert htmltext.main_text("<p>a < b and c > d &amp;amp; e &unknown; &#x41;</p>") == "a < b and c > d &amp; e &unknown; A"


def test_empty_pages():
    assert [htmltext.main_text(p) for p in (None, "", "<html></html>", "<script>x</script>", "<!-- only", "<nav><a href=1>x</a></nav>", "<", "</p>", "&nbsp;")] == [""] * 6 + ["<"] + [""] * 2


def test_random_mark_up_never_fails():
    rng = random.Random(1)
    bits = ["<p>", "</p>", "<div class='x'>", "</div>", "<a href=\"q\">", "</a>", "text ", "<li>", "<ul>", "</ul>", "<b>", "</b>", "<br/>", "<table>", "<td>", "<!--", "-->", "<script>", "</script>", "&amp", "<", ">", "'", '"', "<article>", "</article>", "<svg/>", "<h1>"]
    for _ in range(500):
        htmltext.main_text("".join(rng.choice(bits) for _ in range(rng.randrange(80))))


def test_deep_and_long_pages():
    deep = "<div>" * 20000 + "<p>deep inside</p>"
    assert htmltext.main_text(deep) == "deep inside"
    long = "<article>" + "<p>word and word</p>" * 20000 + "</article>"
    assert htmltext.main_text(long).count("\n") == 19999


def test_rows(spark):
    page = "<article><p>é text</p></article>"
    rows = [(1, "u", page, "clash", 9), (1, "u", page, "clash", 9), (2, None, None, None, None), (None, "v", "", "", 0)]
    got = htmltext.extract(spark.createDataFrame(rows, SCHEMA))
    assert got.columns[:4] == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got.collect()) == [(0, "", 0), (1, "é text", 6), (1, "é text", 6), (2, "", 0)]
    assert htmltext.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_nothing_else_inside_the_article_goes():
    links = "<a href='/1'>The first source of all</a> <a href='/2'>The second source</a>"
    inside = {
        f"<p>{links}</p>": "The first source of all The second source",
        "<ol><li><a href='/1'>Source one</a><li><a href='/2'>Source two</a></ol>": "Source one\nSource two",
        "<table><tr><td><a href='/1'>Cell one</a><td><a href='/2'>Cell two</a></table>": "Cell one\nCell two",
        f"<div>{links}</div>": "The first source of all The second source",
        "<h2 id='discussion'>Discussion</h2>": "Discussion",
        "<h3 id='search'>Search</h3>": "Search",
        "<section id='related-work'><p>What others did.</p></section>": "What others did.",
        "<section id='comments'><p>On comments.</p></section>": "On comments.",
        "<div class='side-effects'><p>It may itch.</p></div>": "It may itch.",
        "<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p>": "Let x=2 hold.",
    }
    for markup, text in inside.items():
        page = f"<body>{NAV}<article><h1>T</h1><p>{LONG[0]}</p>{markup}<p>{LONG[3]}</p></article></body>"
        assert htmltext.main_text(page) == "\n".join(["T", WANT[0], text, WANT[3]])


@pytest.mark.parametrize("attribute", ["class='nav'", "class='x top-menu'", "id='cookie-notice'", "role='navigation'", "class='commentList'", "class='related-links'", "id='sidebar'"])
def test_told_roles_inside_the_article_go(attribute):
    page = f"<article><h1>T</h1><p>{LONG[0]}</p><div {attribute}><a href='/1'>One</a> <a href='/2'>Two</a></div><p>{LONG[3]}</p></article>"
    assert htmltext.main_text(page) == "\n".join(["T", WANT[0], WANT[3]])
