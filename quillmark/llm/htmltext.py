"""Main text of web pages by composite text density.

A page is parsed into a tree of elements (unclosed paragraphs, list items and cells end where the
next begins; stray end tags are ignored; what is cut off ends at the page's end). Each element has
characters C, tags T, characters in links LC and link tags LT, over its subtree; the text of an element
whose role is told by name counts as in links. Its composite text density is

    C/T * log(C/LC * T/LT) / log(log(C/NC * LC + LCb/Cb * C + e))

with NC the characters outside links and LCb, Cb those of the body (zeros count as one); names play no
part in it. Link lists score near zero, running text by its characters for each tag. The *density sum* of
an element is the sum over those of its children that are denser than the body, the page's own threshold;
inline elements are text of theirs.

1. The core is the element of the largest density sum. The body, whose sum holds that of the whole page's
   parts, is the core only if no part has more than all others together. Without any sum (no child is
   denser than the body) the densest element is the core.
2. Going up from the core, below the body, every element joins that is denser than the body and at least
   KEPT times as dense as the core; so sections come together, and the page's frame stays outside.
3. Other elements of the page that are as dense, and hold an element with SHARE of the core's density sum,
   contribute that element: articles in several parts.
4. An element around the main part that adds little but the title (h1) stands for it.

The result are these subtrees in page order. Names choose nothing; they take away: an element whose role is
told by name is neither a core nor a part, and goes where it lies inside of one. These are navigation,
headers of the page, footers, sidebars, notices, adverts, forms, scripts, styles and comment sections. A
class or role tells it by a whole token that is made of ROLES and words for boxes alone ("top-menu", but
not "side-effects"), an id likewise, and only that of a container: headings and sections have anchors.
Words that articles use too (MAYBE: "share", "discussion") tell it only of elements that are links for the
most part, or hold nothing but controls.

Inside the main text, character references are decoded, white space becomes one space, and blocks are
joined by line ends in page order.

Defined results: null or empty html, or a page without main text, has an empty text; a page in which
nothing has a positive density (links alone) has no main text. One page is held at once. Rows are independent, whatever their order or repetition; other columns than page_id, url and html are
ignored.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import blocks, documents, map_arrow, rows_of

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg select button canvas object audio video".split())
OPAQUE = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog head".split())
#: An open element of the key ends where one of the values begins.
CLOSED_BY = {
    "p": BLOCKS,
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "thead", "tfoot"}),
    "td": frozenset({"td", "th", "tr"}),
    "th": frozenset({"td", "th", "tr"}),
    "option": frozenset({"option", "optgroup"}),
}
#: Elements that an implied end does not reach through.
SCOPES = frozenset("article section main div table td th ul ol body html aside nav footer header blockquote form dl".split())
INLINE = frozenset("b i em strong a span u s small big font code sub sup mark label cite q abbr tt kbd var time".split())
#: Words of class, id and role that tell an element's part in the page.
ROLES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager sidebar aside widget footer foot masthead topbar toolbar cookie cookies consent gdpr notification popup modal overlay newsletter signup login comment comments commentlist disqus reply replies contentinfo".split()
)
#: Words that tell a role of links and controls only.
MAYBE = frozenset("promotion banner side notice notices alert subscribe subscription share sharing social related recommended trending respond discussion complementary search skip".split())
#: Words that tell no role, but stand beside one.
BOXES = frozenset("area bar block body bottom box button buttons container content group header holder inner item items left link links list main outer page panel primary right row secondary section site top wrap wrapper".split())
#: Elements whose id may tell a role.
CONTAINERS = frozenset("div ul ol dl table tbody tr td".split())
#: How dense an element must be, compared with the core, to join the main text.
KEPT = 0.5
#: The part of the core's density sum that a further subtree needs.
SHARE = 0.25
#: Characters by which a larger element may exceed what density has found.
TIE = 100
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "role", "maybe", "children", "parent", "chars", "tags", "link_chars", "link_tags", "density", "total", "best", "kids", "titles")

    def __init__(self, tag: str, role: bool, parent: Node | None, maybe: bool = False):
        self.tag, self.role, self.parent, self.maybe = tag, role, parent, maybe
        self.children: list = []  # of Node and str
        self.kids: list[Node] = []  # children that show text
        self.chars = self.tags = self.link_chars = self.link_tags = self.titles = 0
        self.density = self.total = 0.0
        self.best: Node = self


def _tells(value: str, names: frozenset) -> bool:
    """Whether a token of the value names a role, and nothing else."""
    for token in value.split():
        words = {w.lower() for w in _WORDS.findall(token)}
        if not names.isdisjoint(words) and words <= ROLES | MAYBE | BOXES:
            return True
    return False


def _has_role(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether names tell that the element is not part of the main text, or may not be."""
    if tag in BOILERPLATE or tag in RAW:
        return True, False
    if not attributes or attributes.isspace():
        return False, False
    maybe = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, False
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, False
        elif name in ("class", "role") and tag not in ("html", "body", "article", "main", "p", "h1") or name == "id" and tag in CONTAINERS:
            if _tells(value, ROLES):
                return True, False
            maybe = maybe or _tells(value, MAYBE)
        elif name in ("class", "id") and tag == "article" and not {"comment", "comments", "reply"}.isdisjoint(w.lower() for w in _WORDS.findall(value)):
            return True, False
    return False, maybe


def parse(page: str) -> Node:
    root = Node("html", False, None)
    node, at, size = root, 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            node.children.append(page[at:])
            break
        if m.start() > at:
            node.children.append(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            up = node
            while up is not root and up.tag != tag and not (tag in INLINE and up.tag in BLOCKS) and not (tag in CLOSED_BY and tag != "p" and up.tag in ("table", "ul", "ol", "dl") and tag not in (up.tag,)):
                up = up.parent
            if up is not root and up.tag == tag:
                node = up.parent
            continue
        if tag in VOID:
            node.children.append(Node(tag, False, node))
            continue
        # Elements that this one ends by starting.
        up = node
        while up is not root:
            if up.tag in CLOSED_BY and tag in CLOSED_BY[up.tag]:
                node = up.parent
                up = node
                continue
            if up.tag in SCOPES:
                break
            up = up.parent
        role, maybe = _has_role(tag, attributes)
        child = Node(tag, role, node, maybe)
        node.children.append(child)
        if tag in OPAQUE:
            end = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
            child.children.append(page[at : end.start()] if end else page[at:])
            at = page.find(">", end.end()) + 1 if end else size
            at = at or size
        elif not attributes.rstrip().endswith("/") or tag in BLOCKS or tag in INLINE:
            node = child
    return root


def _nodes(root: Node) -> list[Node]:
    """Elements that show text, parents before children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        node.kids = _seen(node)
        stack.extend(reversed(node.kids))
    return out


def _dropped(node: Node) -> bool:
    if node.role or node.maybe and 2 * node.link_chars >= node.chars:
        return True
    if node.tag == "header":
        up = node.parent
        while up is not None and up.tag not in ("article", "main"):
            up = up.parent
        return up is None
    return False


def measure(nodes: list[Node]) -> None:
    """Counts, densities and density sums of elements that come parents first, the body before all."""
    for node in reversed(nodes):
        node.chars = sum(len(_SPACE.sub(" ", c).strip()) for c in node.children if isinstance(c, str))
        for c in node.kids:
            node.chars += c.chars
            node.tags += c.tags + 1
            node.link_chars += c.link_chars
            node.link_tags += c.link_tags + (c.tag == "a")
            node.titles += c.titles + (c.tag == "h1")
        if node.tag == "a":
            node.link_chars = node.chars
    body = nodes[0]
    share = body.link_chars / max(1, body.chars)
    for node in reversed(nodes):
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
    for node in reversed(nodes):
        node.total = sum(k.density for k in node.kids if k.density > body.density and k.tag not in INLINE)
        node.best = max([node, *(k.best for k in node.kids if not _dropped(k))], key=lambda n: n.total)


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Composite text density; share: the part of the body's characters that is in links."""
    if not chars:
        return 0.0
    tags, link_tags = max(1, tags), max(1, link_tags)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + share * chars + math.e)
    odds = max(1.0, chars / max(1, link_chars) * tags / link_tags) + (link_chars == 0) * (math.e - 1)
    return chars / tags * max(0.0, math.log(odds) / base)


def _seen(node: Node) -> list[Node]:
    return [c for c in node.children if isinstance(c, Node) and c.tag not in RAW and c.tag != "head"]


def _plain(node: Node) -> int:
    return node.chars - node.link_chars


def _standing(nodes: list[Node]) -> list[Node]:
    """Elements that no name takes away, with all around them."""
    gone: set[int] = set()
    out = []
    for node in nodes:
        if id(node.parent) in gone or _dropped(node):
            gone.add(id(node))
        else:
            out.append(node)
    return out


def _core(body: Node, standing: list[Node]) -> Node | None:
    """The element of the largest density sum, or the densest where no child is denser than the body."""
    if not standing:
        return None
    if body.best.total:
        part = max((k.best for k in body.kids if not _dropped(k)), key=lambda n: n.total, default=body)
        around = part
        while around.parent is not body and around is not body:
            around = around.parent
        others = body.total - (around.density if around.density > body.density else 0)
        return part if part is not body and part.total >= others and part.total else body
    # Of equally dense ones the innermost: parents come first.
    densest = max(reversed(standing), key=lambda n: n.density)
    return densest if densest.density else None


def main_elements(root: Node) -> list[Node]:
    """The subtrees of the main text in page order; none if the page has no text."""
    body = root
    for c in _seen(root):
        if c.tag == "html":
            body = c
    for c in _seen(body):
        if c.tag == "body":
            body = c
    nodes = _nodes(body)
    measure(nodes)
    standing = _standing(nodes)
    core = _core(body, standing)
    if core is None:
        return []
    whole, up = core, core
    while up is not body and up.parent is not body:
        up = up.parent
        if up.density >= KEPT * core.density and up.density > body.density:
            whole = up
    # An inline element stands for the block around it.
    while whole is not body and whole.tag not in BLOCKS:
        whole = whole.parent
    whole = _with_title(whole, body)
    inside: set[int] = set()
    around = whole
    while around is not None:
        inside.add(id(around))
        around = around.parent
    found, taken = [], set()
    for node in standing:
        if node is whole or id(node.parent) in taken:
            taken.add(id(node))
            if node is whole:
                found.append(node)
        elif id(node) not in inside and node.density >= KEPT * core.density and node.best.total and node.best.total >= SHARE * core.total:
            taken.add(id(node))
            found.append(node.best)
    return found


def _with_title(element: Node, body: Node) -> Node:
    """The element, or the one around it that adds little but the title (h1)."""
    if not element.titles and element.tag != "h1":
        up = element
        while up is not body and _plain(up.parent) <= 1.25 * _plain(element) + TIE:
            up = up.parent
            if up.titles:
                return up
    return element


def text_of(element: Node) -> str:
    out: list[str] = []
    block: list[str] = []

    def end() -> None:
        text = _SPACE.sub(" ", _html.unescape("".join(block))).strip()
        if text:
            out.append(text)
        block.clear()

    stack: list = [(element, 0)]
    while stack:
        node, i = stack.pop()
        if i == 0 and node.tag in BLOCKS:
            end()
        while i < len(node.children):
            c = node.children[i]
            i += 1
            if isinstance(c, str):
                block.append(c)
            elif c.tag == "br":
                block.append(" ")
            elif c.tag == "hr":
                end()
            elif not _dropped(c):
                stack.append((node, i))
                stack.append((c, 0))
                break
        else:
            if node.tag in BLOCKS:
                end()
    end()
    return "\n".join(out)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return "\n".join(t for t in map(text_of, main_elements(parse(page))) if t)


TEXTS = "page_id long, url string, text string, n_chars long"


def _batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(rows_of(batches, "page_id", "url", "html", step=128), lambda r: len(r[2] or "") + 64):
        texts = [main_text(r[2]) for r in block]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in block], pa.int64()), pa.array([r[1] for r in block], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages."""
    return map_arrow(pages.select("page_id", "url", "html"), _batches, TEXTS)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(documents(spark, sf_dir, "pages"))


QUERIES = {"op3_html_text": op3_html_text}
ORACLES: dict[str, str] = {}
