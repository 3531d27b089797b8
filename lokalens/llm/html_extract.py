"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their parent and, halved, to their grandparent;
a container's points are discounted by its link density. The best container is kept with all beside it
that holds text; only what markup, names or links call boilerplate is left out.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, slices, table

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text that no parser reads.
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
#: Never part of an article's text.
DROPPED = frozenset("script style title head noscript template iframe object embed svg canvas audio video nav footer header aside form button select option input textarea fieldset dialog menu noembed noframes xmp plaintext".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article body blockquote center dd details div dl figure html li main ol section table tbody td tr ul".split())
PARAGRAPHS = frozenset("p pre td blockquote h1 h2 h3 h4 h5 h6 li dd dt figcaption".split())
#: Words in class, id or role that call a block boilerplate, and such as call it content.
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner banners sidebar sidebars aside menu menus nav navbar navigation navi breadcrumb breadcrumbs "
    "header masthead topbar footer bottombar copyright legal disclaimer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist disqus respond replies reply discussion share sharing social follow related recommended recommendations more-links widget widgets toolbar pagination pager paging skip search searchbox form tags tagcloud rating outbrain taboola complementary contentinfo dialog".split()
)
#: Of these, such as call a block boilerplate as part of a longer name too; others have harmless meanings there (legal-news, related-work).
BAD_PARTS = frozenset("adverts advert advertisement advertising adsense sponsor sponsored sidebar sidebars menu menus nav navbar breadcrumb breadcrumbs masthead topbar footer bottombar gdpr popup modal newsletter comments commentlist disqus widget widgets toolbar pagination pager outbrain taboola".split())
#: Such as do so only where the rest of the name says nothing of its own (cookie-banner, ad-slot-2, but not cookie-recipe or ad-hoc).
BAD_WITH_PLAIN = frozenset("ad ads adv promo banner banners navigation cookie cookies comment notice notices consent".split())
PLAIN = frozenset("area bar block body bottom box center container content fixed footer global group header holder info inner item items layer left link links list main message middle module notification outer overlay page panel policy popup position primary right row secondary section site slot sticky strip text thread title top unit wrap wrapper zone".split())
#: Names of parts that an article has too: a block of such a name stays where it starts with a heading and goes on in prose.
SECTIONS = frozenset("copyright discussion disclaimer follow header legal navigation rating recommended recommendations related search share sharing skip social tags".split())
#: What readers wrote is called so, whatever the tag.
READERS = frozenset("comment comments commentlist disqus replies respond".split())
#: Tags whose names are judged: blocks that hold others. Headings, paragraphs and what stands in a line are not.
NAMED = CONTAINERS | frozenset("aside form nav header footer section address details summary hgroup center th caption fieldset menu".split())
GOOD_NAMES = frozenset("article content main post story entry body text page".split())
#: Opening one of these closes an open one of its kind: what may end it, and what it doesn't reach beyond.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Beside the best container a block with more than this share of linked text is boilerplate. A menu has at least so much of it, so many links at least, and shorter ones than so many characters in the mean.
LINKY, MENU_SHARE, MENU_LINKS, MENU_LINK = 0.5, 0.8, 3, 25
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("tag", "bad", "hidden", "kept", "name_score", "parent", "children", "score", "length", "linked", "links", "paragraphs", "commas")

    def __init__(self, tag: str, parent: Node | None, bad: str = "", hidden: bool = False, name_score: int = 0):
        self.tag, self.parent, self.bad, self.hidden, self.name_score = tag, parent, bad, hidden, name_score
        self.children: list[Node | str] = []
        self.score, self.kept = 0.0, False
        self.length = self.linked = self.links = self.paragraphs = self.commas = 0


def _bad_name(whole: str, parts: list[str]) -> str:
    """Which name calls a block boilerplate, if any does."""
    if whole in BAD_NAMES:
        return whole
    for p in parts:
        if p in BAD_PARTS or p in BAD_WITH_PLAIN and all(x in PLAIN or x in BAD_NAMES or x.isdigit() or not x for x in parts):
            return p
    return ""


def _names(raw: str) -> tuple[str, bool, int]:
    """The name that calls a tag boilerplate, whether it is hidden, and what its names add to its score."""
    bad, hidden, good = "", False, 0
    for m in _ATTR.finditer(raw):
        name = m[1].lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id", "role"):
            for whole in value.split():
                parts = re.split(r"[-_:]+", whole)
                if whole in GOOD_NAMES or parts[-1] in ("content", "body", "article", "text") and parts[0] not in BAD_NAMES:
                    good = 25
                elif found := _bad_name(whole, parts):
                    bad = found if bad not in READERS else bad
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
    return bad, hidden, good


def parse(page: str) -> Node:
    """A tree of the page that forgives unclosed and misplaced tags."""
    root = at = Node("html", None)
    pos, n = 0, len(page)
    opened: Counter[str] = Counter({"html": 1})  # by tag, so that no tag is looked for that isn't open

    def leave(node: Node, to: Node) -> Node:
        while node is not to:
            opened[node.tag] -= 1
            node = node.parent
        return to

    while pos < n:
        m = _TOKEN.search(page, pos)
        if m is None:
            at.children.append(page[pos:])
            break
        if m.start() > pos:
            at.children.append(page[pos : m.start()])
        pos = m.end()
        if m[1]:
            tag, node = m[1].lower(), at
            if opened[tag]:
                while node.tag != tag and (tag in BLOCK or node.tag not in BLOCK):  # an inline end tag does not close blocks
                    node = node.parent
            if node.tag == tag and node.parent is not None:
                at = leave(at, node.parent)
            elif tag == "br":
                at.children.append(Node("br", at))
        elif m[2]:
            tag = m[2].lower()
            if tag == "html":
                continue
            if tag in BLOCK and opened["p"]:  # a paragraph ends where a block begins, whatever inline tags are open in it
                node = at
                while node is not None and node.tag not in CONTAINERS and node.tag not in ("p", "button"):
                    node = node.parent
                if node is not None and node.tag == "p":
                    at = leave(at, node.parent)
            if tag in CLOSES and any(opened[x] for x in CLOSES[tag][0]):
                ends, stops = CLOSES[tag]
                node, last = at, None
                while node is not None and node.tag not in stops:
                    if node.tag in ends:
                        last = node
                    node = node.parent
                if last is not None and last.parent is not None:
                    at = leave(at, last.parent)
            if tag in ("body", "main", "article") and opened["head"]:  # a head left open ends here
                node = at
                while node.tag != "head":
                    node = node.parent
                at = leave(at, node.parent)
            child = Node(tag, at, *(_names(m[3]) if m[3] and not m[3].isspace() else ("", False, 0)))
            at.children.append(child)
            if tag in RAW and not (m[3] or "").endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, pos)
                child.children.append(page[pos : end.start() if end else n])
                pos = end.end() if end else n
            elif tag not in VOID and not ((m[3] or "").rstrip().endswith("/") and tag not in BLOCK):
                at = child
                opened[tag] += 1
    _keep_wrappers(root)
    return root


def _keep_wrappers(root: Node) -> None:
    """Marks what is not as its tag or name says: forms and fieldsets around more than half of the page's paragraphs, headers of articles that hold a heading, and sections of an article's own (SECTIONS)."""
    order, stack = [], [(root, False)]
    while stack:
        node, within = stack.pop()
        order.append(node)
        tags = [c.tag for c in node.children if isinstance(c, Node)]
        if node.tag == "header" and within:
            node.kept = any(t in HEADINGS or t == "hgroup" for t in tags)
        elif node.bad in SECTIONS and node.tag in ("section", "div"):
            node.kept = bool(tags) and tags[0] in HEADINGS and "p" in tags
        within = within or node.tag == "article"
        stack.extend((c, within) for c in node.children if isinstance(c, Node))
    if not any(node.tag in ("form", "fieldset") for node in order):
        return
    held: dict[int, int] = {}
    for node in reversed(order):
        size = sum(held[id(c)] for c in node.children if isinstance(c, Node))
        if node.tag == "p":
            size += sum(len(_SPACE.sub(" ", c)) for c in node.children if isinstance(c, str))
        held[id(node)] = size
    for node in order:
        node.kept = node.kept or node.tag in ("form", "fieldset") and not node.bad and 2 * held[id(node)] > held[id(root)]


def _clean(text: str) -> str:
    return _SPACE.sub(" ", html.unescape(text)).strip()


def _dropped(node: Node) -> bool:
    if node.tag in ("body", "html", "main"):
        return False
    if node.tag == "article":
        return node.bad in READERS or node.hidden
    return not node.kept and (node.tag in DROPPED or bool(node.bad) and node.tag in NAMED) or node.hidden


def _walk(root: Node) -> tuple[list[Node], list[Node]]:
    """Kept nodes in page order and, among them, those with text of their own kind: paragraphs, and containers with text right in them. Sets length, linked, links and paragraphs of all."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not _dropped(c))
    texts = []
    for node in reversed(order):
        own = sum(len(_SPACE.sub(" ", c).strip()) for c in node.children if isinstance(c, str))
        for c in node.children:
            if isinstance(c, Node) and not _dropped(c):
                own += c.length
                node.commas += c.commas
                node.linked += c.linked
                node.links += c.links
                node.paragraphs += c.paragraphs
        node.length = own
        node.commas += sum(c.count(",") for c in node.children if isinstance(c, str))
        node.paragraphs += node.tag in ("p", "pre", "blockquote") and own > 0
        if node.tag == "a":
            node.linked, node.links = own, int(own > 0)
    for node in order:
        if node.tag in PARAGRAPHS or node.tag in CONTAINERS and any(isinstance(c, str) and not c.isspace() for c in node.children):
            texts.append(node)
    return order, texts


def _density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def _menu(node: Node) -> bool:
    return node.links >= MENU_LINKS and node.linked >= MENU_SHARE * node.length and node.linked < MENU_LINK * node.links


def _beside(parent: Node, inner: set[int]) -> list[Node | str]:
    """The children of parent that are kept, in order: those in inner (by id), and what holds text and isn't boilerplate. Text right in parent is judged with the inline tags around it."""
    out: list[Node | str] = []
    run: list[Node | str] = []
    for c in [*parent.children, None]:
        if c is not None and (isinstance(c, str) or c.tag not in BLOCK and id(c) not in inner):
            if isinstance(c, str) or not _dropped(c):
                run.append(c)
            continue
        length = sum(len(_SPACE.sub(" ", x).strip()) if isinstance(x, str) else x.length for x in run)
        if length and sum(x.linked for x in run if isinstance(x, Node)) <= LINKY * length:
            out.extend(run)
        run = []
        if c is None or id(c) in inner:
            out.extend([c] if c is not None else [])
        elif not _dropped(c) and c.length and (c.tag in PARAGRAPHS and c.tag[0] == "h" or _density(c) <= LINKY or c.tag in ("ul", "ol", "dl") and not _menu(c)):
            out.append(c)
    return out


def best_containers(root: Node) -> list[Node | str]:
    """The best container and all kept with it, in page order; empty if the page has no text. What lies further out is kept from there on where it has paragraphs beside the container, as sections have."""
    order, texts = _walk(root)
    scored: list[Node] = []
    for node in texts:
        if node.tag in CONTAINERS and node.tag not in PARAGRAPHS:
            words = "".join(c for c in node.children if isinstance(c, str))
            size, commas, up = len(words.strip()), words.count(","), [node, node.parent]
        else:
            size, commas, up = node.length, node.commas, [node.parent, node.parent.parent if node.parent else None]
        if not size:
            continue
        points = 1 + commas + min(size / 100, 3 + size / 1000)
        for share, to in zip((1.0, 0.5), up, strict=True):
            if to is not None:
                to.score += points * share
                scored.append(to)
    if not scored:
        return [root] if root.length else []

    def final(node: Node) -> float:
        bonus = node.name_score + (25 if node.tag in ("article", "main") else 0)
        return (node.score + bonus) * (1 - _density(node))

    rank = {id(x): i for i, x in enumerate(order)}
    best = max({id(x): x for x in scored}.values(), key=lambda x: (final(x), -rank[id(x)]))
    if best.parent is None or best.tag in ("main", "body"):
        return [best]
    inner, levels, node = {id(best)}, [best.parent], best.parent
    while node.parent is not None and not _dropped(node):
        path = id(node)
        node = node.parent
        if any(isinstance(c, Node) and id(c) != path and c.paragraphs for c in _beside(node, {path})):
            while levels[-1] is not node:
                inner.add(id(levels[-1]))
                levels.append(levels[-1].parent)

    before, after = [], []
    for parent in levels:  # from the inside out
        kept = _beside(parent, inner)
        at = next(i for i, c in enumerate(kept) if id(c) in inner)
        before.append(kept[:at])
        after += kept[at + 1 :]
    return [c for part in reversed(before) for c in part] + [best] + after


def _headed(node: Node) -> bool:
    """Whether a list stands right under a heading."""
    before = None
    for c in node.parent.children:
        if c is node:
            break
        if isinstance(c, Node) or not c.isspace():
            before = c
    return node.tag in ("ul", "ol", "dl") and isinstance(before, Node) and before.tag in HEADINGS


def _blocks(node: Node, out: list[list[str]]) -> None:
    """Texts of the blocks under node: a block's own text ends where another block begins or ends."""
    stack: list[tuple[Node | str, bool]] = [(node, False)]
    while stack:
        x, left = stack.pop()
        if isinstance(x, str):
            out[-1].append(x)
        elif left:
            out.append([])
        elif x.tag == "br":
            out[-1].append(" ")
        elif not _dropped(x):
            if x.tag in BLOCK:
                if x.tag in ("ul", "ol", "dl", "table", "div", "section") and x is not node and x.length and _menu(x) and not _headed(x):
                    continue
                out.append([])
                stack.append((x, True))
            stack.extend((c, False) for c in reversed(x.children))


def main_text(page: str | None) -> str:
    """The article of a page: blocks in page order joined by two newlines; empty if there is none. Where names alone rule out all text, they are not heeded."""
    if not page:
        return ""
    root = parse(page)
    text = _text_of(root)
    if not text:
        stack, named = [root], False
        while stack:
            node = stack.pop()
            named |= bool(node.bad) or node.hidden
            node.bad, node.hidden, node.score, node.length, node.linked, node.links, node.paragraphs, node.commas = "", False, 0.0, 0, 0, 0, 0, 0
            stack.extend(c for c in node.children if isinstance(c, Node))
        text = _text_of(root) if named else ""
    return text


def _text_of(root: Node) -> str:
    out: list[list[str]] = [[]]
    for node in best_containers(root):
        inline = isinstance(node, str) or node.tag not in BLOCK and not node.paragraphs
        out.extend([] if inline else [[]])
        _blocks(node, out)
        out.extend([] if inline else [[]])
    return "\n\n".join(t for parts in out if parts and (t := _clean("".join(parts))))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each row's whole html, its code points counted.

    Null, empty and textless pages give an empty text and 0. Rows repeat as they do in pages, null ids
    and urls stay null; other columns are ignored, whatever their names; no rows in, none out. Long pages are
    read whole, in time about in proportion to their length. Of equally good containers the first in the page
    is taken. Broken markup never fails: open tags end with the page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_arrow(pages, run, "page_id long, url string, text string, n_chars long")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
