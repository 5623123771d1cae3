"""Operator 9: main text of HTML pages by tree scoring.

Every paragraph earns points for its length and commas, discounted by its
share of link text, and passes them to its ancestors; the best container and
those of its siblings that score well too, or are text of few links, are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from punctual.llm.common import steps, strings

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Never part of the main text, with all they hold.
DROPPED = frozenset("script style noscript template nav footer aside button select textarea iframe object svg canvas "
                    "head title menu dialog audio video map datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd dt th figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class or id that hint at something beside the article, and endings that such a word may be written together with.
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent "
                        "disqus footer header masthead menu modal nav navbar navigation newsletter notice pagination popup "
                        "promo promotion related replies reply respond share sharing sidebar social sponsor sponsored subscribe "
                        "toolbar widget".split())
# Those of them that also stand for plain text: a block so named is one only if it holds links.
LINK_WORDS = frozenset("share sharing social widget".split())
ENDINGS = re.compile("(area|bar|block|box|container|form|item|items|links|list|section|thread|wrap|wrapper)\\Z")
# A name made of the first only, or with one of the second, is no such hint.
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
STATE_WORDS = frozenset("disabled enabled has no with without".split())
# The text of a hinted block counts by this factor, and for the best container only if there is no other text.
DOUBT = 0.25
# A hinted block with this share of all unlinked text wraps the page.
NEARLY_ALL = 0.9
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
KEPT_ROOTS = frozenset(("article", "main", "body", "html"))
# A start tag of the first closes an open one of the second, up to the nearest of the third.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
          "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
          "option": (("option",), ("select",))}
# A paragraph or heading is not closed from inside one of these.
SCOPES = frozenset("table td th li blockquote div article section main body button".split())
# Points of a sibling that is kept for them, and its least share of the best container's.
SIBLING_POINTS, SIBLING_SHARE = 10.0, 0.2
# Any other is kept if less than this share is links and it is longer than so many characters, or unlinked and a sentence.
SIBLING_LINKS, SIBLING_CHARS = 0.25, 80
SENTENCE = re.compile(r"[.!?\u2026\u3002\uff01\uff1f][\"'\u2019\u201d\u00bb)\]]*\Z")
CUT_TAG = re.compile(r"<[a-zA-Z/!][^<>]*\Z")
SPLIT_WORDS = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("tag", "aside", "parent", "children", "points", "main", "hint", "off", "linked", "plain", "mains", "links", "weak", "doubt", "open", "headed")

    def __init__(self, tag: str, parent: Node | None, aside: bool = False, main: bool = False, hint: bool = False):
        self.tag, self.parent, self.aside, self.main, self.hint = tag, parent, aside, main, hint
        # The outermost paragraph, and paragraph or heading, that a new block here would close.
        inherit = parent is not None and tag not in SCOPES
        self.open = parent.open if inherit and parent.open is not None else self if tag == "p" else None
        self.headed = parent.headed if inherit and parent.headed is not None else self if tag == "p" or tag in HEADINGS else None
        self.children: list[Node | str] = []
        self.points = 0.0
        self.off = aside or parent is not None and parent.off
        self.linked = tag == "a" or parent is not None and parent.linked
        self.plain = self.mains = self.links = 0  # unlinked characters; elements marked as main text that hold any; links
        self.doubt = self.weak = False


def hints(names: str) -> set[str]:
    """Words of class and id that hint at something beside the article."""
    out: set[str] = set()
    for name in names.lower().split():
        words = set(SPLIT_WORDS.split(name)) - {""}
        if words.isdisjoint(STATE_WORDS):
            found = (words | {ENDINGS.sub("", w) for w in words}) & ASIDE_WORDS
            # An entry-header heads the entry, a story-widget is part of the story.
            out |= found - {"header", "widget"} if words & CONTENT_WORDS else found
        if words and words <= CONTENT_WORDS:
            return set()
    return out


class Tree(HTMLParser):
    """Tolerant tree: paragraphs and list items end where the next begins, open tags at the end of their parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None)
        self.nodes = [self.root]  # parents before children

    def _close(self, tags, until) -> None:
        node, target = self.at, None
        while node.parent is not None and node.tag not in until:
            if node.tag in tags:
                target = node
            node = node.parent
        if target is not None:
            self.at = target.parent

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag not in INLINE:
            left = self.at.headed if tag in HEADINGS or tag in KEPT_ROOTS else self.at.open
            if left is not None:
                self.at = left.parent
        a = {k: v or "" for k, v in attrs}
        names = f"{a.get('class', '')} {a.get('id', '')}"
        main = tag in ("article", "main") or a.get("role") == "main"
        aside = tag in DROPPED or "hidden" in a or a.get("aria-hidden") == "true" or a.get("role") in ASIDE_ROLES
        aside |= tag == "article" and not {"comment", "comments", "reply"}.isdisjoint(SPLIT_WORDS.split(names.lower()))
        found = hints(names) if names != " " and not main and tag not in KEPT_ROOTS else set()
        if found == {"header"} or tag == "header" and found <= {"header"}:  # the page's, unless it heads the article
            found = set() if inside_main(self.at) else found
        hint = bool(found) or tag == "form"
        if tag == "header" and not hint and inside_main(self.at) is None:
            hint = CONTENT_WORDS.isdisjoint(SPLIT_WORDS.split(names.lower()))
        node = Node(tag, self.at, aside, main, hint)
        node.weak = bool(found) and found <= LINK_WORDS
        self.nodes.append(node)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and self.at.parent is not None:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            if tag in INLINE and node.tag not in INLINE:
                return  # a stray inline end tag closes no block
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        if data:
            self.at.children.append(data)
            if not self.at.off and not self.at.linked:
                self.at.plain += len(" ".join(data.split()))

    def settle(self) -> None:
        """Doubt the hinted blocks, but not one with the main text of the page.

        That is the elements so marked, or if there are none nearly all unlinked text.
        """
        for n in reversed(self.nodes):
            n.mains += n.main and not n.off and n.plain > 0
            if n.parent is not None:
                n.parent.plain += n.plain
                n.parent.mains += n.mains
                n.parent.links += n.links + (n.tag == "a")
        mains, plain = self.root.mains, self.root.plain
        for n in self.nodes:
            if n.hint and not n.off and not (n.weak and not n.links) and not (n.mains == mains if mains else n.plain >= NEARLY_ALL * plain):
                n.doubt = True
            else:
                n.hint = False
            n.doubt |= n.parent is not None and n.parent.doubt

    def leave_hinted(self, best: Node) -> None:
        """Leave out every hinted block, however long, that ``best`` does not lie in."""
        above = set()
        node: Node | None = best
        while node is not None:
            above.add(id(node))
            node = node.parent
        for n in self.nodes:
            if n.hint and id(n) not in above:
                n.aside = True


def inside_main(node: Node | None) -> Node | None:
    """The nearest of ``node`` and its ancestors that is marked as main text."""
    while node is not None and not node.main:
        node = node.parent
    return node


class Run:
    """Text of one block between its inner blocks."""

    __slots__ = ("node", "parts", "linked")

    def __init__(self, node: Node):
        self.node, self.parts, self.linked = node, [], 0

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def runs(top: Node) -> list[Run]:
    """Non-empty blocks under ``top`` in page order, asides left out (walked by a stack: trees can be deep)."""
    out, current = [], Run(top)
    stack: list[tuple] = [("open", top, top, False)]
    while stack:
        what, node, block, linked = stack.pop()
        if what == "text":
            if current.node is not block:
                out.append(current)
                current = Run(block)
            current.parts.append(node)
            current.linked += len(node) if linked else 0
            continue
        if what == "edge":
            out.append(current)
            current = Run(block)
            continue
        if node.aside and node is not top:
            continue
        if node.tag == "br":
            stack.append(("text", " ", block, linked))
            continue
        inner = node.tag in INLINE and node is not top
        here = block if inner else node
        if not inner:
            out.append(current)
            current = Run(here)
            stack.append(("edge", None, block, linked))
        for c in reversed(node.children):
            stack.append(("text", c, here, linked or node.tag == "a") if isinstance(c, str) else
                         ("open", c, here, linked or node.tag == "a"))
    out.append(current)
    return [r for r in out if r.text]


def worth(r: Run) -> float:
    points = (1 + r.text.count(",") + len(r.text) / 100) * max(0.0, 1 - r.linked / max(1, len("".join(r.parts))))
    return points * DOUBT if r.node.doubt else points


def score(blocks: list[Run]) -> list[Node]:
    """Give points to the containers of ``blocks``; returns the containers in page order."""
    touched: dict[int, Node] = {}
    for r in blocks:
        if r.node.tag in HEADINGS:
            continue
        points = worth(r)
        node = r.node.parent if r.node.tag in PARAGRAPHS and r.node.parent is not None else r.node
        level = 0
        while node is not None and points > 0:
            node.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            touched.setdefault(id(node), node)
            node, level = node.parent, level + 1
    return list(touched.values())


def siblings(best: Node) -> list[Node]:
    """Blocks beside ``best`` and itself in page order; text and inline elements in a row make one block."""
    out: list[Node] = []
    loose = None
    for c in best.parent.children:
        if isinstance(c, str) or c is not best and c.tag in INLINE:
            if loose is None:
                loose = Node("p", best.parent)
                loose.doubt = best.parent.doubt
                out.append(loose)
            loose.children.append(c)
        else:
            out.append(c)
            loose = None
    return out


def belongs(blocks: list[Run], least: float) -> bool:
    """Whether the text of a sibling goes with the best container's."""
    rated = [r for r in blocks if r.node.tag not in HEADINGS]
    if sum(map(worth, rated)) >= least:
        return True
    if all(r.node.doubt for r in blocks):
        return False
    linked, length = sum(r.linked for r in blocks), sum(len("".join(r.parts)) for r in blocks)
    if sum(len(r.text) for r in blocks) > SIBLING_CHARS:
        return linked < SIBLING_LINKS * length
    return not linked and SENTENCE.search(blocks[-1].text) is not None


def with_siblings(best: Node) -> list[Run]:
    """Blocks of ``best`` and of the siblings that belong to it.

    Beside an element that is marked as main text only others so marked
    count, unless all lie in one more.  A heading goes with what follows it.
    """
    least = max(SIBLING_POINTS, SIBLING_SHARE * best.points)
    free = not best.main or inside_main(best.parent) is not None
    found = []  # (blocks, level if only headings, kept)
    for c in siblings(best):
        if c is not best and (c.aside or not (free or c.main)):
            continue
        blocks = runs(c)
        if blocks:
            level = None if c is best or any(r.node.tag not in HEADINGS for r in blocks) else min(int(r.node.tag[1]) for r in blocks)
            found.append((blocks, level, c is best or level is None and belongs(blocks, least)))
    out = []
    for i, (blocks, level, kept) in enumerate(found):
        if level is not None and sum(r.linked for r in blocks) < SIBLING_LINKS * sum(len("".join(r.parts)) for r in blocks):
            left = False
            for _, other, kept in found[i + 1:]:
                if kept or other is not None and left and other <= level:
                    break
                left |= other is None
        if kept:
            out += blocks
    return out


def extract(html: str | None) -> str:
    """Main text of a page; blocks joined by two line feeds, empty if there is none."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(CUT_TAG.sub("", html))  # a page may break off inside a tag
    tree.close()
    tree.settle()
    blocks = runs(tree.root)
    containers = score([r for r in blocks if not r.node.doubt]) or score(blocks)
    if not containers:
        return ""
    best = max(containers, key=lambda n: n.points)
    best = inside_main(best) or best
    tree.leave_hinted(best)
    return "\n\n".join(r.text for r in (runs(best) if best.parent is None else with_siblings(best)))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Null html is empty and gives empty text; null ids or urls, repeated rows
    and broken markup are kept as they are; pages of any length and depth are
    read whole; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "html"):
            texts = [extract(h) for h in strings(b, "html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
