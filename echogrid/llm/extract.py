"""Main text of web pages by composite text density."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from echogrid.llm.tables import pieces, strings

#: Fixed HTML vocabulary.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An opening tag ends an open one of these, up to the nearest of the second set.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
            "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SKIPPED = frozenset("head title script style noscript template nav footer aside button select textarea input iframe svg canvas object embed audio video dialog menu".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id that name page furniture.
FURNITURE = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead topbar banner cookie cookies consent gdpr notice alert popup modal overlay ad ads advert adverts "
    "advertisement advertising sponsor sponsored promo promotion comment comments disqus respond reply replies discussion share sharing social related recommended newsletter subscribe "
    "subscription signup login search pagination pager widget toolbar skip".split())
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Words that name the head of an article as well as that of a page.
HEADS = frozenset("header masthead topbar".split())
SPACE = re.compile(r"\s+")
#: Marks that end a sentence.
ENDS = ".!?。！？…"


class _Node:
    __slots__ = ("tag", "parent", "children", "chars", "tags", "link_chars", "link_tags", "own", "density", "total", "named", "depth", "anchor", "in_article", "block", "open_inline", "label")

    def __init__(self, tag: str, parent: _Node | None):
        self.tag, self.parent, self.children = tag, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = self.own = 0
        self.density = self.total = 0.0
        #: Is it, or does it lie in, an article or main element without a named element between?
        self.named, self.anchor = False, tag == "main" or parent is not None and parent.anchor
        #: Named elements around this one, itself included; is it in an article or main element, itself included?
        self.depth = parent.depth if parent else 0
        self.in_article = tag in ("article", "main") or parent is not None and parent.in_article
        #: The nearest block, itself if it is one, and the inline elements that are open in a block.
        self.block = parent.block if parent is not None and tag in INLINE else self
        self.open_inline: dict[str, int] = {}
        self.label: str | None = None


def _furniture(tag: str, attributes: dict[str, str | None], in_article: bool) -> bool:
    """Is the element furniture by its tag, role or style, whatever it holds?"""
    if tag in SKIPPED or tag == "header" and not in_article or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    return attributes.get("role") in SKIPPED_ROLES or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style") or ""))


def _named(tag: str, attributes: dict[str, str | None], in_article: bool) -> bool:
    """Is it a form, or named like furniture? The head of an article is not, and html, body and main never are."""
    if tag in ("html", "body", "main"):
        return False
    if tag == "form" or attributes.get("role") == "form":
        return True
    said = {w.lower() for w in NAME_WORD.findall(f"{attributes.get('class') or ''} {attributes.get('id') or ''}")} & FURNITURE
    return bool(said - HEADS if in_article else said)


class _Dom(HTMLParser):
    """Tree of the elements that are not page furniture by tag, role or style; text lies in `children` beside the elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("html", None)
        self.at, self.open_hidden, self.hidden_tags, self.open_tags = self.root, [], Counter(), Counter()

    def _close(self, node: _Node) -> None:
        """Ends `node` and all that is open in it."""
        while self.at is not node.parent:
            self.open_tags[self.at.tag] -= 1
            if self.at.block is not self.at:
                self.at.block.open_inline[self.at.tag] -= 1
            self.at = self.at.parent

    def _end_open(self, tags: set[str] | frozenset[str], until: set[str] | frozenset[str]) -> None:
        if not any(self.open_tags[t] for t in tags):
            return
        node = self.at
        while node.parent is not None and node.tag not in until:
            if node.tag in tags:
                self._close(node)
                return
            node = node.parent

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.open_hidden:
            if tag not in VOID:
                if tag in SIBLINGS and self.hidden_tags[tag] and self.open_hidden[-1] in SIBLINGS[tag][0]:
                    self.hidden_tags[self.open_hidden.pop()] -= 1
                self.open_hidden.append(tag)
                self.hidden_tags[tag] += 1
            return
        if tag in ("html", "body"):
            return
        if tag in CLOSES_P:
            self._end_open({"p"}, {"td", "th", "li", "div", "article", "section", "main", "blockquote"} - {tag} | {"table"})
        if tag in SIBLINGS:
            self._end_open(*SIBLINGS[tag])
        if tag == "br":
            self.at.children.append("\n")
        if tag in VOID:
            return
        attributes = dict(attrs)
        if _furniture(tag, attributes, self.at.in_article):
            self.at.children.append("\n")
            self.open_hidden.append(tag)
            self.hidden_tags[tag] += 1
            return
        node = _Node(tag, self.at)
        node.named = _named(tag, attributes, self.at.in_article)
        node.depth, node.label = node.depth + node.named, attributes.get("class")
        node.anchor = not node.named and (node.anchor or tag == "article" or attributes.get("role") == "main" or attributes.get("itemprop") == "articleBody")
        self.at.children.append(node)
        self.at = node
        self.open_tags[tag] += 1
        if node.block is not node:
            node.block.open_inline[tag] = node.block.open_inline.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.open_hidden:
            if self.hidden_tags[tag]:
                last = ""
                while last != tag:
                    last = self.open_hidden.pop()
                    self.hidden_tags[last] -= 1
                return
            if tag not in ("article", "main", "body", "html"):
                return
            self.open_hidden.clear()  # furniture left open ends with the part of the page around it
            self.hidden_tags.clear()
        if not self.open_tags[tag] or tag in INLINE and not self.at.block.open_inline.get(tag):
            return
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self._close(node)
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        if not self.open_hidden:
            self.at.children.append(data)


def _order(root: _Node) -> list[_Node]:
    """All nodes, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in node.children if isinstance(c, _Node))
    return out


def _measure(root: _Node) -> list[_Node]:
    nodes = _order(root)
    for node in reversed(nodes):
        node.own = sum(len(SPACE.sub(" ", c).strip()) for c in node.children if isinstance(c, str))
        kids = [c for c in node.children if isinstance(c, _Node)]
        node.chars = node.own + sum(k.chars for k in kids)
        node.tags = sum(k.tags + 1 for k in kids)
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        else:
            node.link_chars, node.link_tags = sum(k.link_chars for k in kids), sum(k.link_tags for k in kids)
    chars, links = max(root.chars, 1), root.link_chars
    for node in nodes:
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        plain = max(c - node.link_chars, 1)
        base = math.log(c / plain * lc + links / chars * c + math.e)
        ratio = max(c / lc * t / lt, 1.0)
        node.density = c / t * math.log(ratio) / base if c else 0.0
    for node in nodes:
        # text beside the children weighs as a child without tags
        node.total = sum(k.density for k in node.children if isinstance(k, _Node) and k.tag not in INLINE) + (node.own if node.own else 0)
    return nodes


def _core_depth(nodes: list[_Node]) -> int:
    """How many named elements lie around the article.

    The article is looked for in the parts of the page with the fewest named elements around them: first where an article or
    main element has text of its own depth, then where a sentence stands, then where there is text at all. How much text the
    named elements hold plays no part.
    """
    anchored, spoken, marked, any_ = [], [], [], []
    for node in nodes:
        if node.tag in INLINE:
            continue
        said = _plain(node)
        if not said:
            continue
        any_.append(node.depth)
        if node.in_article:
            marked.append(node.depth)
        if said.count(" ", 0, max(map(said.rfind, ENDS)) + 1) >= 4:  # five words and the end of a sentence
            spoken.append(node.depth)
        if node.anchor:
            anchored.append(node.depth)
    return min(anchored or spoken or marked or any_ or [0])


def _plain(block: _Node) -> str:
    """Text of a block outside links and outside blocks inside it."""
    out, stack = [], list(reversed(block.children))
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
        elif item.tag in INLINE and item.tag != "a" and not item.named:
            stack.extend(reversed(item.children))
    return SPACE.sub(" ", "".join(out)).strip()


def _without_furniture(root: _Node) -> list[_Node]:
    """Drop every named element that is not around the article, and measure what is left.

    Named elements around the article (a page-wide form, a wrapper called `has-sidebar`) stay; those beside or inside it go,
    whatever they hold. Of several wrappers of the same depth, those around the densest block stay, and their equals beside them.
    """
    nodes = _measure(root)
    if not any(n.named for n in nodes):
        return nodes
    depth = _core_depth(nodes)
    here = [n for n in nodes if n.depth == depth and n.tag not in INLINE]
    best = max(here, key=lambda n: (sum(k.density for k in n.children if isinstance(k, _Node) and k.tag not in INLINE and not k.named) + n.own), default=root)
    around: set[int] = set()
    above: _Node | None = best
    while above is not None:
        around.add(id(above))
        if above.named and above.parent is not None:  # a list of articles: equal elements side by side
            around |= {id(c) for c in above.parent.children if isinstance(c, _Node) and (c.tag, c.label) == (above.tag, above.label)}
        above = above.parent
    stack = [root]
    while stack:
        node = stack.pop()
        node.children = ["\n" if isinstance(c, _Node) and c.named and id(c) not in around else c for c in node.children]
        stack.extend(c for c in node.children if isinstance(c, _Node))
    return _measure(root)


def _text(roots: list[_Node]) -> str:
    out: list[str] = []
    for root in roots:
        stack: list = [root]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                out.append(item)
                continue
            edge = [] if item.tag in INLINE else ["\n"]
            stack.extend(edge)
            stack.extend(reversed(item.children))
            stack.extend(edge)
        out.append("\n")
    return SPACE.sub(" ", "".join(out)).strip()


def main_text(html: str) -> str:
    """Text of the subtree with the largest density sum, joined by the siblings on its way to the body that are as dense.

    The threshold is the least density on the path from that subtree to the body. An article around the subtree, or else a main
    element, stands in its place with all it holds; the siblings on its way to the body, other articles too, are held against the
    threshold like any. Menus, footers, scripts and hidden parts are left out while the tree is built; forms and elements with
    furniture words in class or id go unless the article lies in them. Time grows with the page, not with its nesting.
    """
    dom = _Dom()
    dom.feed(html)
    dom.close()
    nodes = _without_furniture(dom.root)
    blocks = [n for n in nodes if n.tag not in INLINE] or nodes
    best = max(blocks, key=lambda n: n.total)
    if not best.chars:
        return ""
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    whole = next((n for n in reversed(path) if n.tag == "article"), None) or next((n for n in path if n.tag == "main"), None)
    if whole is not None:
        best, path = whole, path[path.index(whole):]
    threshold = min(n.density for n in path)
    roots, chosen, on_path = {id(best)}, [best], {id(n) for n in path}
    for node in path[1:]:
        for kid in node.children:
            if isinstance(kid, _Node) and id(kid) not in roots and id(kid) not in on_path and kid.tag not in INLINE and kid.density >= threshold and kid.chars:
                roots.add(id(kid))
                chosen.append(kid)
    place = {id(n): k for k, n in enumerate(_page_order(dom.root))}
    return _text(sorted(chosen, key=lambda n: place[id(n)]))


def _page_order(root: _Node) -> list[_Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed([c for c in node.children if isinstance(c, _Node)]))
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "html", 4_000_000):
        texts = [main_text(h) for h in strings(piece, "html")]
        yield pa.RecordBatch.from_arrays(
            [piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages` (page_id, url, html). Null and empty html give an empty text.

    Pages are independent rows: repeated rows, null ids and null urls pass through, and nothing is shuffled.
    """
    return pages.selectExpr("cast(page_id as long) as page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
