"""Block trees of web pages, and their alignment by simple tree matching.

A page becomes a tree of its block elements; the text between two block boundaries is a leaf. Markup that is broken
in the usual ways (unclosed or crossed elements, cut-off pages, stray brackets) gives a tree all the same, in time linear in the page.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import xxhash

# Elements of HTML by how they take part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split())
CLOSES_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: A start tag ends open elements of the second set, unless one of the third stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Furniture by element, by role and by the words of class and id.
FURNITURE = frozenset("head nav footer aside form script style noscript template button select option textarea iframe svg canvas object audio video map dialog menu fieldset search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist status tooltip".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup"
    " sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar pagination pager comment comments disqus replies reply respond discussion share sharing social related recommended"
    " recommendations popup modal overlay login paywall widget widgets skip hidden".split()
)
#: Names that make a header of a page's own, and those of a main region.
HEADS = frozenset({"header", "heading", "head"})
MAIN_NAMES = frozenset({"article", "articlebody", "post", "entry", "story", "content", "maincontent", "main", "postcontent", "entrycontent"})
#: Names such as "has-sidebar" tell of a layout.
LAYOUT = frozenset({"has", "with", "without", "no"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Elements that leave a head open, and those that an end tag of another kind doesn't reach across.
HEAD_PARTS = frozenset("meta link base title script style noscript template".split())
TABLE_PARTS = frozenset("table caption thead tbody tfoot tr td th".split())
SCOPES = frozenset({"table", "caption", "td", "th"})

#: Elements nest at most so deep; what is deeper stands beside its parent, as in browsers.
MOST_DEPTH = 256

_MARK = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^'">])*+)>""")
_LOOSE = re.compile(r"</?([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


@lru_cache(4096)
def _attributes(text: str) -> tuple[str, frozenset, bool]:
    """(the class that names the element, the words that describe it, whether it is hidden) of a tag's attributes."""
    found = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), references.unescape(next((x for x in m.groups()[1:] if x is not None), "")))
    names = f"{found.get('class', '')} {found.get('id', '')}"
    words = {w.lower() for w in _WORD.findall(names)} | {n.lower().replace("-", "").replace("_", "") for n in names.split()}
    role = found.get("role", "").lower()
    style = found.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
    if role in ROLES:
        words.add("notice")
    if role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody":
        words.add("articlebody")
    return " ".join(sorted(set(found.get("class", "").split()))), frozenset(words), hidden


class Node:
    """A block element or, with ``text``, a leaf. ``skip``: furniture by its own element, role or name."""

    __slots__ = ("children", "label", "linked", "main", "order", "print", "skip", "tag", "text")

    def __init__(self, tag: str, label: str, skip: bool = False, main: bool = False, text: str | None = None, linked: int = 0):
        self.tag, self.label, self.skip, self.main, self.text, self.linked = tag, label, skip, main, text, linked
        self.children: list[Node] = []
        self.print = b""
        self.order = 0


def _skips(tag: str, words: frozenset, hidden: bool, within_article: bool) -> bool:
    if tag in ("article", "main", "body", "html"):
        # an article may be a comment; the page's own is known by having no such name
        return hidden or bool(words & {"comment", "comments", "reply", "advert", "ad", "sponsored", "related", "teaser"})
    if tag == "header":
        return hidden or not within_article
    if words & LAYOUT:
        words = words & {"ad", "ads"}
    named = words & NAMES or (words & HEADS and not within_article and tag not in HEADINGS)
    # a heading, paragraph or emphasis isn't furniture for words like "comment" in a longer name
    return hidden or tag in FURNITURE or bool(named)


class _Builder:
    def __init__(self):
        self.root = Node("root", "root")
        self.stack = [self.root]
        self.inline: list[tuple[str, bool]] = []
        self.buffer: list[str] = []
        self.links = 0
        self.skipping = 0
        self.articles = 0
        self.deep: list[str] = []

    def add(self, raw: str) -> None:
        if raw and not self.skipping:
            self.buffer.append(references.unescape(raw) if "&" in raw else raw)
            if self.inline and any(t == "a" for t, _ in self.inline):
                self.links += len(raw)

    def flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            if text:
                if self.stack[-1].tag == "head":
                    self._leave()
                self.stack[-1].children.append(Node("#text", "#text", text=text, linked=min(self.links, len(text))))
            self.buffer, self.links = [], 0

    def _leave(self) -> None:
        node = self.stack.pop()
        if node.tag == "article":
            self.articles -= 1

    def close_to(self, wanted, bounds) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i].tag
            if tag in wanted:
                while len(self.stack) > i:
                    self._leave()
                return
            if tag in bounds:
                return

    def start(self, tag: str, rest: str) -> None:
        kind, words, hidden = _attributes(rest) if rest.strip(" /") else ("", frozenset(), False)
        if tag in INLINE:
            if tag in ("br", "wbr", "img"):
                self.buffer.append(" " if tag == "br" and not self.skipping else "")
                return
            skip = hidden or (tag in ("span", "small", "label", "a") and bool(words & NAMES))
            self.skipping += skip
            self.inline.append((tag, skip))
            return
        self.flush()
        if self.stack[-1].tag == "head" and tag not in HEAD_PARTS:
            self._leave()
        if tag in CLOSES_PARAGRAPH:
            self.close_to({"p"}, {"td", "th", "button", "table", "article", "aside", "section", "div", "li", "blockquote"})
        if tag in ENDS:
            self.close_to(*ENDS[tag])
        skip = self.skipping > 0 or _skips(tag, words, hidden, self.articles > 0)
        self.drop_inline()
        if tag in VOID:
            return
        node = Node(tag, f"{tag}.{kind}" if kind else tag, skip, tag in ("article", "main") or bool(words & MAIN_NAMES))
        self.stack[-1].children.append(node)
        if len(self.stack) < MOST_DEPTH:
            self.stack.append(node)
            self.articles += tag == "article"
        else:
            self.deep.append(tag)

    def drop_inline(self) -> None:
        """Inline elements end with their block."""
        for _, skip in self.inline:
            self.skipping -= skip
        self.inline = []

    def end(self, tag: str) -> None:
        if tag in INLINE:
            for i in range(len(self.inline) - 1, -1, -1):
                if self.inline[i][0] == tag:
                    self.skipping -= self.inline.pop(i)[1]
                    return
            return
        self.flush()
        self.drop_inline()
        if self.deep and self.deep[-1] == tag:
            self.deep.pop()
        elif tag not in ("body", "html"):
            self.close_to({tag}, () if tag in TABLE_PARTS else SCOPES | {"ul", "ol"} if tag == "li" else SCOPES)


def page_tree(page: str, prints: bool = True) -> Node:
    """The block tree of a page's whole HTML; ``prints``: as alignment needs them."""
    out, at, n = _Builder(), 0, len(page)
    last, quoted, endless = page.rfind(">"), True, set()
    while at < n:
        m = _MARK.search(page, at)
        if not m:
            out.add(page[at:])
            break
        if m.start() > at:
            out.add(page[at : m.start()])
            at = m.start()
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        if page[at + 1] in "!?":
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        if at > last:
            # a tag that the page's end cuts off
            break
        tag = _TAG.match(page, at) if quoted else None
        if not tag:
            # a quotation mark without its pair: from here on tags end at the next bracket
            quoted, tag = False, _LOOSE.match(page, at)
        if not tag:
            break
        at, name = tag.end(), tag[1].lower()
        if page[tag.start() + 1] == "/":
            out.end(name)
        elif name in RAW:
            end = None if name in endless else re.compile(f"</{name}", re.I).search(page, at)
            if not end:
                # left open: what is left of the page is a script's, but no other text is lost to it
                if name in ("script", "style"):
                    break
                endless.add(name)
                continue
            close = page.find(">", end.start())
            if name not in ("script", "style", "title"):
                out.flush()
            at = n if close < 0 else close + 1
        else:
            out.start(name, tag[2])
    out.flush()
    return _measured(out.root, prints)


def _measured(root: Node, prints: bool = True) -> Node:
    """Numbers nodes in page order and gives each subtree a print of its labels and texts."""
    todo, every = [root], []
    while todo:
        node = todo.pop()
        node.order = len(every)
        every.append(node)
        todo.extend(reversed(node.children))
    for node in reversed(every) if prints else ():
        node.print = printed(node.label if node.text is None else node.text, node.children)
    return root


def printed(own: str, children: list[Node]) -> bytes:
    """8 bytes that stand for a node's label (a leaf's text) and everything below it."""
    return xxhash.xxh3_64_digest(b"".join([own.encode("utf-8", "surrogatepass"), *(c.print for c in children)]))


class Matching:
    """Simple tree matching of a page with a reference: the order-keeping map of equal labels with the most matched nodes.

    A pair of equal texts counts three, so that of several ways the one that keeps texts wins.
    """

    #: Cells of one table of choices; larger ones are halved first (Hirschberg), which needs two rows.
    MOST_CELLS = 1 << 22

    def __init__(self):
        self.known: dict[tuple[bytes, bytes], int] = {}

    def weight(self, a: Node, b: Node) -> int:
        if a.label != b.label:
            return 0
        if a.text is not None:
            return 3 if a.print == b.print else 1
        if a.print == b.print:
            # alike throughout: every node matches itself
            return self._own(a)
        key = a.print, b.print
        if key not in self.known:
            self.known[key] = 1 + self._best(a.children, b.children)
        return self.known[key]

    def _own(self, a: Node) -> int:
        key = a.print, b""
        if key not in self.known:
            self.known[key] = 1 + sum(3 if c.text is not None else self._own(c) for c in a.children)
        return self.known[key]

    @staticmethod
    def _plain(nodes: list[Node]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Labels and texts of blocks that hold one text alone, as numbers (0 for other nodes), and the places of the other nodes."""
        labels, texts, odd = [], [], []
        for j, n in enumerate(nodes):
            leaf = n if n.text is not None else n.children[0] if len(n.children) == 1 and n.children[0].text is not None else None
            labels.append(_key(n.label) if leaf is not None else 0)
            texts.append(int.from_bytes(leaf.print, "little", signed=True) if leaf is not None else 0)
            if leaf is None:
                odd.append(j)
        return np.array(labels, np.int64), np.array(texts, np.int64), odd

    def _weights(self, xs: list[Node], ys: list[Node]) -> Iterator[np.ndarray]:
        """For each of ``xs`` its ``weight`` with all ``ys``: by arrays between blocks of one text, else by their trees."""
        (xl, xt, x_odd), (yl, yt, y_odd) = self._plain(xs), self._plain(ys)
        x_odd = set(x_odd)
        for i, x in enumerate(xs):
            if i in x_odd:
                out, rest = np.zeros(len(ys), np.int64), range(len(ys))
            else:
                same = yl == xl[i]
                out, rest = same * ((1 if x.text is not None else 2) + 2 * (yt == xt[i])), y_odd
            for j in rest:
                if ys[j].label == x.label:
                    out[j] = self.weight(x, ys[j])
            yield out

    def _rows(self, xs: list[Node], ys: list[Node]) -> Iterator[np.ndarray]:
        """The table of the largest weights row by row: all of ``xs`` so far with each beginning of ``ys``."""
        row = np.zeros(len(ys) + 1, np.int64)
        yield row
        for w in self._weights(xs, ys):
            new = row.copy()
            np.maximum(row[1:], row[:-1] + w, out=new[1:])
            row = np.maximum.accumulate(new)
            yield row

    def _last_row(self, xs: list[Node], ys: list[Node]) -> np.ndarray:
        for row in self._rows(xs, ys):
            pass
        return row

    def _best(self, xs: list[Node], ys: list[Node]) -> int:
        if not xs or not ys:
            return 0
        if len(xs) > len(ys):
            xs, ys = ys, xs
        return int(self._last_row(xs, ys)[-1])

    def pairs(self, xs: list[Node], ys: list[Node]) -> list[tuple[Node, Node]]:
        """The matched pairs of two lists of children."""
        if len(xs) == len(ys) == 1:
            return [(xs[0], ys[0])] if xs[0].label == ys[0].label else []
        out, lo, hi = [], 0, 0
        while lo < min(len(xs), len(ys)) and xs[lo].print == ys[lo].print and xs[lo].label == ys[lo].label:
            lo += 1
        while hi < min(len(xs), len(ys)) - lo and xs[-1 - hi].print == ys[-1 - hi].print and xs[-1 - hi].label == ys[-1 - hi].label:
            hi += 1
        out += list(zip(xs[:lo], ys[:lo], strict=True)) + list(zip(xs[len(xs) - hi :], ys[len(ys) - hi :], strict=True))
        xs, ys = xs[lo : len(xs) - hi], ys[lo : len(ys) - hi]
        if not xs or not ys:
            return out
        if len(xs) * len(ys) > self.MOST_CELLS and len(xs) > 1:
            mid = len(xs) // 2
            fore, back = self._last_row(xs[:mid], ys), self._last_row(xs[:mid - 1 : -1], ys[::-1])[::-1]
            cut = int(np.argmax(fore + back))
            return out + self.pairs(xs[:mid], ys[:cut]) + self.pairs(xs[mid:], ys[cut:])
        if len(xs) > len(ys):
            return out + [(x, y) for y, x in self.pairs(ys, xs)]
        rows = [r.tolist() for r in self._rows(xs, ys)]
        i, j = len(xs), len(ys)
        while i and j:
            if rows[i][j] == rows[i][j - 1]:
                j -= 1
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                out.append((xs[i - 1], ys[j - 1]))
                i, j = i - 1, j - 1
        return out

    def align(self, page: Node, reference: Node) -> dict[int, tuple[int, bool]]:
        """For the page's leaves that match: order -> (the reference leaf's order, whether their texts are equal)."""
        out, todo = {}, [(page, reference)]
        while todo:
            a, b = todo.pop()
            if a.text is not None:
                out[a.order] = (b.order, a.print == b.print)
            else:
                todo += self.pairs(a.children, b.children)
        return out


@lru_cache(4096)
def _key(x: str | bytes) -> int:
    """A label or print as a number above 0, for arrays."""
    raw = x if isinstance(x, bytes) else xxhash.xxh3_64_digest(x.encode("utf-8", "surrogatepass"))
    return int.from_bytes(raw, "little", signed=True) or 1
