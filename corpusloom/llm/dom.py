"""A small, tolerant HTML reader: block trees with their text, for wrapper induction.

Inline markup is folded into the text of the block around it; every run of text directly inside a block
that also has block children is a leaf of its own. Scripts, styles and the like are dropped while reading.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
#: Every attribute with its value, so that words inside a value are no attributes.
_ATTR = re.compile(r"([^\s\"'<>/=]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPLIT = re.compile(r"[^a-z0-9]+")
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas select button datalist audio video".split())
#: Raw elements that run to the end of the page if nothing closes them; of the others only the tag goes then.
_OPEN_ENDED = frozenset("script style textarea title".split())
BLOCK = frozenset(
    "html head body main article section nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset details summary address hr dialog menu center search".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the first kind ends where one of the second begins.
_P_ENDS = BLOCK - frozenset("html head body tr td th thead tbody tfoot caption dt dd li".split())
_ENDS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "p": _P_ENDS}
_SCOPE = frozenset("ul ol dl table div section article main body nav aside header footer form blockquote".split())


#: A marked word counts after one of these too: site-footer, left-sidebar.
_PLACES = frozenset("site page main global top bottom left right primary secondary post article entry".split())
#: In `words` for a hidden attribute; no class can have this name.
HIDDEN = "[hidden]"


def names(value: str) -> Iterator[str]:
    """Whole names in a class, id or role, and the leading piece of those of several pieces.

    Other pieces say what stands beside a block or how it looks (no-sidebar, post-with-comments, overflow-hidden).
    """
    for name in value.lower().strip("\"'").split():
        pieces = [w for w in _SPLIT.split(name) if w]
        if len(pieces) == 1:
            yield pieces[0]
        elif pieces:
            if pieces[0] != "hidden":  # hidden-xs: hidden on some screens only
                yield pieces[0]
            if len(pieces) == 2 and pieces[0] in _PLACES and pieces[1] != "hidden":
                yield pieces[1]


class Node:
    """An element or a run of text; slot: its place in a frame, same: its text is the frame's, links: characters in links."""

    __slots__ = ("tag", "words", "kids", "text", "slot", "same", "links")

    def __init__(self, tag: str, words: frozenset | None = None):
        self.tag, self.words, self.kids, self.text, self.slot, self.same, self.links = tag, words, [], "", -1, False, 0

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.kids))


def parse(page: str) -> Node:
    """The block tree of a page; the root is always `html`."""
    root = Node("html")
    stack, buffer, at, n = [root], [], 0, len(page)
    lower = None
    in_link, linked = False, 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = "".join(buffer)
            buffer.clear()
            text = " ".join((_html.unescape(text) if "&" in text else text).split())
            if text:
                leaf = Node("#text")
                leaf.text, leaf.links = text, min(linked, len(text))
                stack[-1].kids.append(leaf)
            linked = 0

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            buffer.append(page[at:])
            break
        if lt > at:
            buffer.append(page[at:lt])
            if in_link:
                linked += lt - at
        m = _TAG.match(page, lt)
        if not m:
            buffer.append("<")
            at = lt + 1
            continue
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name == "a":
            in_link = not m[1]
            continue
        if m[1]:
            if name in BLOCK:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == name:
                        flush()
                        del stack[k:]
                        break
                else:
                    flush()
            continue
        if name in RAW:
            buffer.append(" ")
            if m[3].endswith("/") and name not in _OPEN_ENDED:
                continue
            if lower is None:
                lower = page.lower()
            end = lower.find("</" + name, at)
            close = page.find(">", end) if end >= 0 else -1
            if close >= 0:
                at = close + 1
            elif name in _OPEN_ENDED:
                at = n
            continue
        if name == "br":
            buffer.append(" ")
            continue
        attrs = m[3] if name in BLOCK else ""
        words = None
        if attrs and ("=" in attrs or "hidden" in attrs):
            got = _ATTR.findall(attrs)
            if got:
                found = [w for key, value in got if key.lower() in ("class", "id", "role") for w in names(value)]
                if any(key.lower() == "hidden" or key.lower() == "aria-hidden" and "true" in value.lower() for key, value in got):
                    found.append(HIDDEN)
                words = frozenset(found) or None
        if name not in BLOCK:
            continue
        flush()
        for k in range(len(stack) - 1, 0, -1):
            t = stack[k].tag
            if t in _ENDS and name in _ENDS[t]:
                del stack[k:]
                break
            if t in _SCOPE:
                break
        if name in ("html", "body", "head") and any(x.tag == name for x in stack):
            continue
        node = Node(name, words)
        stack[-1].kids.append(node)
        if name not in VOID:
            stack.append(node)
    flush()
    return root


#: What elements hold that aren't part of an article, by tag and by words of class, id and role.
DROPPED_TAGS = frozenset("head nav footer aside form dialog menu fieldset search".split())
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar footer masthead contentinfo complementary hidden "
    "comment comments commentlist disqus replies reply respond related recommended recommendations share sharing social newsletter subscribe subscription signup login widget widgets copyright skip".split()
)
COMMENTS = frozenset("comment comments commentlist disqus replies reply".split())


def text_size(n: Node) -> int:
    return sum(len(k.text) for k in n.walk())


def wrappers(root: Node) -> tuple[set[int], set[int]]:
    """Ids of blocks that hold the page's main element or article, and of those that hold any article (comments aside).

    The page's article has over half of the text of all articles, and half of the main element's text if there is one.
    """
    above: dict[int, Node] = {}
    mains, articles = [], []
    for n in root.walk():
        for k in n.kids:
            above[id(k)] = n
        if n.tag == "main":
            mains.append(n)
        elif n.tag == "article" and not (n.words and n.words & COMMENTS):
            articles.append(n)

    def up(nodes: list[Node]) -> set[int]:
        out: set[int] = set()
        for n in nodes:
            while id(n) in above:
                n = above[id(n)]
                out.add(id(n))
        return out

    own = list(mains)
    if articles:
        outer, every = up(articles), {id(n) for n in articles}
        apart = [n for n in articles if not up([n]) & every]  # not those inside another
        sizes = [text_size(n) for n in apart]
        best, most = apart[sizes.index(max(sizes))], max(sizes)
        if 2 * most > sum(sizes) and all(2 * most >= text_size(m) for m in mains):
            own.append(best)
    else:
        outer = set()
    return up(own), outer | up(mains)


def dropped(n: Node, inside: bool, holds: frozenset[int] | set[int] = frozenset()) -> bool:
    """Whether a block and all in it is no part of an article; inside: it stands in an article or main element.

    holds: ids of blocks that no class, id or role drops, as they hold the article.
    """
    if n.tag in DROPPED_TAGS or n.tag == "header" and not inside:
        return True
    if n.words is None or n.tag in ("html", "body"):
        return False
    if HIDDEN in n.words:
        return True
    if id(n) in holds:
        return False
    if n.tag in ("article", "main"):
        return bool(n.words & COMMENTS)
    return bool(n.words & MARKED) or not inside and "header" in n.words
