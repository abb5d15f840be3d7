"""HTML extraction by wrapper induction: trees of same-host pages are aligned, constant nodes become template.

Pages of a host are told apart by layout (the shape of their outer containers). Each layout of more than PAGES
different pages has a frame page (the one with the least hash, empty pages aside); rarer ones share the frame of
that layout over all hosts, or go with the host's most frequent one. Every page's block tree is aligned with its frame's by
simple tree matching (roots of equal tags; children in order, by dynamic programming over match sizes), so that a node
gets the number of a slot of the frame. Pages vote: a slot is template where at least CONSTANT of the voting pages (and at
least PAGES) that have it hold the frame's text. Copies of the frame have no vote, so that an article crawled several times
isn't taken for template. They are told by the varying part: slots that hold the frame's text in CONSTANT of the
different patterns of equal slots are set aside, and a copy shares half of the frame's other text. If the
frame has no other text (under VARYING characters), all pages of the layout are copies of one.

The wrapper then finds the slot that holds the article: from the root down, always the block with REGION of the
varying text that all pages have there. Text comes from that region and from headings and paragraphs beside it on the way
down, whatever the elements are called. In the region, template goes, blocks of links go (over half of
their varying text is in links), and parts that vary but aren't the article (comments, adverts, notices, forms, menus) go by element
or by whole class names, as varying text can't tell them. If the region holds article or main elements, the text comes
from these. Pages without a wrapper (no layout of so many pages, or copies only) are read by element and class roles alone.

Patterns, votes and characters are summed per task and then by wrapper and slot, so a hot host has no task of its own;
frames and wrappers have at most one page's tree a layout and are joined by key (broadcast if their counted size allows,
else dealt, a hot host's pages by AQE's skew split). Lists of children of any length are matched whole: subtrees of equal tags are told by number (Shapes), so
that each pair of different ones is matched once, equal beginnings pass without a table, and tables of long lists keep some rows only.

Output: text (blocks in page order, joined by one newline; white space in a block is one blank; line breaks are
white space) and n_chars. Cases: null or empty html gives an empty text; a url without a host is a host of
its own (empty); repeated pages and copies are extracted alike; broken or cut markup is read as far as it goes; deep nesting
takes time in proportion to the nodes, two long lists of children that differ from their beginnings on the product of their lengths; input columns may have any names, `text` and `n_chars` are replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections import Counter
from itertools import product
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.arrowmap import append, field
from corpusloom.llm.dom import Node, dropped, parse, wrappers
from corpusloom.llm.shared import lookup, small_side, stash

CONSTANT = 0.8
PAGES = 4
#: A frame with less text outside of its constant slots differs from its copies by dates and the like only.
VARYING = 20
#: Share of a block's varying text that one child has if the article is in it.
REGION = 0.6
#: Blocks of text: never gone into in search of the article.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd figure figcaption address caption #text".split())
#: Lists of children from which on rows of a table are computed by numpy, cells of a table that is kept whole, and entries
#: that a frame keeps between pages. None of them changes a result.
WIDE, CELLS, HELD = 48, 1 << 22, 4000
#: Group of wrappers that hosts share; no host has this name.
ANY = "*"
#: Outer containers that make up a layout, and how deep they are looked at.
_CONTAINER = re.compile(r"<(/?)(body|div|section|main|article|nav|header|footer|aside|table)\b", re.I)
DEPTH = 4
#: Bytes of frames that may be broadcast, after they have been summed.
FRAME_BYTES = 16 << 20


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def text_hash(t: str) -> int:
    return zlib.crc32(t.encode("utf-8", "surrogatepass"))


class Shapes:
    """Numbers of subtrees by their tags: what lies below a subtree has smaller numbers. Sizes of the largest matchings of two of them.

    A matching pairs roots of equal tags and children in order. Two equal subtrees match whole, and if two lists begin or end with
    equal ones, some largest matching pairs these.
    """

    def __init__(self):
        self.ids: dict[tuple, int] = {}
        self.tag: list[str] = []
        self.kids: list[tuple] = []
        self.size: list[int] = []
        self.matched: dict[int, dict[int, int]] = {}
        self.entries = 0

    def of(self, tag: str, kids: tuple) -> int:
        n = self.ids.setdefault((tag, kids), len(self.ids))
        if n == len(self.tag):
            self.tag.append(tag)
            self.kids.append(kids)
            self.size.append(1 + sum(self.size[k] for k in kids))
        return n

    def page(self, root: Node) -> dict[int, int]:
        """Numbers of a page's nodes, by id."""
        out: dict[int, int] = {}
        for n in reversed(list(root.walk())):
            out[id(n)] = self.of(n.tag, tuple(out[id(k)] for k in n.kids))
        return out

    def weight(self, s: int, t: int) -> int:
        if s == t:
            return self.size[s]
        if self.tag[s] != self.tag[t]:
            return 0
        return self.matched[s][t] if self.kids[s] and self.kids[t] else 1

    def known(self, s: int, t: int) -> bool:
        return s == t or self.tag[s] != self.tag[t] or not self.kids[s] or not self.kids[t] or t in self.matched.get(s, ())

    def need(self, pairs) -> None:
        """Finds the matchings of pairs of subtrees, of those below first; nothing recurses."""
        for p in pairs:
            todo = [p]
            while todo:
                s, t = todo.pop()
                if self.known(s, t):
                    continue
                a, b = self.kids[s], self.kids[t]
                head = common(a, b)
                tail = common(a[head:][::-1], b[head:][::-1])
                inner, other = a[head : len(a) - tail], b[head : len(b) - tail]
                below = [x for x in product(set(inner), set(other)) if not self.known(*x)]
                if below:
                    todo.append((s, t))
                    todo.extend(below)
                    continue
                last = [0]
                for row in self.rows(inner, other):
                    last = row
                self.matched.setdefault(s, {})[t] = 1 + sum(self.size[k] for k in (*a[:head], *a[len(a) - tail :])) + int(last[-1])
                self.entries += 1

    def rows(self, a, b, last=None):
        """Rows of the table of the largest matchings of the heads of two lists, one for each of a."""
        weights: dict[int, list | np.ndarray] = {}
        wide = len(b) >= WIDE
        if wide:
            names, at = np.unique(np.array(b), return_inverse=True)
            names = names.tolist()
        if last is None:
            last = np.zeros(len(b) + 1, np.int64) if wide else [0] * (len(b) + 1)
        for s in a:
            w = weights.get(s)
            if w is None:
                if len(weights) * len(b) > CELLS:
                    weights.clear()
                w = weights[s] = np.array([self.weight(s, t) for t in names], np.int64)[at] if wide else [self.weight(s, t) for t in b]
            if wide:
                row = last.copy()
                np.maximum(row[1:], last[:-1] + w, out=row[1:])
                row = np.maximum.accumulate(row)
            else:
                row, best, before = [0], 0, 0
                for x, up in zip(w, last[1:], strict=True):
                    if up > best:
                        best = up
                    if x and before + x > best:
                        best = before + x
                    before = up
                    row.append(best)
            yield row
            last = row

    def pairs(self, a, b) -> list[tuple[int, int]]:
        """Positions that the largest matching of two lists pairs, in order; of equal matchings the one that passes over the last of a, then of b."""
        head = common(a, b)
        out = [(i, i) for i in range(head)]
        a, b = a[head:], b[head:]
        if not a or not b:
            return out
        self.need(product(set(a), set(b)))
        step = 1 if len(a) * len(b) <= CELLS else isqrt(len(a)) + 1
        kept = [[0] * (len(b) + 1) if len(b) < WIDE else np.zeros(len(b) + 1, np.int64)]
        kept += [row for i, row in enumerate(self.rows(a, b), 1) if i % step == 0]
        i, j, back = len(a), len(b), []
        while i and j:
            low = (i - 1) // step * step  # rows from here to i
            m = kept[low // step : low // step + 2] if step == 1 else [kept[low // step], *self.rows(a[low:i], b, kept[low // step])]
            while i > low and j:
                row, up = m[i - low], m[i - low - 1]
                if row[j] == up[j]:
                    i -= 1
                elif row[j] == row[j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    back.append((head + i, head + j))
        return out + back[::-1]


def common(a, b) -> int:
    """How many equal ones two lists begin with."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class Frame:
    """A frame page's tree in order of the walk: a slot is a position; `kids`, `last` (slot after a subtree) and `shape` by slot."""

    def __init__(self, nodes: list[list]):
        self.nodes, n = nodes, len(nodes)  # (tag, text hash, text length, depth)
        self.kids: list[list[int]] = [[] for _ in range(n)]
        self.above, self.last, path = [-1] * n, [n] * n, []
        for i, node in enumerate(nodes):
            while len(path) > node[3]:
                self.last[path.pop()] = i
            if path:
                self.kids[path[-1]].append(i)
                self.above[i] = path[-1]
            path.append(i)
        self.shapes: Shapes | None = None

    def numbered(self) -> Shapes:
        """Shapes with the frame's own, and what the last pages left if that isn't much."""
        if self.shapes is None or len(self.shapes.ids) + self.shapes.entries > self.held:
            self.shapes, self.shape = Shapes(), [0] * len(self.nodes)
            for i in range(len(self.nodes) - 1, -1, -1):
                self.shape[i] = self.shapes.of(self.nodes[i][0], tuple(self.shape[k] for k in self.kids[i]))
            self.held = HELD + 2 * len(self.shapes.ids)
        return self.shapes


def freeze(root: Node) -> bytes:
    out, stack = [], [(root, 0)]
    while stack:
        n, depth = stack.pop()
        out.append([n.tag, text_hash(n.text) if n.tag == "#text" else 0, len(n.text), depth])
        stack.extend((k, depth + 1) for k in reversed(n.kids))
    return json.dumps(out).encode()


def thaw(data: bytes) -> Frame:
    return Frame(json.loads(data))


def align(page: Node, frame: Frame | bytes) -> list[tuple[Node, int, bool]]:
    """Sets `slot` of the page's nodes that the matching pairs with the frame's, and `same` of text with equal text; returns the latter."""
    frame = thaw(frame) if isinstance(frame, bytes) else frame
    shapes, out = frame.numbered(), []
    shape = shapes.page(page)
    todo = [(page, 0)] if page.tag == frame.nodes[0][0] else []
    while todo:
        n, slot = todo.pop()
        n.slot = slot
        if n.tag == "#text":
            n.same = text_hash(n.text) == frame.nodes[slot][1] and len(n.text) == frame.nodes[slot][2]
            out.append((n, slot, n.same))
            continue
        kids = frame.kids[slot]
        found = shapes.pairs([shape[id(k)] for k in n.kids], [frame.shape[k] for k in kids])
        todo.extend((n.kids[i], kids[j]) for i, j in reversed(found))
    return out


def masses(page: Node) -> dict[int, list[int]]:
    """Characters of an aligned page by slot: (equal to the frame's, other, in links); text without a slot counts for the block around it."""
    out: dict[int, list[int]] = {}
    stack = [(page, max(page.slot, 0))]
    while stack:
        n, slot = stack.pop()
        if n.slot >= 0:
            slot = n.slot
        if n.tag == "#text":
            got = out.setdefault(slot, [0, 0, 0])
            got[0 if n.same else 1] += len(n.text)
            got[2] += n.links
        stack.extend((k, slot) for k in n.kids)
    return out


def region(frame: Frame, template: set[int], mass: dict[int, tuple[int, int, int]]) -> tuple[int, list[int], list[int]]:
    """(slot of the block that holds the article, slots of text blocks beside it and above, slots of blocks of links in it).

    From the root down, the block goes to the child block that has REGION of its varying text, as long as there is one. Text blocks
    (paragraphs, headings) are never gone into: an article may have one paragraph only. Varying text is what isn't template.
    """
    n = len(frame.nodes)
    own, links = [0] * (n + 1), [0] * (n + 1)
    for slot, (same, other, linked) in mass.items():
        own[slot], links[slot] = other + (0 if slot in template else same), linked if slot not in template else 0
    total, linked = own[:], links[:]
    for i in range(n - 1, 0, -1):
        total[frame.above[i]] += total[i]
        linked[frame.above[i]] += linked[i]
    at, path = 0, [0]
    while True:
        best = max((k for k in frame.kids[at] if frame.nodes[k][0] not in TEXT and frame.kids[k]), key=lambda k: total[k], default=None)
        if best is None or total[best] < REGION * total[at] or not total[best]:
            break
        at = best
        path.append(at)
    beside = [k for p in path[:-1] for k in frame.kids[p] if frame.nodes[k][0] in TEXT and total[k] > 2 * linked[k]]
    dense = [i for i in range(at + 1, frame.last[at]) if frame.nodes[i][0] not in TEXT and frame.kids[i] and 2 * linked[i] > total[i] > 0]
    return at, beside, dense


def shape(page: str) -> int:
    """A hash of a page's layout: how many containers it has by path, the inner ones only by whether it has any."""
    path: list[str] = []
    seen: Counter = Counter()
    for m in _CONTAINER.finditer(page):
        tag = m[2].lower()
        if not m[1]:
            path.append(tag)
            if len(path) <= DEPTH:
                seen["/".join(path)] += 1
        elif tag in path:
            while path.pop() != tag:
                pass
    text = "|".join(f"{k}:{v if k.count('/') < 2 else 1}" for k, v in sorted(seen.items()))
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)


def leaves(frame: Frame) -> dict[int, int]:
    """Text length of each text slot of a frame."""
    return {i: node[2] for i, node in enumerate(frame.nodes) if node[0] == "#text"}


def with_shape(pages: DataFrame) -> DataFrame:
    """pages (host, html, ...) with the `shape` of each page."""
    at = pages.columns.index("html")
    return append(pages, [field("shape", T.LongType())], lambda b: [pa.array([shape(x.as_py() or "") for x in b.column(at)], pa.int64())])


def layouts(shaped: DataFrame) -> DataFrame:
    """Stored (host, shape, group, layout, h): the wrapper (group, layout) of a host's shape; h: hash of a page that may be its frame.

    A shape with more than PAGES different pages on the host has a wrapper of the host (group: the host). Rarer ones share the
    wrapper of that shape over all hosts (group ANY) if these have so many pages together, else the one of the host's most frequent shape.
    """
    full = shaped.where(F.coalesce(F.trim(F.regexp_replace("html", r"<[^>]*>|\s", "")) != "", F.lit(False)))
    n = full.select("host", "shape", F.xxhash64("html").alias("h")).distinct().groupBy("host", "shape").agg(F.count("*").alias("n"), F.min("h").alias("h"))
    n = stash(n, "shapes")
    most = n.groupBy("host").agg(F.max_by("shape", F.struct("n", "shape")).alias("main"), F.max("n").alias("of_main"))
    wide = stash(n.groupBy("shape").agg(F.sum("n").alias("all"), F.count("*").alias("hosts")), "wide")
    own, any_ = F.col("n") > PAGES, F.col("all") > PAGES
    group = F.when(own, F.col("host")).when(any_, F.lit(ANY)).otherwise(F.col("host"))
    layout = F.when(own | any_, F.col("shape")).otherwise(F.col("main"))
    head = F.when(layout == F.col("shape"), F.col("h"))
    out = lookup(n, wide, ["shape"], "hosts", "inner").join(most, "host")
    return stash(out.select("host", "shape", group.alias("group"), layout.alias("layout"), head.alias("h")), "layouts")


def frames(pages: DataFrame, known: DataFrame) -> DataFrame:
    """Stored (group, layout, frame): the frozen tree of each wrapper's frame page (shared by hosts: the least of those that have one)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([freeze(parse(x.as_py() or "")) for x in b.column(2)], pa.binary())], names=["group", "layout", "frame"])

    first = known.where("h is not null").groupBy("group", "layout").agg(F.min(F.struct("h", "host")).alias("x")).select("group", "layout", "x.host", "x.h")
    rows = pages.select("host", "html", F.xxhash64("html").alias("h")).join(small_side(stash(first, "heads")), ["host", "h"]).select("group", "layout", "html").dropDuplicates(["group", "layout"])
    return stash(rows.mapInArrow(run, "group string, layout long, frame binary"), "frames")


def small_frames(f: DataFrame, column: str) -> DataFrame:
    size = f.agg(F.coalesce(F.sum(F.octet_length(column) + 64), F.lit(0))).first()[0]
    return F.broadcast(f) if size <= FRAME_BYTES else f


KEY = ["group", "layout"]


def cached(known: dict, k: tuple, make):
    if k not in known:
        if len(known) > 200:
            known.clear()
        known[k] = make()
    return known[k]


def observed(rows: DataFrame, frame: DataFrame) -> DataFrame:
    """Stored (group, layout, pattern, n, slot, same, other, links): patterns of equal slots with how often they occur, and characters by slot (pattern null)."""

    def run(batches):
        trees: dict[tuple, Frame] = {}
        mass: dict[tuple, list[int]] = {}

        def batch_of(found: dict, mass: dict):
            cols = [[*[k[i] for k in found], *[k[i] for k in mass]] for i in (0, 1)]
            none_f, none_m = [None] * len(found), [None] * len(mass)
            arrays = [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array([k[2] for k in found] + none_m, pa.binary()), pa.array(list(found.values()) + none_m, pa.int64()), pa.array(none_f + [k[2] for k in mass], pa.int64())]
            arrays += [pa.array(none_f + [v[i] for v in mass.values()], pa.int64()) for i in range(3)]
            return pa.RecordBatch.from_arrays(arrays, names=["group", "layout", "pattern", "n", "slot", "same", "other", "links"])

        for b in batches:
            found: Counter = Counter()
            for g, y, page, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                root = parse(page.as_py() or "")
                text = align(root, cached(trees, (g, y), lambda f=f: thaw(f.as_py())))
                found[g, y, array("i", sorted(2 * slot + same for _, slot, same in text)).tobytes()] += 1
                for slot, v in masses(root).items():
                    got = mass.setdefault((g, y, slot), [0, 0, 0])
                    for i in range(3):
                        got[i] += v[i]
            if len(mass) > 100_000:
                yield batch_of(found, mass)
                mass = {}
            else:
                yield batch_of(found, {})
        yield batch_of({}, mass)

    dealt = rows.select(*KEY, "html").join(small_frames(frame, "frame"), KEY).select(*KEY, "html", "frame")
    return stash(dealt.mapInArrow(run, "group string, layout long, pattern binary, n long, slot long, same long, other long, links long"), "observed")


def templates(seen: DataFrame, frame: DataFrame) -> DataFrame:
    """Stored (group, layout, frame, slots): each wrapper with its template slots; seen: (group, layout, pattern, n)."""

    def flush(votes):
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.int64()), pa.array([k[2] for k in votes], pa.int64()), pa.array([v[0] for v in votes.values()], pa.int64()), pa.array([v[1] for v in votes.values()], pa.int64())], names=["group", "layout", "slot", "n", "same"])

    def count(second: bool):
        def run(batches):
            votes: dict[tuple, list[int]] = {}
            known: dict[tuple, tuple] = {}
            for b in batches:
                for i, (h, y, p, n) in enumerate(zip(*(b.column(c).to_pylist() for c in range(4)), strict=True)):
                    marks = array("i", p)
                    if second:
                        size, other = cached(known, (h, y), lambda b=b, i=i: varying(b.column(4)[i].as_py(), b.column(5)[i].as_py()))
                        if size < VARYING or 2 * sum(other.get(m >> 1, 0) for m in marks if m & 1) >= size:
                            continue
                    for m in marks:
                        v = votes.setdefault((h, y, m >> 1), [0, 0])
                        v[0] += n if second else 1
                        v[1] += (m & 1) * (n if second else 1)
                if len(votes) > 100_000:
                    yield flush(votes)
                    votes = {}
            yield flush(votes)

        return run

    def varying(frame, constant):
        other = {k: v for k, v in leaves(thaw(frame)).items() if k not in set(constant or ())}
        return sum(other.values()), other

    def summed(d: DataFrame, second: bool) -> DataFrame:
        votes = d.mapInArrow(count(second), "group string, layout long, slot long, n long, same long").groupBy(*KEY, "slot").agg(F.sum("n").alias("n"), F.sum("same").alias("same"))
        least = PAGES if second else 1
        return votes.where((F.col("same") >= least) & (F.col("same") >= CONSTANT * F.col("n"))).groupBy(*KEY).agg(F.collect_set("slot").alias("slots"))

    first = stash(frame.join(summed(seen, False), KEY, "left").select(*KEY, "frame", "slots"), "constant")
    voting = seen.join(small_frames(first, "frame"), KEY).select(*KEY, "pattern", "n", "frame", "slots")
    return stash(summed(voting, True).join(frame, KEY), "templates")


def wrapped(found: DataFrame, mass: DataFrame) -> DataFrame:
    """Stored (group, layout, frame, wrapper): template slots, region, text blocks beside it and blocks of links, as bytes."""

    def run(batches):
        for b in batches:
            out = []
            for f, slots, rows in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                at, beside, dense = region(thaw(f), set(slots), {r["slot"]: (r["same"], r["other"], r["links"]) for r in rows})
                out.append(json.dumps([sorted(slots), at, beside, dense]).encode())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.binary())], names=[*KEY, "frame", "wrapper"])

    sums = mass.groupBy(*KEY, "slot").agg(*[F.sum(c).alias(c) for c in ("same", "other", "links")]).groupBy(*KEY).agg(F.collect_list(F.struct("slot", "same", "other", "links")).alias("mass"))
    return stash(found.join(sums, KEY).select(*KEY, "frame", "slots", "mass").mapInArrow(run, "group string, layout long, frame binary, wrapper binary"), "wrappers")


class Wrapper:
    """What induction learnt about pages of one frame."""

    def __init__(self, frame: bytes, wrapper: bytes):
        self.frame = thaw(frame)
        slots, self.region, beside, dense = json.loads(wrapper)
        self.slots, self.beside, self.dense = set(slots), set(beside), set(dense)
        self.path, at = set(), self.region
        while at > 0:
            at = self.frame.above[at]
            self.path.add(at)


def main_text(page: str, frame: bytes | None, wrapper: bytes | None) -> str:
    """The article of one page by a stored wrapper, or (none) by element and class roles."""
    return article(page, Wrapper(frame, wrapper) if frame and wrapper else None)


def article(page: str, wrapper: Wrapper | None) -> str:
    """The article: what varies in the wrapper's region; without a wrapper, or if the page lacks the region, by element and class roles."""
    root = parse(page)
    if wrapper is not None:
        align(root, wrapper.frame)
        for n in root.walk():
            if n.same and n.slot in wrapper.slots:
                n.text = ""
        if any(n.slot == wrapper.region for n in root.walk()):
            text = kept_text(root, set(), wrapper)
            if text:
                return text
    own, outer = wrappers(root)
    return kept_text(root, own) or (kept_text(root, outer) if outer - own else "")


def kept_text(root: Node, holds: set[int], wrapper: Wrapper | None = None) -> str:
    """Text of blocks that aren't dropped, of the article and main elements if one is reached.

    With a wrapper: of its region and the text blocks beside it; nothing drops the region itself or what holds it.
    """
    articles: list[str] = []
    everything: list[str] = []
    found = False
    stack = [(root, False, wrapper is None)]
    while stack:
        n, inside, within = stack.pop()
        if n.tag == "#text":
            if n.text and within:
                everything.append(n.text)
                if inside:
                    articles.append(n.text)
            continue
        if wrapper is not None and not within:
            if n.slot in wrapper.path:
                stack.extend((k, inside, False) for k in reversed(n.kids))
                continue
            if n.slot != wrapper.region and n.slot not in wrapper.beside:
                continue
            within = True
        elif wrapper is not None and n.slot in wrapper.dense or dropped(n, inside or wrapper is not None, holds):
            continue
        if n.tag in ("article", "main"):
            inside = found = True
        stack.extend((k, inside, within) for k in reversed(n.kids))
    return "\n".join(articles if found else everything)


FIELDS = [field("text", T.StringType()), field("n_chars", T.LongType())]


def extract(pages: DataFrame) -> DataFrame:
    """pages with `text` and `n_chars`."""
    new = {f.name for f in FIELDS}
    keep = [c for c in pages.columns if c.lower() not in new]
    own = pages.select(F.struct(*keep).alias("row"), "html", host(F.col("url")).alias("host"))  # so no name of the input can clash
    shaped = with_shape(own.select("host", "html"))
    known = layouts(shaped)
    frame = frames(shaped.select("host", "html"), known)
    names = small_side(known.select("host", "shape", *KEY))
    seen = observed(shaped.join(names, ["host", "shape"]), frame)
    patterns = stash(seen.where("pattern is not null").groupBy(*KEY, "pattern").agg(F.sum("n").alias("n")), "patterns")
    found = wrapped(templates(patterns, frame), seen.where("pattern is null"))
    rows = with_shape(own).join(names, ["host", "shape"], "left").join(small_frames(found, "frame"), KEY, "left").select("row", "html", *KEY, "frame", "wrapper")

    def make(batches):
        known: dict[tuple, Wrapper | None] = {}
        for b in batches:
            texts = []
            for page, g, y, f, w in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5), strict=True):
                texts.append(article(page.as_py() or "", cached(known, (g, y), lambda f=f, w=w: Wrapper(f.as_py(), w.as_py()) if f.is_valid else None)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["row", "text", "n_chars"])

    kind = T.StructType([T.StructField("row", rows.schema["row"].dataType), *FIELDS])
    return rows.mapInArrow(make, kind).select("row.*", *[f.name for f in FIELDS])
