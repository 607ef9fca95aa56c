"""Main text of web pages by wrappers: regular expressions without unions, inferred for each host.

A page is a stream of tokens: the tags of blocks and the texts between them. Texts of the host's template are tokens of
their own: each is one value that stands, under the same tags, on nearly all different pages of its host, counted exactly
over all of them by digests; repeats in a page and copies of a page count once. All other texts are slots. The wrapper of a
host begins as one page's stream, in which runs of the same shape are folded into repeated groups, and is aligned with page
after page: what only one side has becomes optional, what comes again becomes repeated, elements that differ in their classes
alone become one of that tag. Wrappers of parts of a host's pages are aligned with each other in the same way, so the work
is spread over all pages of all hosts. A wrapper names the element that holds the article, from its semantic tags or the
mass of its slots on all pages; articles beside it that stand on every page with a good share of its text are parts of the
same. Extraction aligns a page with its host's wrapper, level by level along its repeated and
optional items, and takes the texts of the elements that meet the wrapper's article, but for blocks in it that are the
template's as a whole, and for what is the template's at its end (a label in a table, or a line between others, stays); a page where none does is read by its own
wrapper. Tags and classes that tell of boilerplate take out what slots cannot tell, as in hosts of few pages; in the article
a compound name of which one word tells of boilerplate does so only with the template or with links for most of its text.

Cases: null and empty pages, and pages without text outside of boilerplate, give the empty text; a null url is a host of
its own; repeated rows are extracted each, and teach once; very long pages are read whole, deep ones in a flat way from
MOST_DEPTH on; of elements that hold equal masses the first is the article's; an empty table gives an empty result; other
columns pass through `extracted`, whatever their names; open tags, comments and character references may be cut off anywhere.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpipe.llm.common import bounded_broadcast, removed, table, text_batches, written

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav "
    "ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
NOT_TEXT = frozenset("head script style title noscript template iframe svg canvas object select option button input textarea form nav header footer aside menu dialog xmp".split())
NOT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Words of a class or id that mark what is no article; a word that begins with one of the second list counts too.
NOT_WORDS = frozenset("ad ads adv banner header masthead topbar footer foot side menu nav navbar alert modal share sharing social related widget login search pager skip toolbar toc".split())
NOT_STEMS = ("advert", "sponsor", "promo", "sidebar", "navigat", "breadcrumb", "comment", "disqus", "reply", "replies", "cookie", "consent", "notice", "popup", "newsletter", "subscri", "signup", "recommend", "paginat")
#: Words beside a marking one that leave its meaning as it is; with any other word the name is a compound that may tell of the article.
NEUTRAL = frozenset("area bar block bottom box button buttons center col column container content group holder icon icons inner item items js left link links list main outer panel position primary right row secondary section slot top unit wrap wrapper zone".split())
#: Marks of readers' comments, which hold in any name.
COMMENTS = ("comment", "reply", "replies", "disqus")
#: Share of linked text from which a compound name takes an element out of the article.
LINKED = 0.5
#: Share of the largest article's text from which another one beside it, that stands on every page, is a part of the same.
PART_OF = 0.2
#: Elements that stand or go with those beside them.
PIECES = frozenset("tr td th li dt dd tbody thead tfoot caption p pre".split()) | frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: First words of classes that tell of other elements.
ABOUT_OTHERS = frozenset("has with without no is show hide".split())
#: Elements that hold everything, which no class takes out; of an article only comments' classes do.
NEVER_OUT = frozenset("html body main h1 h2 h3 h4 h5 h6".split())
#: Elements that are told from each other by what is in them.
ANYTHING = frozenset("div section center".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Hosts' wrappers of up to so many bytes in all are broadcast; more are joined by salted host.
BROADCAST_BYTES, SALTS = 16_000_000, 64
#: Hosts up to which their numbers of pages are broadcast.
BROADCAST_HOSTS = 1_000_000
#: Products of two numbers of items up to which they are aligned at the best score, beyond at their common singles; the longest period of a repeated group.
BEST_ALIGNED, LONGEST_GROUP = 40_000, 3
#: Different pages from which a host has a template; the share of a host's different pages that a text of it stands on, and
#: their share where pages that differ in digits alone are one.
SURE_PAGES, NEARLY_ALL, NEARLY_ALL_FORMS = 5, 0.9, 0.8
#: Elements open at once; what is nested deeper lies flat in the deepest: its text is kept but for that of excluded elements.
MOST_DEPTH = 100
#: Constant texts of up to so many characters are shown in a wrapper's expression.
SHOWN = 200
#: Host wrappers that a task holds before it passes them on; groups in which a host's are met first.
HELD_HOSTS, MEETINGS = 2_000, 256

tokens_of = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)[^<]*\Z", re.S).finditer
digits = re.compile(r"\d+")
attributes = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))").findall


class Node:
    __slots__ = ("children", "key", "out", "tag", "weak")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.children, self.key, self.out, self.weak = tag, [], tag, tag in NOT_TEXT, False
        if attrs and "=" in attrs:
            a = {k.lower(): x or y or z for k, x, y, z in attributes(attrs)}
            names, role = a.get("class", ""), a.get("role", "").lower()
            hidden = a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
            self.out = self.out or role in NOT_ROLES or hidden
            if not self.out and tag not in NEVER_OUT:
                marks = {marked(x, tag) for x in [*names.split(), a.get("id", "")]}
                self.weak = "sure" not in marks and "compound" in marks
                self.out = "sure" in marks or self.weak and tag in BLOCKS  # weak: only what else is known of it takes it out of an article
            if names or role:
                self.key = ".".join([tag, *sorted(set(digits.sub("#", names.lower()).split())), *(["@" + role] if role else [])])


@lru_cache(maxsize=65_536)
def marked(name: str, tag: str) -> str:
    """Whether a class or an id marks what is no article: sure, compound (with words that may tell of the article) or not at all."""
    found = [x.lower() for x in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name)]
    if not found or found[0] in ABOUT_OTHERS:
        return ""
    if any(x.startswith(COMMENTS) for x in found):
        return "sure"
    marks = [tag != "article" and (x in NOT_WORDS or x.startswith(NOT_STEMS)) for x in found]
    if not any(marks):
        return ""
    return "sure" if all(m or x in NEUTRAL or x.isdigit() for m, x in zip(marks, found, strict=True)) else "compound"


CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def parse(page: str) -> Node:
    """The tree of a page's tags; end tags that are left out are put in, others without a start are passed over."""
    root = Node("#root")
    stack, open_, at, skip = [root], Counter(), 0, ""

    def close(k: int) -> None:
        gone = [x.tag for x in stack[k:]]
        open_.subtract(gone)
        del stack[k:]
        if k >= MOST_DEPTH and not BLOCKS.isdisjoint(gone):
            stack[-1].children.append(Node("hr"))  # flat elements part texts too

    for m in tokens_of(page):
        if skip:
            if not (m[1] and m[2].lower() == skip):
                continue
            at, skip = m.start(), ""
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_[tag] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
                    if stack[k].tag in BLOCKS and tag not in BLOCKS:
                        break
            continue
        if tag in BLOCKS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p" or stack[k].tag in CLOSES.get(tag, ()):
                    close(k)
                    if stack[-1].tag not in CLOSES.get(tag, ()):
                        break
                elif stack[k].tag in BLOCKS:
                    break
        node, above = Node(tag, m[3]), stack[-1]
        if tag in RAW and not m[3].rstrip().endswith("/"):
            above.children.append(node)
            skip, at = tag, m.end()
            node.out = True
        elif tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
            above.children.append(node)
        elif len(stack) < MOST_DEPTH:
            above.children.append(node)
            stack.append(node)
            open_[tag] += 1
        elif node.out or tag in BLOCKS:
            if not node.out:
                above.children.append(Node("hr"))
                node.children = above.children
            stack.append(node)  # of an excluded element the children are left behind
            open_[tag] += 1
    if not skip and at < len(page):
        stack[-1].children.append(page[at:])
    return root


def clean(x: str) -> str:
    return " ".join(entities.unescape(x).split())


# A wrapper is a list of items [key, occurrence, inside, mass]. Key: an element's tag and classes, "#" for a slot, "=" and a digest for a text of
# the template, "(...)" for a group. Occurrence: "1", "?", "+" or "*". Inside a text: its one value so far, or null; inside an element or a group:
# items. Mass: characters of article-like slots.


def either(a: str, b: str) -> str:
    return "1?+*"[(a in "?*" or b in "?*") + 2 * (a in "+*" or b in "+*")]


def is_text(key: str) -> bool:
    return key[0] in "#="


def tag_of(key: str) -> str:
    return key.split(".")[0]


def join(a: list, b: list) -> list:
    """Two items of one key, or of elements of one tag, as one."""
    key = a[0] if a[0] == b[0] else tag_of(a[0])
    if is_text(key):
        return [key, either(a[1], b[1]), a[2] if a[2] == b[2] else None, a[3] + b[3]]
    return [key, either(a[1], b[1]), align(a[2], b[2]), a[3] + b[3]]


def sign(item: list) -> str:
    """An item's key and, of an element that may hold anything, whether it has slots and what stands in it."""
    if tag_of(item[0]) not in ANYTHING:
        return item[0]
    inner: set[str] = set()
    for x in item[2]:
        inner |= {x[0][0]} if is_text(x[0]) else {tag_of(y) for y in x[0][1:-1].split()} if x[0][0] == "(" else {tag_of(x[0])}
    return signed(item[0], item[3] > 0, inner)


def signed(key: str, has_slots: bool, inner: set[str]) -> str:
    return f"{key}\0{int(has_slots)}{' '.join(sorted(inner))}"


def fold(items: list) -> list:
    """Items with neighbours of the same shape as repeated groups."""
    signs: list[str] = []
    for q in range(1, LONGEST_GROUP + 1):
        if len(items) < 2 * q:
            break
        signs = [sign(x) for x in items] if len(signs) != len(items) else signs
        if all(x != y for x, y in zip(signs, signs[q:])):
            continue
        i, out = 0, []
        while i < len(items):
            unit, j = items[i : i + q], i + q
            while len(unit) == q and signs[j : j + q] == signs[i : i + q]:
                unit = [join(x, y) for x, y in zip(unit, items[j : j + q], strict=True)]
                j += q
            if j == i + q or len(unit) < q:
                out.append(items[i])
                i += 1
            else:
                i = j
                if q == 1:
                    unit[0][1] = either(unit[0][1], "+")
                    out += unit
                else:
                    out.append(["(" + " ".join(x[0] for x in unit) + ")", "+", unit, sum(x[3] for x in unit)])
        items = out
    return items


def likeness(a: str, b: str) -> int:
    """What it is worth to align two items of these signs: elements of one key are worth less than those of one sign, those of one tag still less."""
    if a == b:
        return 4
    if a[0] in "#=(" or b[0] in "#=(":
        return 0
    a, b = a.split("\0")[0], b.split("\0")[0]
    return 3 if a == b else int(tag_of(a) == tag_of(b))


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of two lists of signs that align, in order."""
    low, high = 0, 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    inner, n, m = [], len(a) - low - high, len(b) - low - high
    x, y = a[low : low + n], b[low : low + m]
    if n * m > BEST_ALIGNED:
        inner = by_singles(x, y)
    elif n and m:
        best = [[0] * (m + 1) for _ in range(n + 1)]
        like = [[likeness(p, q) for q in y] for p in x]
        for i in range(n - 1, -1, -1):
            row, under, w = best[i], best[i + 1], like[i]
            for j in range(m - 1, -1, -1):
                row[j] = max(under[j], row[j + 1], under[j + 1] + w[j] if w[j] else 0)
        i = j = 0
        while i < n and j < m:
            if like[i][j] and best[i][j] == best[i + 1][j + 1] + like[i][j]:
                inner.append((i, j))
                i, j = i + 1, j + 1
            elif best[i][j] == best[i + 1][j]:
                i += 1
            else:
                j += 1
    return [*((k, k) for k in range(low)), *((i + low, j + low) for i, j in inner), *((len(a) - high + k, len(b) - high + k) for k in range(high))]


def by_singles(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Long lists are aligned at the signs that each holds once, and between them; without such signs each meets its next equal."""
    ca, cb = Counter(a), Counter(b)
    where = {k: j for j, k in enumerate(b)}
    singles = [(i, where[k]) for i, k in enumerate(a) if ca[k] == 1 == cb[k]]
    # The longest rising run of them.
    tails, ends, back = [], [], []
    for n, (_, j) in enumerate(singles):
        k = bisect_left(tails, j)
        tails[k:] = [j, *tails[k + 1 :]] if k < len(tails) else [j]
        ends[k:] = [n, *ends[k + 1 :]] if k < len(ends) else [n]
        back.append(ends[k - 1] if k else -1)
    chain, n = [], ends[-1] if ends else -1
    while n >= 0:
        chain.append(singles[n])
        n = back[n]
    chain.reverse()
    out, i, j = [], 0, 0
    if not chain:
        places = defaultdict(list)
        for k, key in enumerate(b):
            places[key].append(k)
        for k, key in enumerate(a):
            if (n := bisect_left(places[key], j)) < len(places[key]):
                out.append((k, places[key][n]))
                j = out[-1][1] + 1
        return out
    for p, q in [*chain, (len(a), len(b))]:
        out += [(u + i, v + j) for u, v in aligned(a[i:p], b[j:q])]
        if p < len(a):
            out.append((p, q))
        i, j = p + 1, q + 1
    return out


def align(a: list, b: list) -> list:
    """The wrapper of both: aligned items are joined, the others optional."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [join(x, y) for x, y in zip(a, b, strict=True)]
    i = j = 0
    out = []
    for p, q in [*aligned([sign(x) for x in a], [sign(x) for x in b]), (len(a), len(b))]:
        out += [[x[0], either(x[1], "?"), *x[2:]] for x in [*a[i:p], *b[j:q]]]
        if p < len(a):
            out.append(join(a[p], b[q]))
        i, j = p + 1, q + 1
    return fold(out)


def runs(node: Node) -> Iterator[tuple[str, Node | None]]:
    """A node's blocks and the texts between them, inline tags passed over."""
    text: list[str] = []

    def walk(x: Node) -> Iterator[tuple[str, Node | None]]:
        for c in x.children:
            if isinstance(c, str):
                text.append(c)
            elif c.tag in BLOCKS:
                if t := clean("".join(text)):
                    yield t, None
                text.clear()
                yield "", c
            elif c.tag == "br":
                text.append(" ")
            elif not c.out:
                yield from walk(c)

    yield from walk(node)
    if t := clean("".join(text)):
        yield t, None


@lru_cache(maxsize=65_536)
def digest(tags: tuple[str, ...], text: str) -> int:
    """The number of a text under its tags."""
    return int.from_bytes(hashlib.blake2b("\0".join((*tags, text)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def level_of(node: Node, template: frozenset, tags: tuple[str, ...]) -> Iterator[tuple[str, str | Node]]:
    """The keys of a node's texts and blocks, and what they are."""
    for text, block in runs(node):
        if block is not None:
            yield block.key, block
        else:
            yield ("=%x" % (digest(tags, text) & (1 << 64) - 1) if template and digest(tags, text) in template else "#"), text


def shape(node: Node, out: bool = False, template: frozenset = frozenset(), tags: tuple[str, ...] = ()) -> tuple[list, int]:
    """The wrapper of one page's node, and its mass."""
    items, mass = [], 0
    for key, x in level_of(node, template, tags):
        if isinstance(x, str):
            n = 0 if out or key != "#" else len(x)
            items.append([key, "1", x if len(x) <= SHOWN else None, n])
        elif x.tag == "head":
            continue
        else:
            inside, n = shape(x, out or x.out, template, (*tags, x.tag))
            items.append([key, "1", inside, n])
        mass += n
    return fold(items), mass


def has_slots(node: Node, template: frozenset, tags: tuple[str, ...]) -> bool:
    return not node.out and any(key == "#" if isinstance(x, str) else has_slots(x, template, (*tags, x.tag)) for key, x in level_of(node, template, tags))


def sign_of(node: Node, template: frozenset, tags: tuple[str, ...]) -> str:
    """The sign of a page's element."""
    if node.tag not in ANYTHING:
        return node.key
    inner = {k[0] if isinstance(x, str) else x.tag for k, x in level_of(node, template, tags)}
    return signed(node.key, has_slots(node, template, tags), inner)


def texts_of(node: Node, tags: tuple[str, ...] = ()) -> Iterator[int]:
    """The digests of the texts that can be an article's."""
    for text, block in runs(node):
        if block is None:
            yield digest(tags, text)
        elif block.tag != "head" and (not block.out or "header" in block.key):
            yield from texts_of(block, (*tags, block.tag))


def titled(item: list) -> bool:
    return not is_text(item[0]) and item[3] > 0 and (tag_of(item[0]) == "h1" or any(map(titled, item[2])))


def siblings(items: list, item: list) -> list[list]:
    """The items of the level that holds an item, groups opened."""
    flat = []
    for x in items:
        flat += siblings(x[2], item) if x[0][0] == "(" else [x]
    return flat


def twins_of(items: list, path: list[list]) -> list[list]:
    """Articles beside the one that a path ends at, which stand on every page with a good share of its text: parts of the same."""
    if not path or tag_of(path[-1][0]) != "article" or path[-1][1] != "1":
        return []
    level = siblings(items if len(path) == 1 else path[-2][2], path[-1])
    return [x for x in level if x is not path[-1] and tag_of(x[0]) == "article" and x[1] == "1" and x[3] >= PART_OF * path[-1][3]]


def main_path(items: list) -> list[list]:
    """The items from the top to the element that holds the article."""
    found: list[tuple[int, list[list]]] = []

    def seek(items: list, path: list[list]) -> None:
        for item in items:
            key, _, inside, mass = item
            if is_text(key):
                continue
            here = path if key[0] == "(" else [*path, item]
            if mass and (tag_of(key) in ("article", "main") or "@main" in key):
                found.append((mass, here))
            seek(inside, here)

    seek(items, [])
    if found:
        most = max(m for m, _ in found)
        return max((x for x in found if x[0] >= 0.5 * most), key=lambda x: (len(x[1]), x[0]))[1]
    path: list[list] = []
    while True:  # down to where no single element holds most of the text
        total = sum(x[3] for x in items)
        item = max((x for x in items if not is_text(x[0])), key=lambda x: x[3], default=None)
        if not item or item[3] < 0.75 * total or item[1] in "+*" or tag_of(item[0]) in ("p", "ul", "ol", "table", "pre", "blockquote", *HEADINGS):
            return path
        if any(titled(x) for x in items if x is not item):  # the title belongs to the article
            return path
        path += [] if item[0][0] == "(" else [item]
        items = item[2]


class Level:
    """One level of a wrapper, to align pages with: its keys in order, the stretches that may come again, and the way to the article."""

    def __init__(self, items: list, path: list[list], twins: list[list] | tuple = ()):
        self.keys, self.signs, self.inside, self.on_path, self.loops = [], [], [], [], []
        self._add(items, path, twins)
        self.where = {k: n for n, k in enumerate(self.keys)}
        self.ends = len(path) == 0  # the article itself, or beside the way

    def _add(self, items: list, path: list[list], twins: list[list] | tuple) -> None:
        for item in items:
            first, main = len(self.keys), bool(path) and (item is path[0] or len(path) == 1 and any(item is x for x in twins))
            if item[0][0] == "(":
                self._add(item[2], path, twins)
            else:
                self.keys.append(item[0])
                self.signs.append(sign(item))
                self.on_path.append(main)
                self.inside.append(Level(item[2], path[1:], twins) if main else None)
            if item[1] in "+*":
                self.loops.append((first, len(self.keys)))

    def places(self, keys: list[str], signs: Callable[[], list[str]] | None = None) -> list[int]:
        """The place that each of a page's keys aligns with, or -1. signs: gives the signs, where keys do not tell."""
        n, m = len(keys), len(self.keys)
        if len(self.where) == m and all(k in self.where for k in keys):
            return [self.where[k] for k in keys]
        out = [-1] * n
        if n * m > BEST_ALIGNED:
            for i, j in by_singles(keys, self.keys):
                out[i] = j
            return [j if j >= 0 else self.where.get(k, -1) for j, k in zip(out, keys, strict=True)]
        # best[i][j]: the worth of keys i.. at places j..; after a place one may go on or begin a stretch around it anew.
        again = [[s for s, e in self.loops if s <= j < e] for j in range(m)]
        like = [[likeness(k, w) for w in self.signs] for k in (signs() if signs else keys)]
        best = [[0] * (m + 1) for _ in range(n + 1)]
        after = lambda i, j: max([best[i][j + 1], *[best[i][s] for s in again[j]]])
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                best[i][j] = max(best[i + 1][j], best[i][j + 1], like[i][j] + after(i + 1, j) if like[i][j] else 0)
        i = j = 0
        while i < n and j < m:
            if like[i][j] and best[i][j] == like[i][j] + after(i + 1, j):
                out[i] = j
                i += 1
                j = max([j + 1, *again[j]], key=lambda s: best[i][s])
            elif best[i][j] == best[i][j + 1]:
                j += 1
            else:
                i += 1
        return out


class Wrapper:
    """What is known of a host: its items."""

    def __init__(self, items: list):
        self.items = items

    def meet(self, other: Wrapper) -> None:
        self.items = align(self.items, other.items)

    def level(self) -> Level:
        path = main_path(self.items)
        return Level(self.items, path, twins_of(self.items, path))

    def expression(self) -> str:
        """As a regular expression over tags; # is a slot."""

        def text(items: list) -> str:
            out = []
            for key, often, inside, mass in items:
                one = inside or "#" if is_text(key) else f"( {text(inside)} )" if key[0] == "(" else f"<{key}> {text(inside)} </{tag_of(key)}>"
                out.append(one if often == "1" else f"({one}){often}")
            return " ".join(out)

        return text(self.items)

    def pack(self) -> str:
        return json.dumps(self.items, ensure_ascii=False)


def of_page(page: str | None, template: frozenset = frozenset()) -> Wrapper:
    return Wrapper(shape(parse(page or ""), False, template)[0])


def hash_text(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@lru_cache(maxsize=1024)
def level_from(packed: str) -> Level:
    return Wrapper(json.loads(packed)).level()


def articles(node: Node, level: Level, template: frozenset, tags: tuple[str, ...] = ()) -> list[tuple[Node, tuple[str, ...]]]:
    """The elements of a page, with the tags around them, that align with the wrapper's article."""
    if level.ends:
        return [(node, tags)]
    entries = list(level_of(node, template, tags))
    places = level.places([k for k, _ in entries], lambda: [k if isinstance(x, str) else sign_of(x, template, (*tags, x.tag)) for k, x in entries])
    return [y for (_, x), p in zip(entries, places, strict=True) if p >= 0 and level.on_path[p] and not isinstance(x, str) for y in articles(x, level.inside[p], template, (*tags, x.tag))]


def has_heading(node: Node) -> bool:
    return any(not isinstance(c, str) and (c.tag in ("h1", "h2") or has_heading(c)) for c in node.children)


def linked_share(node: Node) -> float:
    """The share of a node's characters that stand in links."""
    all_ = links = 0

    def walk(x: Node, inside: bool) -> None:
        nonlocal all_, links
        for c in x.children:
            if isinstance(c, str):
                n = len("".join(c.split()))
                all_, links = all_ + n, links + n * inside
            else:
                walk(c, inside or c.tag == "a")

    walk(node, node.tag == "a")
    return links / all_ if all_ else 0.0


def fixed(node: Node, tags: tuple[str, ...], template: frozenset) -> tuple[int, bool]:
    """(texts, whether all are the template's) of a node."""
    n, all_ = 0, True
    for key, x in level_of(node, template, tags):
        if isinstance(x, str):
            n, all_ = n + 1, all_ and key != "#"
        elif not x.out or x.weak:
            inner, same = fixed(x, (*tags, x.tag), template)
            n, all_ = n + inner, all_ and same
    return n, all_


def excluded(x: Node, tags: tuple[str, ...], template: frozenset) -> bool:
    """Whether an element of the article, with these tags around what is in it, is no part of its text."""
    if x.out and not x.weak:
        return not ("header" in x.key and has_heading(x))
    if x.weak or template and x.tag not in PIECES:
        n, same = fixed(x, tags, template)
        if same and (x.weak or n > 1):  # a whole block of the template, with more than one text
            return bool(template)
        return x.weak and linked_share(x) >= LINKED
    return False


def slots(node: Node, tags: tuple[str, ...], template: frozenset, whole: bool = False) -> Iterator[str]:
    """The texts of an article but for those of blocks that are the template's as a whole; and, of a whole article, for those at its end that are."""
    kept = [(key, x) for key, x in level_of(node, template, tags) if isinstance(x, str) or not excluded(x, (*tags, x.tag), template)]
    if whole and template:
        own = [k for k, (key, x) in enumerate(kept) if (key == "#" if isinstance(x, str) else not fixed(x, (*tags, x.tag), template)[1])]
        kept = kept[: own[-1] + 1] if own else kept
    for _, x in kept:
        if isinstance(x, str):
            yield x
        else:
            yield from slots(x, (*tags, x.tag), template)


def extract(page: str | None, packed: str | None, template: frozenset = frozenset()) -> str:
    if not page:
        return ""
    root = parse(page)
    found = articles(root, level_from(packed), template) if packed else []
    if not found:
        found = articles(root, Wrapper(shape(root, False, template)[0]).level(), template)
    return "\n\n".join(x for node, tags in found for x in slots(node, tags, template, True))


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def templates(pages: DataFrame) -> DataFrame:
    """Rows (host, texts: digests of the template's) of pages (host, html), for hosts that have any."""

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for host, page in zip(x["host_id"], x["html"], strict=True):
                if page:
                    form, whole = hash_text(re.sub(r"\d+", "", page)), hash_text(page)
                    out += [(host, t, False, form, whole) for t in set(texts_of(parse(page)))]
                    out.append((host, 0, True, form, whole))  # the page itself
            yield pd.DataFrame(out, columns=["host_id", "text", "page", "form", "whole"])

    ids = pages.select(F.xxhash64("host").alias("host_id"), "html")
    each = ids.mapInPandas(seen, "host_id long, text long, page boolean, form long, whole long").distinct()
    forms = each.groupBy("host_id", "text", "page", "form").agg(F.count("*").alias("pages"))
    counts, path = written(forms.groupBy("host_id", "text", "page").agg(F.sum("pages").alias("pages"), F.count("*").alias("forms")).where(F.col("pages") >= SURE_PAGES), "texts")
    hosts = counts.where("page").where(F.col("forms") >= SURE_PAGES).select("host_id", F.col("pages").alias("all_pages"), F.col("forms").alias("all_forms"))
    often = counts.where("not page").join(bounded_broadcast(hosts, hosts.count(), BROADCAST_HOSTS), "host_id")
    often = often.where((F.col("pages") >= NEARLY_ALL * F.col("all_pages")) & (F.col("forms") >= NEARLY_ALL_FORMS * F.col("all_forms")))
    # No more than a page's texts for each host.
    out, _ = written(often.groupBy("host_id").agg(F.sort_array(F.collect_list("text")).alias("texts")), "templates")
    removed(pages.sparkSession, path)
    return out


def as_set(texts) -> frozenset:
    return frozenset() if texts is None else frozenset(texts.tolist())


def known_by(rows: DataFrame, known: DataFrame, key: str, size: int) -> DataFrame:
    """rows with what is known by key, of size bytes in all."""
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(known), key, "left")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int"))
    return salted.join(known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "salt"], "left").drop("salt")


def wrappers(pages: DataFrame) -> DataFrame:
    """Rows (host, wrapper: packed) of pages (host, html, texts: the template's), from all pages."""

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Wrapper] = {}
        for x in batches:
            for host, page, texts in zip(x["host"], x["html"], x["texts"], strict=True):
                w = of_page(page, as_set(texts))
                if host in held:
                    held[host].meet(w)
                else:
                    held[host] = w
                if len(held) >= HELD_HOSTS:
                    yield pd.DataFrame([(h, v.pack()) for h, v in held.items()], columns=["host", "wrapper"])
                    held = {}
        yield pd.DataFrame([(h, v.pack()) for h, v in held.items()], columns=["host", "wrapper"])

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, one = None, None
        for x in batches:
            for h, packed in zip(x["host"], x["wrapper"], strict=True):
                w = Wrapper(json.loads(packed))
                if one is not None and h == host:
                    one.meet(w)
                else:
                    if one is not None:
                        yield pd.DataFrame({"host": [host], "wrapper": [one.pack()]})
                    host, one = h, w
        if one is not None:
            yield pd.DataFrame({"host": [host], "wrapper": [one.pack()]})

    # A host has a small wrapper from each task. They are met in sorted order, one at a time: first in MEETINGS groups, then those.
    parts = pages.mapInPandas(learn, "host string, wrapper string")
    group = F.pmod(F.xxhash64("wrapper"), F.lit(MEETINGS))
    some = parts.repartition("host", group).sortWithinPartitions("host", group, "wrapper").mapInPandas(meet, "host string, wrapper string")
    return some.repartition("host").sortWithinPartitions("host", "wrapper").mapInPandas(meet, "host string, wrapper string")


def extracted(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Rows (row: all of pages' columns, text)."""
    text_batches(pages.sparkSession)
    rows = pages.select(F.struct(*[pages[c] for c in pages.columns]).alias("row"), host_of(pages[url]).alias("host"), pages[html].alias("html")).withColumn("host_id", F.xxhash64("host"))
    template = templates(rows.select("host", "html"))
    size = template.agg(F.coalesce(F.sum(F.size("texts") * 8 + 8), F.lit(0)).alias("n")).first()["n"]
    rows = known_by(rows, template, "host_id", size)
    known, _ = written(wrappers(rows.select("host", "html", "texts")), "wrappers")
    size = known.agg(F.coalesce(F.sum(F.octet_length("wrapper") + F.octet_length("host")), F.lit(0)).alias("n")).first()["n"]
    met = known_by(rows, known, "host", size)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series([extract(p, w, as_set(t)) for p, w, t in zip(x["html"], x["wrapper"], x["texts"], strict=True)], dtype=object)

    return met.select("row", F.pandas_udf(read, "string").asNondeterministic()(F.struct("html", "wrapper", "texts")).alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    out = extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))


#: For pages of plain articles, as those of the supplied tables: the article's blocks by regular expressions.
SQL = r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) as body from pages),
b as (select page_id, url, list_transform(regexp_split_to_array(body, '</?(?:p|h1)>'), lambda x: regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g')) as parts from a),
c as (select page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) as parts from b),
d as (select page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)) as text from c)
select page_id, url, text, length(text) as n_chars from d
"""
