"""Main text of web pages by gradient-boosted trees over DOM nodes.

A tolerant parser gives the block elements of a page; each has features of its subtree (text, links, density,
children), its attribute tokens and its ancestors', its depth and its siblings. Boosted oblivious trees
give the log-odds that a node is article text. A dynamic program over the tree then takes the best choice in which a
kept node has no dropped descendants and a dropped one no kept ones, unless their common ancestor is split.

No table labels page nodes, so the trees are trained here on pages that a seeded generator lays out.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: What ends a comment, and the parts of a tag. Each is matched where the scan stands, so a page is read once.
_COMMENT_END = re.compile(r"--!?>")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SPACE = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"[^\s/>][^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_UNQUOTED = re.compile(r"[^\s>]*")
_TOKEN = re.compile(r"[a-z]+")

# Element kinds of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "template"}
CONTROLS = {"button", "select", "datalist"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
TRANSPARENT = {"noscript", "object", "svg", "math", "mi", "mn", "mo", "ms", "mtext", "mrow", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "semantics"}
HEAD = {"title", "meta", "link", "base", "script", "style", "template", "noscript"}
#: An opening tag ends an open element of these kinds, up to the nearest of the second set.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}

# Tag kinds and attribute tokens that features tell apart.
TAGS = [{"article"}, {"main"}, {"section", "div"}, {"p"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"}, {"nav", "menu"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "input", "label", "legend"}, {"table", "tbody", "tr", "td", "th"}, {"blockquote", "pre"}, {"figure", "figcaption"}, {"body", "html"}]
TOKENS = [
    {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "tabs"},
    {"header", "masthead", "topbar", "logo", "branding"},
    {"footer", "foot", "colophon", "copyright", "legal", "bottom"},
    {"sidebar", "aside", "widget", "rail", "complementary"},
    {"ad", "ads", "advert", "advertisement", "banner", "sponsor", "sponsored", "promo", "promotion", "adsense"},
    {"comment", "comments", "reply", "replies", "disqus", "discussion", "respond", "reviews"},
    {"form", "login", "signup", "subscribe", "subscription", "newsletter", "search", "contact", "register"},
    {"cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "overlay", "gdpr", "warning", "message"},
    {"share", "social", "related", "recommended", "more", "trending", "popular", "tags", "tagcloud", "links", "byline", "meta", "author"},
    {"article", "content", "post", "entry", "main", "story", "body", "text", "page", "blog", "news"},
]
OUTSIDE = {"head", *CONTROLS}
FLOWING = INLINE | TRANSPARENT
#: Marks article words of generated pages: a private code point.
MARK = "\ue000"


@dataclass
class Page:
    """Block nodes in page order and the runs of text that they hold."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    tokens: list[frozenset[str]] = field(default_factory=list)
    tags: list[int] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)


def tags(source: str) -> Iterator[tuple[int, int, str, bool, list[tuple[str, str]]]]:
    """(first, end, name, is an end tag, attributes) of each tag; comments and declarations have an empty name. One pass: what
    is looked for and not found is not looked for again."""
    at, n = source.find("<"), len(source)
    unclosed: set[str] = set()
    while 0 <= at < n - 1:
        c = source[at + 1]
        if source.startswith("<!--", at):
            if source.startswith((">", "->"), at + 4):
                end = source.index(">", at) + 1
            else:
                m = _COMMENT_END.search(source, at + 4)
                end = m.end() if m else n
            yield at, end, "", False, []
        elif c in "!?" or c == "/" and not _NAME.match(source, at + 2):
            end = source.find(">", at) + 1
            if not end and c == "/":
                return
            end = end or n
            yield at, end, "", False, []
        elif m := _NAME.match(source, at + 1 + (c == "/")):
            name, ends, end = m[0].lower(), c == "/", m.end()
            found: list[tuple[str, str]] = []
            while True:
                end = _SPACE.match(source, end).end()
                if end >= n or source[end] == ">":
                    break
                k = _ATTRIBUTE.match(source, end)
                end = k.end()
                e = _EQUALS.match(source, end)
                if not e:
                    continue
                end = e.end()
                quote = source[end : end + 1]
                close = source.find(quote, end + 1) if quote in ("'", '"') and quote not in unclosed else -1
                if close >= 0:
                    value, end = source[end + 1 : close], close + 1
                else:
                    if quote in ("'", '"'):  # never closed: the value ends as one without quotes does
                        unclosed.add(quote)
                    v = _UNQUOTED.match(source, end)
                    value, end = v[0], v.end()
                if len(k[0]) < 6:
                    found.append((k[0].lower(), value))
            closed = source[end - 1] == "/" if end else False
            end = min(n, end + 1)
            if closed:
                found.append(("/", ""))
            yield at, end, name, ends, found
        else:
            end = at + 1
        at = source.find("<", end)
        if at < 0:
            return


_raw_ends: dict[str, re.Pattern] = {}


def _raw_end(name: str) -> re.Pattern:
    if name not in _raw_ends:
        _raw_ends[name] = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*(?:>|$)", re.I)
    return _raw_ends[name]


class _Parser:
    """Builds a Page. The stack has open elements with their nearest block nodes; `open` has, by name, their places in it, and
    `blocks` the places of block elements, so that nothing is looked for by going down the stack."""

    def __init__(self) -> None:
        self.page = Page()
        self.stack: list[tuple[str, int]] = []
        self.open: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.text: list[str] = []
        self.linked = self.outside = 0
        self.push("", self.node("", -1), True)

    def node(self, tag: str, parent: int, tokens: frozenset[str] = frozenset()) -> int:
        p = self.page
        for x, v in ((p.tag, tag), (p.parent, parent), (p.tokens, tokens), (p.tags, 0), (p.links, 0)):
            x.append(v)
        return len(p.tag) - 1

    def push(self, name: str, node: int, block: bool) -> None:
        self.open.setdefault(name, []).append(len(self.stack))
        if block:
            self.blocks.append(len(self.stack))
        self.stack.append((name, node))
        self.linked += name == "a"
        self.outside += name in OUTSIDE

    def pop(self, n: int) -> None:
        while len(self.stack) > n:
            name = self.stack[-1][0]
            if name not in FLOWING:
                self.flush()
            if self.blocks[-1] == len(self.stack) - 1:
                self.blocks.pop()
            self.open[name].pop()
            self.linked -= name == "a"
            self.outside -= name in OUTSIDE
            self.stack.pop()

    def last(self, names: Iterable[str]) -> int:
        """The place of the innermost open element of these names; 0 for none."""
        return max((self.open[x][-1] for x in names if self.open.get(x)), default=0)

    def flush(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            if line:
                self.page.runs.append((self.stack[-1][1], line))
            self.text.clear()

    def words(self, piece: str) -> None:
        if self.open.get("head") and not piece.isspace() and self.stack[-1][0] == "head":
            self.pop(self.last(("head",)))
        if self.outside:
            return
        words = entities.unescape(piece) if "&" in piece else piece
        self.text.append(words)
        if self.linked:
            self.page.links[self.stack[-1][1]] += len(words.strip())

    def end(self, name: str) -> None:
        if k := self.last((name,)):
            self.pop(k)
        elif name in ("p", "br"):
            self.flush()

    def count(self, name: str) -> None:
        """A tag without content."""
        if name not in INLINE:
            self.flush()
        self.page.tags[self.stack[-1][1]] += 1

    def start(self, name: str, found: list[tuple[str, str]]) -> None:
        if name not in HEAD and (k := self.last(("head",))):
            self.pop(k)
        if name in ENDS:
            kinds, within = ENDS[name]
            k = self.last(kinds)
            if k and k > self.last(within):
                self.pop(k)
        if name in FLOWING or name in ("option", "optgroup") and self.outside:
            block = self.stack[-1][1]
            if name in INLINE:
                self.page.tags[block] += 1
            self.push(name, block, False)
            return
        if k := self.last(CONTROLS):  # an unclosed control ends where a block starts
            self.pop(k)
        if name in CONTROLS:
            self.count(name)
            self.push(name, self.stack[-1][1], False)
            return
        if name != "body" and self.stack[self.blocks[-1]][0] == "p":
            self.pop(self.blocks[-1])
        self.flush()
        tokens = frozenset(t for k, v in found if k in ("class", "id", "role") for t in _TOKEN.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", v).lower()))
        self.push(name, self.node(name, self.stack[-1][1], tokens), True)


def parse(source: str | None) -> Page:
    """The page's block nodes, in time that grows with its length. Broken markup never raises: unknown ends are ignored, open
    elements end with their parent, a control ends where a block starts, a quote that is never closed is none."""
    parser, source, at = _Parser(), source or "", 0
    for first, end, name, ends, found in tags(source):
        if first < at:  # within raw text
            continue
        if first > at:
            parser.words(source[at:first])
        at = end
        if not name:
            continue
        if ends:
            parser.end(name)
        elif name in RAW:
            parser.count(name)
            if ("/", "") not in found or name in ("script", "style", "textarea", "title"):
                m = _raw_end(name).search(source, at)
                at = m.end() if m else len(source)
        elif name == "xmp":  # displayed as it is
            m = _raw_end(name).search(source, at)
            parser.start(name, found)
            parser.text.append(source[at : m.start() if m else len(source)])
            parser.end(name)
            at = m.end() if m else len(source)
        elif name in VOID:
            parser.count(name)
        else:
            parser.start(name, found)
    if at < len(source):
        parser.words(source[at:])
    parser.pop(1)
    parser.flush()
    return parser.page


#: Elements whose descendants know of them.
_SEMANTIC = {x: i for i, x in enumerate(["article", "main", "nav", "header", "footer", "aside", "form", "section", "table"])}
_KIND = {t: k for k, names in reversed([*enumerate(TAGS)]) for t in names}
N_FEATURES = len(TAGS) + 2 * len(TOKENS) + len(_SEMANTIC) + 16


def features(page: Page) -> np.ndarray:
    """A row of features for each node."""
    n = len(page.tag)
    own, sentences = np.zeros(n), np.zeros(n)
    place = np.full(n, np.inf)
    total = 0
    for i, line in page.runs:
        own[i] += len(line)
        sentences[i] += line.count(". ") + line.count("! ") + line.count("? ") + line.endswith((".", "!", "?"))
        place[i] = min(place[i], total)
        total += len(line)
    text, link, tags, marks, below, paragraphs = own.copy(), np.array(page.links, float), np.array(page.tags, float) + 1, sentences, np.zeros(n), np.array([float(t == "p") for t in page.tag])
    children, index, depth = [0] * n, [0] * n, [0] * n
    for i in range(1, n):
        p = page.parent[i]
        index[i] = children[p]
        children[p] += 1
        depth[i] = depth[p] + 1
    text, link, tags, marks, paragraphs, below, place = (x.tolist() for x in (text, link, tags, marks, paragraphs, below, place))
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        for x in (text, link, tags, marks, paragraphs):
            x[p] += x[i]
        below[p] = max(below[p], below[i] + 1)
        place[p] = min(place[p], place[i])
    text, link, tags, marks, paragraphs, below, place, children, index, depth = (np.array(x, float) for x in (text, link, tags, marks, paragraphs, below, place, children, index, depth))
    place[np.isinf(place)] = total
    parents = np.array(page.parent)
    parents[0] = 0
    out = np.zeros((n, N_FEATURES), np.float32)
    kinds, base = len(TAGS) + len(TOKENS), len(TAGS) + 2 * len(TOKENS)
    own_bits, up_bits, marks_up = [0] * n, [0] * n, [0] * n  # attribute tokens, ancestors' tokens, semantic elements so far
    for i, (tag, tokens) in enumerate(zip(page.tag, page.tokens, strict=True)):
        if i:
            p = page.parent[i]
            up_bits[i] = up_bits[p] | own_bits[p]
            marks_up[i] = marks_up[p]
        if tokens:
            for k, names in enumerate(TOKENS):
                if not names.isdisjoint(tokens):
                    own_bits[i] |= 1 << k
        if tag in _SEMANTIC:
            marks_up[i] |= 1 << _SEMANTIC[tag]
    which = np.array([_KIND.get(t, -1) for t in page.tag])
    out[np.flatnonzero(which >= 0), which[which >= 0]] = 1
    for at, bits, width in ((len(TAGS), own_bits, len(TOKENS)), (kinds, up_bits, len(TOKENS)), (base, marks_up, len(_SEMANTIC))):
        out[:, at : at + width] = np.array(bits)[:, None] >> np.arange(width) & 1
    numbers = (
        np.log1p(text), np.log1p(own), link / np.maximum(text, 1), text / tags, marks / np.maximum(text, 1) * 100, np.log1p(children),
        depth, below, index, index / np.maximum(children[parents], 1), text / np.maximum(text[parents], 1), text / max(total, 1),
        place / max(total, 1), np.log1p(paragraphs), text[parents] / max(total, 1), link[parents] / np.maximum(text[parents], 1),
    )
    for k, x in enumerate(numbers):
        out[:, base + len(_SEMANTIC) + k] = x
    return out


@dataclass
class Trees:
    """Boosted oblivious trees: each level of a tree has one feature and cut for all of its nodes."""

    base: float
    feature: np.ndarray  # tree x level
    cut: np.ndarray  # tree x level
    leaf: np.ndarray  # tree x 2 ** levels

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.base)
        powers = 1 << np.arange(self.feature.shape[1])
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            out += leaf[(x[:, f] > c) @ powers]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, levels: int = 4, rate: float = 0.3, bins: int = 24, smooth: float = 5.0) -> Trees:
    """Second-order boosting of the logistic loss over histogram bins."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
    base = float(np.log((weight * y).sum() / (weight * (1 - y)).sum()))
    score = np.full(len(x), base)
    feature, cut, leaves = np.zeros((trees, levels), int), np.zeros((trees, levels)), np.zeros((trees, 1 << levels))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        leaf = np.zeros(len(x), int)
        for level in range(levels):
            best, parts = (-1.0, 0, 0.0, None), 1 << level
            for f, b in enumerate(binned):
                width = len(cuts[f]) + 1
                if width == 1:
                    continue
                at = leaf * width + b
                left = [np.bincount(at, v, parts * width).reshape(parts, width).cumsum(1) for v in (g, h)]
                gl, hl = left[0][:, :-1], left[1][:, :-1]
                gr, hr = left[0][:, -1:] - gl, left[1][:, -1:] - hl
                gain = (gl**2 / (hl + smooth) + gr**2 / (hr + smooth)).sum(0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, cuts[f][k], b > k)
            feature[t, level], cut[t, level] = best[1], best[2]
            if best[3] is not None:
                leaf += best[3] * parts
        sums = np.bincount(leaf, g, 1 << levels), np.bincount(leaf, h, 1 << levels)
        leaves[t] = rate * sums[0] / (sums[1] + smooth)
        score += leaves[t][leaf]
    return Trees(base, feature, cut, leaves)


def decode(page: Page, odds: np.ndarray, split: float = 1.0) -> list[bool]:
    """Which nodes' own text stays. A subtree is kept whole, dropped whole, or split, which costs `split`."""
    n = len(page.tag)
    words = np.zeros(n)
    for i, line in page.runs:
        words[i] += line.count(" ") + 1
    own = odds * (0.25 + np.minimum(np.sqrt(words), 8))
    keep, drop, mixed, own = own.tolist(), (-own).tolist(), (np.where(words > 0, np.abs(own), 0) - split).tolist(), own.tolist()
    best = [0.0] * n
    for i in range(n - 1, -1, -1):
        best[i] = max(keep[i], drop[i], mixed[i])
        if i:
            p = page.parent[i]
            keep[p] += keep[i]
            drop[p] += drop[i]
            mixed[p] += best[i]
    state, out = [0] * n, [False] * n  # 1 kept, -1 dropped, 0 free
    for i in range(n):
        state[i] = state[page.parent[i]] if i else 0
        if state[i] == 0:
            options = (mixed[i], 0), (keep[i], 1), (drop[i], -1)
            state[i] = max(options)[1]
        out[i] = state[i] == 1 or state[i] == 0 and own[i] > 0
    return out


def main_text(pages: list[str | None], trees: Trees) -> list[str]:
    """The kept runs of each page, joined by spaces."""
    parsed = [parse(x) for x in pages]
    rows = [features(p) for p in parsed]
    odds = trees.predict(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for p, r in zip(parsed, rows, strict=True):
        kept = decode(p, odds[at : at + len(r)])
        at += len(r)
        out.append(" ".join(line for i, line in p.runs if kept[i]))
    return out


# The generator of training pages.


class _Layout:
    """Lays out one page; article words start with MARK."""

    def __init__(self, rng: random.Random) -> None:
        self.r = rng
        self.syllables = ["".join(rng.choice("bcdfghklmnprstvwz") + rng.choice("aeiouäéö") + rng.choice(["", "n", "r", "s"]) for _ in range(1)) for _ in range(60)]

    def word(self) -> str:
        return "".join(self.r.choices(self.syllables, k=self.r.choice((1, 2, 2, 3))))

    def words(self, low: int, high: int, mark: str = "") -> str:
        junk = self.r.choice(("", "", "", "&amp;", "!!"))
        out = [mark + self.word() + junk for _ in range(self.r.randint(low, high))]
        for i in range(self.r.randint(5, 14), len(out), 12):
            out[i - 1] += "."
        return " ".join(out).capitalize() + self.r.choice((".", ".", "", "!") if high > 8 else ("", "", "."))

    def link(self, low: int = 1, high: int = 3, mark: str = "") -> str:
        return f'<a href="/{self.word()}">{self.words(low, high, mark)}</a>'

    def box(self, semantic: str, tokens: set[str], inner: str) -> str:
        r = self.r
        name = r.choice(sorted(tokens))
        name = r.choice((name, name, f"site-{name}", f"{name}-wrap", f"{name}_{self.word()}", f"{self.word()} {name}"))
        kind = r.choice(("class", "class", "id"))
        tag = semantic if r.random() < 0.5 else r.choice(("div", "div", "section", "div"))
        shown = f' {kind}="{name}"' if tag != semantic or r.random() < 0.5 else ""
        return f"<{tag}{shown}>{inner}</{tag}>"

    def list_of(self, n: int, each) -> str:
        kind = self.r.choice(("ul", "ul", "ol"))
        end = self.r.choice(("</li>", "</li>", ""))
        return f"<{kind}>{''.join(f'<li>{each()}{end}' for _ in range(n))}</{kind}>"

    def boiler(self, k: int) -> str:
        r = self.r
        if k == 0:
            return self.box("nav", TOKENS[0], self.list_of(r.randint(3, 9), self.link) if r.random() < 0.8 else " | ".join(self.link() for _ in range(5)))
        if k == 1:
            return self.box("header", TOKENS[1], r.choice((f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.words(2, 6)}</p>", self.link(), "")) + (self.boiler(0) if r.random() < 0.4 else ""))
        if k == 2:
            return self.box("footer", TOKENS[2], r.choice((f"&copy; {self.words(2, 14)}", f"<p>&copy; {self.words(4, 30)}</p>", self.list_of(4, self.link) + f"<p>{self.words(5, 20)}</p>")))
        if k == 3:
            return self.box("aside", TOKENS[3], f"<h3>{self.words(1, 3)}</h3>" + r.choice((self.list_of(5, self.link), f"<p>{self.words(8, 40)}</p>", f"<p>{self.words(5, 25)}</p><p>{self.words(5, 25)}</p>")))
        if k == 4:
            return self.box("div", TOKENS[4], r.choice((self.words(3, 25), f"<p>{self.words(5, 30)}</p>", self.link(2, 8), f"<a href='/x'><img src='/a.png'>{self.words(2, 8)}</a>")))
        if k == 5:
            one = lambda: self.box("div", {"comment", "reply"}, f"<p><b>{self.word()}</b> {self.words(1, 3)}</p><p>{self.words(5, 60)}</p>")
            return self.box("section", TOKENS[5], f"<h3>{self.words(1, 2)}</h3>" + "".join(one() for _ in range(r.randint(1, 6))))
        if k == 6:
            return self.box("form", TOKENS[6], f"<label>{self.words(1, 4)}</label><input name='q'>" + r.choice(("", f"<p>{self.words(4, 18)}</p>")) + f"<button>{self.word()}</button>")
        if k == 7:
            return self.box("div", TOKENS[7], r.choice((f"<p>{self.words(6, 35)}</p>", self.words(6, 30))) + self.link())
        return self.box("div", TOKENS[8], r.choice((self.list_of(4, lambda: self.link(3, 9)), " ".join(self.link() for _ in range(4)), f"<h4>{self.words(1, 3)}</h4>" + self.list_of(3, lambda: self.link(2, 8)))))

    def block(self) -> str:
        r, k = self.r, self.r.random()
        text = self.words(1, r.choice((6, 30, 60, 120)), MARK)
        if k < 0.66:
            extra = r.choice(("", "", "", f" <em>{self.words(1, 3, MARK)}</em> ", " " + self.link(1, 3, MARK) + " ", "<br>", f"<b>{self.words(1, 4, MARK)}"))
            return f"<p>{text}{extra}{r.choice(('</p>', '</p>', '</p>', ''))}"
        if k < 0.76:
            return f"<h{r.randint(2, 4)}>{self.words(1, 8, MARK)}</h{r.randint(2, 2)}>"
        if k < 0.82:
            return self.list_of(r.randint(2, 5), lambda: self.words(2, 20, MARK))
        if k < 0.87:
            return f"<blockquote>{r.choice(('', '<p>'))}{text}</blockquote>"
        if k < 0.91:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 4, MARK)}<td>{self.words(1, 6, MARK)}" for _ in range(3)) + "</table>"
        if k < 0.95:
            return f"<figure><img src='/a.png'><figcaption>{self.words(3, 12, MARK)}</figcaption></figure>"
        return f"<div>{text}</div>"

    def article(self) -> str:
        r = self.r
        title = f"<h1>{self.words(2, 14, MARK)}</h1>" * (r.random() < 0.85)
        blocks = [self.block() for _ in range(r.choice((0, 1, 2, 4, 6, 9, 14)))]
        for k in (4, 8, 3, 6, 7):
            if blocks and r.random() < 0.12:
                blocks.insert(r.randint(0, len(blocks)), self.boiler(k))
        body = title + "".join(blocks)
        k = r.random()
        if k < 0.35:
            return f"<article>{body}</article>"
        if k < 0.5:
            return f"<main>{body}</main>"
        if k < 0.85:
            return self.box("article", TOKENS[9], body)
        if k < 0.95:
            return f"<div>{body}</div>"
        return body

    def page(self) -> str:
        r = self.r
        before = [self.boiler(k) for k in (7, 1, 0, 4) if r.random() < 0.5]
        after = [self.boiler(k) for k in (8, 5, 3, 6, 4) if r.random() < 0.35]
        if r.random() < 0.3:
            r.shuffle(before)
        if r.random() < 0.3:
            before.append(self.boiler(3))
        foot = self.boiler(2) if r.random() < 0.8 else ""
        inside = "".join(before) + self.article() + "".join(after) + foot
        if r.random() < 0.4:
            inside = f'<div class="{r.choice(("wrapper", "container", "page", "layout"))}">{inside}</div>'
        head = f"<head><title>{self.words(2, 6)}</title><style>p{{}}</style><script>var a='</p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{inside}</body></html>"


@lru_cache(4)
def train(pages: int = 700, seed: int = 11) -> Trees:
    """Train on generated pages. A node's label is what most of its text is; a node of both kinds counts less."""
    rng = random.Random(seed)
    x, y, w = [], [], []
    for _ in range(pages):
        source = _Layout(rng).page()
        marked = parse(source)
        both = np.zeros((len(marked.tag), 2))
        for i, line in marked.runs:
            for word in line.split():
                both[i, int(MARK in word)] += 1
        for i in range(len(both) - 1, 0, -1):
            both[marked.parent[i]] += both[i]
        total = both.sum(1)
        share = both[:, 1] / np.maximum(total, 1)
        use = total > 0
        x.append(features(parse(source.replace(MARK, "")))[use])
        y.append((share > 0.5)[use].astype(float))
        w.append(np.abs(2 * share - 1)[use] + 0.02)
    return boost(np.concatenate(x), np.concatenate(y), np.concatenate(w))


def extract(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row: the main text, character references decoded, white space as single spaces.

    Null and empty html and pages without main text: empty text, 0. Very long pages are read whole, in time that grows with their
    length. Repeated rows give repeated rows; an empty table none. Of choices with equal odds the split one is taken. Columns other than
    page_id, url and html take no part. The trees are trained once in a driver."""
    spark = common.configure(pages.sparkSession)
    shared = spark.sparkContext.broadcast(trees or train())

    def task():
        def f(x):
            texts = [t for block in common.chunks(x["html"], 200) for t in main_text(block, shared.value)]
            return {"page_id": x["page_id"], "url": x["url"], "text": texts, "n_chars": [len(t) for t in texts]}

        return f

    return common.stream(pages.select(F.col("page_id").cast("long"), "url", "html"), task, "page_id long, url string, text string, n_chars long")
