"""Main-text extraction by gradient-boosted trees over DOM nodes.

Pages are parsed into block nodes (inline tags only mark links).  Each node has
features of its subtree (text and tag density, link share, share of the page),
its own attributes, its depth and its siblings, and those of its ancestors.
Boosted trees, trained here on pages made by rule with known main text, give
every node the log-odds that its subtree holds main text.

Decoding is hierarchical: a node's value is its own log-odds, weighted by its
text, plus the values of those children worth keeping; a subtree of negative
value is dropped as a whole.  So no node is kept below a dropped one, and no node
is kept for nothing.

Defined cases: a null html is an empty page; a page without main text has an
empty text; unclosed and unmatched tags are closed as browsers do for blocks; a
head ends where something that may not stand in it begins; the text of another
dropped element that is not closed before a block around it (or at all) counts;
nothing is cut, whatever the depth or length; repeated rows get equal results; an
empty table gives no rows.  Parsing is linear in the page, and a page takes about
1 KB for each block node while it is worked on.  Only ``page_id``, ``url`` and
``html`` are read; other columns may have any name.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Element names by their role.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li "
    "legend main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("head script style template noscript svg math iframe object select textarea button canvas audio video map title".split())
#: What may stand in a head; any other element, or text, ends it.
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes script style template".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = BLOCKS - {"html", "body", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"}
SELF_ENDING = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BAD = "nav navbar menu breadcrumb footer header masthead sidebar side aside widget ad ads advert advertisement sponsor sponsored banner promo popup modal cookie consent notice alert gdpr comment comments reply respond disqus share social related recommend newsletter subscribe signup login form search pagination pager tags meta copyright legal toolbar".split()
GOOD = "article content main post entry story body text page blog news detail".split()
TAGS = ("body", "article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "table", "td", "nav", "aside", "header", "footer", "form", "blockquote", "pre", "figure")

_NAMED = re.compile(r"</?[A-Za-z]")
#: A tag whose attribute values may hold ">" in quotes, and one that ends at the first ">".
_QUOTED = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_PLAIN = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[a-z]+")
_BAD, _GOOD = frozenset(BAD), frozenset(GOOD)


@dataclass
class Page:
    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    bad: list[int] = field(default_factory=list)
    good: list[int] = field(default_factory=list)
    attrs: list[str] = field(default_factory=list)
    tags: list[int] = field(default_factory=list)
    #: (node, text) in page order
    segments: list[tuple[int, str]] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)


@dataclass
class Tag:
    start: int
    stop: int
    closing: bool
    name: str
    attributes: str


def tags_of(source: str) -> list[Tag]:
    """The page's tags in order (comments and the like have no name); a raw element with its content is one tag.

    An unclosed script or style runs to the end of the page, as in browsers; other unclosed raw elements give their text back.
    Every step moves on: a "<" that no ">" follows is text, and quotes that never close stop counting, so the cost is linear.
    """
    out: list[Tag] = []
    length, last = len(source), source.rfind(">")
    endless: set[str] = set()
    quotes = True
    at = source.find("<")
    while at >= 0:
        begin = at
        if at > last and not source.startswith("<!--", at):
            at += 1
        elif source.startswith("<!--", at):
            end = source.find("-->", at + 2)
            at = length if end < 0 else end + 3
            out.append(Tag(begin, at, False, "", ""))
        elif source[at + 1] in "!?":
            at = source.index(">", at) + 1
            out.append(Tag(begin, at, False, "", ""))
        elif _NAMED.match(source, at):
            m = _QUOTED.match(source, at) if quotes else None
            if not m:
                quotes = False
                m = _PLAIN.match(source, at)
            at, name = m.end(), m[2].lower()
            if name in RAW and not m[1]:
                end = None if name in endless else re.compile(f"</{name}(?![^\\s/>])", re.I).search(source, at)
                if end:
                    close = source.find(">", end.end())
                    at = length if close < 0 else close + 1
                elif name in ("script", "style"):
                    at = length
                else:
                    endless.add(name)
            out.append(Tag(begin, at, bool(m[1]), name, m[3]))
        else:
            at += 1
        at = source.find("<", at)
    return out


def dropped_parts(source: str, tags: list[Tag]) -> dict[int, int]:
    """For each outer or inner dropped element that ends: its tag's number and that of the first tag behind it.

    A head ends at its end tag or before the first thing that may not stand in it.  Any other dropped element must be
    closed before a block around it is; one that is not has no entry, so that its text counts as that around it.
    """
    out: dict[int, int] = {}
    open_: list[int] = []
    count: dict[str, int] = {}
    head, seen = -1, False  # the open head's tag; whether a head may no longer open
    templates = max((k for k, tag in enumerate(tags) if tag.closing and tag.name == "template"), default=-1)
    before = 0

    def pop() -> int:
        count[tags[open_[-1]].name] -= 1
        return open_.pop()

    for k, tag in enumerate(tags):
        inner = k <= templates and count.get("template")
        if head >= 0 and not inner and (source[before : tag.start].strip() or tag.name and tag.name not in IN_HEAD):
            out[head] = k + (tag.closing and tag.name == "head" and not source[before : tag.start].strip())
            head, seen = -1, True
            while open_ and tags[open_[-1]].name not in BLOCKS:
                pop()
        before = tag.stop
        name = tag.name
        if name == "head":
            if not tag.closing and not seen:
                head, seen = k, True
        elif tag.closing:
            if count.get(name):
                while True:
                    last = pop()
                    if tags[last].name == name:
                        break
                if name in DROPPED:
                    out[last] = k + 1
        elif name in RAW:
            continue
        elif name in DROPPED and not tag.attributes.endswith("/") or name in BLOCKS and name not in VOID:
            seen = seen or name != "html"
            open_.append(k)
            count[name] = count.get(name, 0) + 1
    if head >= 0:
        out[head] = len(tags)
    return out


def parse(source: str) -> Page:
    page = Page()
    stack: list[int] = []
    count: dict[str, int] = {}
    pieces: list[str] = []
    links = 0  # open <a> elements

    def open_(tag: str, attributes: str) -> None:
        tokens = [t for m in _ATTRIBUTE.findall(attributes) for t in _TOKEN.findall("".join(m).lower())] if attributes else []
        page.tag.append(tag)
        page.parent.append(stack[-1] if stack else -1)
        page.depth.append(len(stack))
        page.bad.append(sum(t in _BAD for t in tokens))
        page.good.append(sum(t in _GOOD for t in tokens))
        page.attrs.append(" ".join(tokens))
        page.tags.append(0)
        page.linked.append(0)
        stack.append(len(page.tag) - 1)
        count[tag] = count.get(tag, 0) + 1

    def flush() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                if not stack:
                    open_("body", "")
                page.segments.append((stack[-1], text))
            pieces.clear()

    def close(tag: str) -> None:
        if not count.get(tag):
            return
        flush()
        while stack:
            node = stack.pop()
            count[page.tag[node]] -= 1
            if page.tag[node] == tag:
                break

    tags = tags_of(source)
    ends = dropped_parts(source, tags)
    at = k = 0
    while True:
        tag = tags[k] if k < len(tags) else None
        text = source[at : tag.start if tag else len(source)]
        if text:
            pieces.append(text)
            if links and stack:
                page.linked[stack[-1]] += len(text)
        if tag is None:
            break
        at, name, attributes = tag.stop, tag.name, tag.attributes
        if k in ends:
            k = ends[k]
            at = tags[k - 1].stop
            continue
        k += 1
        if tag.closing:
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCKS:
                close(name)
            continue
        if not name or name in DROPPED or name in RAW:
            continue
        if stack:
            page.tags[stack[-1]] += 1
        if name == "a":
            links = 1
        elif name == "br" or name not in BLOCKS:
            if name in ("br", "img", "input"):
                pieces.append(" ")
        else:
            flush()
            if name in ENDS_P and count.get("p"):
                close("p")
            for other in SELF_ENDING.get(name, ()):
                # Only within the nearest list or table.
                if stack and page.tag[stack[-1]] == other or (count.get(other) and stack and page.tag[stack[-1]] == "p" and len(stack) > 1 and page.tag[stack[-2]] == other):
                    close(other)
            links = 0
            if name not in VOID:
                open_(name, attributes)
    flush()
    return page


def wrappers(page: Page, text: np.ndarray) -> np.ndarray:
    """Nodes that hold the page rather than a part of it, given the length of the text below each: what their names say is about the page.

    These are the document and its body, a node with nearly all the text, and one with most of it that holds a title, an article or a main part.
    """
    n = len(page.tag)
    holds = np.zeros(n, bool)
    for v in range(n - 1, 0, -1):
        if (p := page.parent[v]) >= 0:
            holds[p] |= holds[v] or page.tag[v] in ("article", "main", "h1") and not page.bad[v]
    share = text / max(1.0, text[0] if n else 0.0, text.max(initial=0.0))
    return np.isin(page.tag, ("html", "body")) | (share >= 0.97) | (share >= 0.5) & holds


def features(page: Page) -> np.ndarray:
    """A row for each node."""
    n = len(page.tag)
    parent = np.array(page.parent)
    own, marks = np.zeros(n), np.zeros(n)
    for node, text in page.segments:
        own[node] += len(text)
        marks[node] += sum(text.count(c) for c in ".,;:!?")
    text, link, tags, stops = own.copy(), np.array(page.linked, float), np.array(page.tags, float) + 1, marks.copy()
    children = np.zeros(n)
    for v in range(n - 1, 0, -1):  # children follow their parents
        if (p := page.parent[v]) >= 0:
            text[p] += text[v]
            link[p] += link[v]
            tags[p] += tags[v]
            stops[p] += stops[v]
            children[p] += 1
    wraps = wrappers(page, text)
    bad, tag_of = np.where(wraps, 0, page.bad), ["div" if w and t in ("form", "aside", "header", "footer", "nav") else t for w, t in zip(wraps.tolist(), page.tag, strict=True)]
    up_bad, up_good, up_main, up_nav = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    place = np.zeros(n)
    seen: dict[int, int] = {}
    same: dict[tuple[int, str], int] = {}
    for v in range(n):
        p = page.parent[v]
        place[v] = seen[p] = seen.get(p, -1) + 1
        same[p, page.tag[v]] = same.get((p, page.tag[v]), 0) + 1
        if p >= 0:
            up_bad[v] = up_bad[p] + bad[p]
            up_good[v] = up_good[p] + page.good[p]
            up_main[v] = up_main[p] or tag_of[p] in ("article", "main")
            up_nav[v] = up_nav[p] or tag_of[p] in ("nav", "aside", "header", "footer", "form")
    siblings = np.array([seen[p] + 1 for p in page.parent], float)
    alike = np.array([same[p, t] for p, t in zip(page.parent, page.tag, strict=True)], float)
    total = max(1.0, own.sum())
    above = np.where(parent >= 0, parent, 0)
    index = {t: k for k, t in enumerate(TAGS)}
    kind = np.zeros((n, len(TAGS)))
    up_kind = np.zeros((n, len(TAGS)))
    for v, t in enumerate(tag_of):
        if t in index:
            kind[v, index[t]] = 1
    up_kind[:] = np.where(parent[:, None] >= 0, kind[above], 0)
    part = np.stack(
        [
            np.log1p(own), np.log1p(text), text / tags, np.minimum(1, link / np.maximum(1, text)), text / total, own / np.maximum(1, text), np.array(page.depth, float), siblings,
            place / siblings, alike / siblings, np.where(parent >= 0, text / np.maximum(1, text[above]), 1), np.log1p(children), 100 * stops / np.maximum(1, text),
            bad.astype(float), np.array(page.good, float), up_bad, up_good, up_main, up_nav, np.where(parent >= 0, np.minimum(1, link[above] / np.maximum(1, text[above])), 0), np.log1p(tags),
        ],
        1,
    )
    return np.hstack([part, kind, up_kind])


class Trees:
    """Boosted regression trees for the logistic loss, on features cut into up to 32 bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, 32)[1:-1])) for c in x.T]
        z = self._bins(x)
        self.depth, self.rate = depth, rate
        self.feature, self.cut, self.value = [], [], []
        score = np.zeros(len(y))
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p) + 1e-6
            feature, cut = np.zeros(2**depth - 1, int), np.full(2**depth - 1, 99)
            node = np.zeros(len(y), int)
            for level in range(depth):
                first = 2**level - 1
                width = 2**level
                local = node - first
                best = np.full(width, 1e-3)
                for f in range(z.shape[1]):
                    key = local * 32 + z[:, f]
                    gs = np.bincount(key, g, width * 32).reshape(width, 32).cumsum(1)
                    hs = np.bincount(key, h, width * 32).reshape(width, 32).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    at = gain.argmax(1)
                    top = gain[np.arange(width), at]
                    for k in np.flatnonzero(top > best + 1e-9):
                        best[k], feature[first + k], cut[first + k] = top[k], f, at[k]
                node = 2 * node + 1 + (z[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - (2**depth - 1)
            value = np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + 1) * rate
            score += value[leaf]
            self.feature.append(feature)
            self.cut.append(cut)
            self.value.append(value)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], 1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = self._bins(x)
        rows = np.arange(len(x))
        out = np.zeros(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (z[rows, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """Which nodes to keep: the best choice in which nothing is kept below a dropped node."""
    n = len(page.tag)
    own, below = np.zeros(n), np.zeros(n)
    for node, text in page.segments:
        own[node] += len(text)
    subtree = own.copy()
    for v in range(n - 1, 0, -1):
        if page.parent[v] >= 0:
            subtree[page.parent[v]] += subtree[v]
    value = (np.log1p(own) + 0.3 * np.log1p(subtree - own)) * odds
    for v in range(n - 1, -1, -1):
        value[v] += below[v]
        if value[v] > 0 and page.parent[v] >= 0:
            below[page.parent[v]] += value[v]
    keep = value > 0
    for v in range(n):
        if page.parent[v] >= 0:
            keep[v] &= keep[page.parent[v]]
    return keep


def made_page(rng: random.Random) -> tuple[str, set[str]]:
    """A page made by rule, and the texts of its main blocks."""
    syllables = [a + b for a in "bcdfghlmnprstvz" for b in ("a", "e", "i", "o", "u", "an", "er", "in", "ou", "st")]

    def words(low: int, high: int) -> str:
        out = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
        for k in range(len(out)):
            if rng.random() < 0.12:
                out[k] += rng.choice([".", ",", ".", ";"])
        return " ".join(out).capitalize()

    main: set[str] = set()

    def kept(low: int, high: int) -> str:
        text = words(low, high)
        main.add(text)
        return text

    def link(t: str) -> str:
        return f'<a href="/{rng.randint(1, 999)}">{t}</a>'

    def boxed(tag: str, name: str, inner: str) -> str:
        kind = rng.choice(["class", "id", "class"])
        return f'<{tag} {kind}="{name}">{inner}</{tag}>' if name else f"<{tag}>{inner}</{tag}>"

    def some(*options: tuple[str, str]) -> tuple[str, str]:
        return rng.choice(options)

    items = lambda n: "".join(f"<li>{link(words(1, 3))}</li>" for _ in range(n))
    nav = lambda: boxed(*some(("nav", ""), ("nav", "main-menu"), ("div", "navbar"), ("div", "menu"), ("div", "breadcrumb")), f"<ul>{items(rng.randint(3, 9))}</ul>")
    ad = lambda: boxed(*some(("div", "ad"), ("div", "advert"), ("div", "ads banner"), ("aside", "promo"), ("div", "sponsored")), rng.choice([words(2, 25), f"<p>{words(3, 30)}</p>"]))
    notice = lambda: boxed(*some(("div", "cookie-notice"), ("div", "notice"), ("section", "alert"), ("div", "consent popup")), rng.choice([words(5, 25), f"<p>{words(5, 25)}</p><button>{words(1, 2)}</button>"]))
    header = lambda: boxed(*some(("header", ""), ("div", "header"), ("div", "masthead")), rng.choice([f"<h1>{words(1, 4)}</h1>", f"<p>{words(2, 9)}</p>", words(1, 5)]) + (nav() if rng.random() < 0.4 else ""))
    side = lambda: boxed(*some(("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "widget related")), f"<h3>{words(1, 3)}</h3>" + rng.choice([f"<ul>{items(rng.randint(2, 8))}</ul>", f"<p>{words(5, 40)}</p>"]))
    form = lambda: boxed(*some(("form", ""), ("form", "search"), ("div", "newsletter"), ("form", "subscribe")), f"<label>{words(1, 4)}</label><input name=q><p>{words(2, 14)}</p>")
    footer = lambda: boxed(*some(("footer", ""), ("div", "footer"), ("footer", "site-footer")), rng.choice([f"&copy; {words(3, 16)}", f"<p>{words(4, 20)}</p><ul>{items(3)}</ul>"]))
    one = lambda: boxed(*some(("div", "comment"), ("li", "comment"), ("article", "comment")), f"<p>{words(1, 3)}</p><p>{words(4, 60)}</p>")
    comments = lambda: boxed(*some(("section", "comments"), ("div", "comments"), ("div", "disqus respond")), f"<h3>{words(1, 3)}</h3>" + "".join(one() for _ in range(rng.randint(1, 5))))

    inline = lambda: boxed(*some(("div", ""), ("nav", ""), ("p", ""), ("div", "access"), ("div", "links"), ("td", "left")), rng.choice([" ", " | ", "<br>"]).join(link(words(1, 3)) for _ in range(rng.randint(2, 9))))
    branding = lambda: boxed(*some(("div", "top"), ("div", "header"), ("div", "")), boxed(*some(("div", "branding"), ("p", ""), ("div", "logo")), link(words(1, 3))) + inline())

    def story() -> str:
        out = [f"<h1>{kept(2, 12)}</h1>"] if rng.random() < 0.8 else []
        if out and rng.random() < 0.15:
            out = [f"<header>{out[0]}{f'<p>{kept(2, 20)}</p>' if rng.random() < 0.3 else ''}</header>"]
        for _ in range(rng.choice([1, 1, 2, 3, 5, 9, 14])):
            kind = rng.random()
            if kind < 0.7:
                text = kept(*rng.choice([(1, 4), (5, 30), (30, 150)]))
                if rng.random() < 0.25:  # links inside the text
                    own = text.split(" ")
                    for k in rng.sample(range(len(own)), min(len(own) // 2, rng.randint(1, 4))):
                        own[k] = link(own[k])
                    text = " ".join(own)
                out.append(rng.choice([f"<p>{text}</p>", f"<p><b>{text}<br>", f"<p>{text}", f"<p><em>{text}</em></p>"]) + ("</p>" if rng.random() < 0.0 else ""))
            elif kind < 0.78:
                out.append(f"<{(h := rng.choice(['h2', 'h3']))}>{kept(1, 8)}</{h}>")
            elif kind < 0.85:
                out.append("<ul>" + "".join(f"<li>{kept(2, 15)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote>{kept(5, 40)}</blockquote>")
            elif kind < 0.91:
                out.append("<dl>" + "".join(f"<dt>{kept(1, 3)}</dt><dd>{kept(3, 30)}</dd>" for _ in range(rng.randint(1, 4))) + "</dl>")
            elif kind < 0.93:
                out.append("<table>" + "".join(f"<tr><td>{kept(1, 4)}</td><td>{kept(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.95:
                out.append(f"<pre>{kept(3, 20)}</pre>")
            else:
                out.append(rng.choice([ad, side, form])())
        return "".join(out)

    holder = some(("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "post-body entry"), ("section", "story"), ("div", ""), ("div", "article-text"))
    body = boxed(*holder, story())
    if rng.random() < 0.3:
        body = boxed(*some(("div", "page"), ("div", "wrapper"), ("main", "")), body)
    if rng.random() < 0.1:
        body = f"<table><tr><td>{inline()}</td><td>{body}</td></tr></table>"
    before = [f() for f in (header, nav, ad, notice, side, form) if rng.random() < 0.5] + [f() for f in (inline, branding) if rng.random() < 0.12]
    after = [f() for f in (side, ad, comments, form, nav) if rng.random() < 0.35] + ([footer()] if rng.random() < 0.8 else [])
    rng.shuffle(before)
    head = f"<head><title>{words(2, 8)}</title><style>p{{margin:0}}</style><script>var x=1;</script></head>"
    return f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{body}{''.join(after)}" + ("</body></html>" if rng.random() < 0.9 else ""), main


def train(pages: int = 400, seed: int = 5) -> Trees:
    """Trees fitted on ``pages`` pages made by rule."""
    rng = random.Random(seed)
    rows, labels = [], []
    for _ in range(pages):
        source, main = made_page(rng)
        page = parse(source)
        label = np.zeros(len(page.tag))
        for node, text in page.segments:
            if text in main:
                while node >= 0 and not label[node]:
                    label[node] = 1
                    node = page.parent[node]
        rows.append(features(page))
        labels.append(label)
    return Trees(np.concatenate(rows), np.concatenate(labels))


def main_texts(sources: list[str | None], trees: Trees) -> list[str]:
    pages = [parse(s or "") for s in sources]
    full = [k for k, p in enumerate(pages) if p.tag]
    odds = trees.log_odds(np.concatenate([features(pages[k]) for k in full])) if full else np.zeros(0)
    out, at = [""] * len(pages), 0
    for k in full:
        page = pages[k]
        keep = decode(page, odds[at : at + len(page.tag)])
        at += len(page.tag)
        out[k] = "\n\n".join(text for node, text in page.segments if keep[node])
    return out


def extract(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages(page_id, url, html)``."""
    trees = trees or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = main_texts(part.column(2).to_pylist(), trees)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
