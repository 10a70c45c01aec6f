"""Operator 3, HTML extraction with gradient-boosted trees over DOM nodes.

Each block element gets features of its subtree (text and link density), attribute tokens, depth and
siblings. Boosted trees, trained here on generated pages, give the log-odds that it holds main text.
Decoding is hierarchical: a dropped node drops its whole subtree and a kept node keeps its ancestors,
and the consistent choice with the greatest sum is found by one pass over the tree.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
QUOTE_OR_END = re.compile(r"""[>"']""")
ATTR = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page. Without an end tag after it, a start tag of these is passed over alone, but for CODE.
RAW = frozenset("script style textarea title noscript template iframe svg object audio video canvas select datalist xmp noembed noframes".split())
BLOCKS = (
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre "
    "figure figcaption nav header footer aside form fieldset legend button label address details summary center dialog menu hgroup"
).split()
BLOCK = frozenset(BLOCKS)
#: Without an end tag, their content runs to the next tag of a block outside the code's strings and comments, or to the end.
CODE = frozenset("script style".split())
CODE_END = re.compile(r"""(?:"(?:[^"\\\n]|\\.)*+"?|'(?:[^'\\\n]|\\.)*+'?|`(?:[^`\\]|\\.)*+`?|//[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/)?)|(</?(?:""" + "|".join(sorted(BLOCK, key=lambda t: (-len(t), t))) + r""")(?=[\s/>]))""", re.S | re.I)
#: An open element of the value is closed by a start of the key.
_P_CLOSERS = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "thead": ("caption",), "option": ("option",)}
_STOPS = frozenset("ul ol dl table body article section div main td th".split())
_CLOSER_STOPS = _STOPS | {"button"}
_BOUNDS = {k: _STOPS.difference(v) for k, v in _IMPLIED.items()}

#: Attribute tokens by what they say; matched as whole words of class, id, role and itemprop values.
LEXICON = (
    ("nav", "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip topbar toolbar"),
    ("head", "header masthead branding logo hero site-header banner top"),
    ("foot", "footer foot copyright legal colophon bottom contentinfo"),
    ("side", "sidebar side aside widget rail complementary related recommended trending popular more tags archive"),
    ("ad", "ad ads advert advertisement sponsor sponsored promo promotion adsense dfp outbrain taboola"),
    ("note", "cookie consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall"),
    ("talk", "comment comments disqus reply replies respond discussion reviews feedback"),
    ("share", "share sharing social follow facebook twitter likes buttons"),
    ("form", "form search login input field"),
    ("meta", "meta byline author date time published info"),
    ("main", "content main article post entry story body text articlebody page-content prose maincontent copy"),
)
_LEX = {w: i for i, (_, ws) in enumerate(LEXICON) for w in ws.split()}
_TAGS = {t: i for i, t in enumerate(BLOCKS)}


class Node:
    __slots__ = ("tag", "parent", "kids", "attrs", "own", "own_link", "text", "link", "tags", "marks", "depth", "at", "keep", "index", "label")

    def __init__(self, tag, parent, attrs):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.kids: list[Node] = []
        self.own = self.own_link = self.text = self.link = self.tags = self.marks = 0
        self.depth = parent.depth + 1 if parent else 0
        self.at = self.index = 0
        self.keep = False
        self.label = None


class Markup:
    """The pieces of markup of a page, one after the other, in time that grows with its length.

    What could be sought in vain from every `<` again is found once: the last `>`, the last end of a
    CDATA section, the last quote of each kind, and where an attribute's quote leads to.
    """

    def __init__(self, html: str):
        self.html = html
        self.last_end, self.last_cdata = html.rfind(">"), html.rfind("]]>")
        self.last_quote = {q: html.rfind(q) for q in "\"'"}
        self.leads: dict[int, int] = {}  # an opening quote -> the `>` that ends its tag, or -1

    def _tag_end(self, pos: int) -> int:
        """The first `>` from pos on outside quotes; -1 if there is none, as a quote stays open."""
        path, end = [], -1
        while pos <= self.last_end:
            m = QUOTE_OR_END.search(self.html, pos)
            at, q = m.start(), m[0]
            if q == ">":
                end = at
                break
            if at in self.leads:
                end = self.leads[at]
                break
            path.append(at)
            if at == self.last_quote[q]:
                break
            pos = self.html.index(q, at + 1) + 1
        for at in path:
            self.leads[at] = end
        return end

    def next(self, pos: int) -> tuple[int, int, str | None, str, str, str] | None:
        """Start and end of the next piece, then its text (CDATA; else None), a slash if it is an end tag, name and attributes (empty for what is no tag)."""
        html = self.html
        while (i := html.find("<", pos)) >= 0:
            pos = i + 1
            if html.startswith("<!--", i):
                j = html.find("-->", i + 4)
                return i, j + 3 if j >= 0 else len(html), None, "", "", ""
            if html.startswith("<![CDATA[", i) and i + 9 <= self.last_cdata:
                j = html.index("]]>", i + 9)
                return i, j + 3, html[i + 9 : j], "", "", ""
            if i > self.last_end:
                continue
            if html.startswith(("<!", "<?"), i):
                if i + 2 > self.last_end:
                    continue
                return i, html.index(">", i + 2) + 1, None, "", "", ""
            m = NAME.match(html, i)
            if m is None or m.end() > self.last_end:
                continue
            j = self._tag_end(m.end())
            if j < 0:
                j = html.index(">", m.end())
            return i, j + 1, None, m[1], m[2], html[m.end() : j]
        return None


def parse(html: str) -> tuple[list[Node], list[tuple[int, str | None]]]:
    """Block nodes in page order (parents first) and the stream of (node index, text), None marking a block's edge.

    Text and inline elements outside every block get an implied block of their own, as `body` tags
    may be left out. End tags of p, li, dt, dd, table parts and option may be missing. Every tag
    looks only at what is open of its own kind (`places`), so deep nesting costs no more.
    """
    root = Node("html", None, "")
    nodes, stream = [root], []
    stack = [("html", root)]
    places: dict[str, list[int]] = {}  # where elements of a name stand on the stack
    links = 0
    pos, end = 0, len(html)
    markup = Markup(html)
    ends: dict[str, int] = {}  # raw element -> where its next end tag begins, or -1 if none follows

    def top(names) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    def push(name: str, node: Node) -> None:
        places.setdefault(name, []).append(len(stack))
        stack.append((name, node))

    def block(name: str, attrs: str) -> None:
        node = Node(name, stack[-1][1], attrs)
        node.index = len(nodes)
        node.at = len(stream)
        nodes.append(node)
        node.parent.kids.append(node)
        stream.append((node.index, None))
        push(name, node)

    def text(s: str) -> None:
        if s:
            s = unescape(s)
            if len(stack) == 1 and s.strip():
                block("body", "")
            stream.append((stack[-1][1].index, s))
            n = len(s) - s.count(" ") if s.strip() else 0
            node = stack[-1][1]
            node.own += n
            if links:
                node.own_link += n
            node.marks += s.count(".") + s.count(",")

    def close(k: int) -> None:
        nonlocal links
        while len(stack) > k:
            tag, _ = stack.pop()
            places[tag].pop()
            if tag in BLOCK:
                stream.append((stack[-1][1].index, None))
            elif tag == "a":
                links -= 1

    while pos < end:
        piece = markup.next(pos)
        if piece is None:
            text(html[pos:])
            break
        start, stop, inside, shut, name, attrs = piece
        if start > pos:
            text(html[pos:start])
        pos = stop
        if inside is not None:
            text(inside)
            continue
        if not name:
            continue
        name = name.lower()
        if shut:
            if name == "body":  # what follows still belongs to it
                continue
            at = top((name,))
            if at and (name in BLOCK or at >= top(_STOPS)):
                close(at)
            continue
        if name in RAW:
            if not attrs.rstrip().endswith("/"):
                if ends.get(name, 0) >= 0 and ends.get(name, 0) < pos + 1:
                    found = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, pos)
                    ends[name], ends["/" + name] = (found.start() + 1, found.end()) if found else (-1, 0)
                if ends[name] >= 0:
                    pos = ends["/" + name]
                elif name in CODE:
                    pos = next((m.start() for m in CODE_END.finditer(html, pos) if m[1]), end)
            continue
        if name == "br":
            text(" ")
            continue
        if name in VOID:
            if name == "hr":
                stream.append((stack[-1][1].index, None))
            continue
        if name in ("html", "head") or name == "body" and places.get("body"):
            continue
        if name in _P_CLOSERS:
            at = top(("p",))
            if at and at > top(_CLOSER_STOPS):
                close(at)
        if name in _IMPLIED:
            # the outermost element to close inside the nearest element that bounds it
            bound = top(_BOUNDS[name])
            low = [places[x][bisect_right(places[x], bound)] for x in _IMPLIED[name] if places.get(x) and places[x][-1] > bound]
            if low:
                close(min(low))
        if name in BLOCK:
            block(name, attrs)
        else:
            if len(stack) == 1:
                block("body", "")
            if name == "a":
                links += 1
            push(name, stack[-1][1])
        stack[-1][1].tags += 1
    return nodes, stream


FEATURES = 44
LONG = 50  # from so many siblings on, their number says no more


def features(nodes: list[Node], stream_len: int) -> np.ndarray:
    """One row per node."""
    for v in nodes:
        v.text, v.link = v.own, v.own_link
    marks = [v.marks for v in nodes]
    tags = [v.tags for v in nodes]
    paras = [1 if v.tag == "p" else 0 for v in nodes]
    for v in reversed(nodes[1:]):
        p = v.parent
        p.text += v.text
        p.link += v.link
        marks[p.index] += marks[v.index]
        tags[p.index] += tags[v.index]
        paras[p.index] += paras[v.index]
    total = nodes[0].text + 1
    out = np.zeros((len(nodes), FEATURES), np.float32)
    above = [None] * len(nodes)
    # rank among the siblings, the sibling before, and the share of siblings of the same tag, once per parent
    rank, before, same = [0] * len(nodes), [None] * len(nodes), [1.0] * len(nodes)
    for p in nodes:
        count: dict[str, int] = {}
        for v in p.kids:
            count[v.tag] = count.get(v.tag, 0) + 1
        for k, v in enumerate(p.kids):
            rank[v.index], before[v.index], same[v.index] = k, p.kids[k - 1] if k else None, count[v.tag] / len(p.kids)
    for v in nodes:
        i = v.index
        own = set()
        if v.attrs:
            for m in ATTR.finditer(v.attrs):
                for w in re.split(r"[^a-z]+", (m[2] or m[3] or m[4] or "").lower()):
                    k = _LEX.get(w)
                    if k is not None:
                        own.add(k)
        kind = {"nav": 0, "header": 1, "footer": 2, "aside": 3, "form": 8, "button": 8, "label": 8, "fieldset": 8, "main": 10, "article": 10, "dialog": 5, "menu": 0}.get(v.tag)
        if kind is not None:
            own.add(kind)
        p = v.parent
        up = above[p.index] if p else frozenset()
        above[i] = up | own if own else up
        row = out[i]
        sib = len(p.kids) if p else 1
        row[0] = _TAGS.get(v.tag, len(_TAGS))
        row[1] = min(v.depth, 30)
        row[2] = math.log1p(v.text)
        row[3] = v.link / (v.text + 1)
        row[4] = v.text / (tags[i] + 1)
        row[5] = v.text / total
        row[6] = math.log1p(v.own)
        row[7] = marks[i] / (v.text + 1) * 100
        row[8] = math.log1p(paras[i])
        row[9] = v.at / (stream_len + 1)
        row[10] = rank[i] / sib
        row[11] = min(sib, LONG)
        row[12] = v.text / (p.text + 1) if p else 1.0
        row[13] = p.link / (p.text + 1) if p else 0.0
        row[14] = math.log1p(p.text) if p else 0.0
        row[15] = _TAGS.get(p.tag, len(_TAGS)) if p else -1
        row[16] = same[i]
        last = before[i]
        row[17] = last.link / (last.text + 1) if last else -1
        row[18] = math.log1p(last.text) if last else -1
        row[19] = len(v.kids)
        row[20] = 1.0 if v.kids else 0.0
        for k in own:
            row[21 + k] = 1
        for k in up:
            row[32 + k] = 1
        row[43] = marks[p.index] / (p.text + 1) * 100 if p else 0
    return out


# ---------------------------------------------------------------- boosted trees
class Boosted:
    """Gradient-boosted regression trees on binned features, logistic loss."""

    def __init__(self, trees: int = 50, depth: int = 5, rate: float = 0.2, bins: int = 32, reg: float = 2.0):
        self.n, self.depth, self.rate, self.bins, self.reg = trees, depth, rate, bins, reg

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(x.shape[1])]
        b = self._bin(x)
        base = float((y * w).sum() / w.sum())
        self.base = math.log(base / (1 - base))
        f = np.full(len(y), self.base)
        size = (1 << (self.depth + 1)) - 1
        self.feat = np.full((self.n, size), -1, np.int32)
        self.cut = np.zeros((self.n, size), np.int32)
        self.value = np.zeros((self.n, size))
        for t in range(self.n):
            p = 1 / (1 + np.exp(-f))
            g, h = (y - p) * w, p * (1 - p) * w
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, count = (1 << level) - 1, 1 << level
                at = node - first
                best_gain = np.full(count, 1e-6)
                gs, hs = np.bincount(at, g, count), np.bincount(at, h, count)
                for j in range(x.shape[1]):
                    if not len(self.cuts[j]):
                        continue
                    k = at * self.bins + b[:, j]
                    gl = np.bincount(k, g, count * self.bins).reshape(count, -1).cumsum(1)
                    hl = np.bincount(k, h, count * self.bins).reshape(count, -1).cumsum(1)
                    gain = gl**2 / (hl + self.reg) + (gs[:, None] - gl) ** 2 / (hs[:, None] - hl + self.reg) - (gs**2 / (hs + self.reg))[:, None]
                    gain[(hl < 1) | (hs[:, None] - hl < 1)] = 0
                    c = gain.argmax(1)
                    top = gain[np.arange(count), c]
                    better = top > best_gain
                    ids = np.flatnonzero(better)
                    best_gain[ids] = top[ids]
                    self.feat[t, first + ids] = j
                    self.cut[t, first + ids] = c[ids]
                ft = self.feat[t, node]
                right = (ft >= 0) & (b[np.arange(len(y)), np.maximum(ft, 0)] > self.cut[t, node])
                node = 2 * node + 1 + right
            last = (1 << self.depth) - 1
            gs, hs = np.bincount(node - last, g, last + 1), np.bincount(node - last, h, last + 1)
            self.value[t, last:] = self.rate * gs / (hs + self.reg)
            f += self.value[t, node]
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        rows = np.arange(len(x))
        f = np.full(len(x), self.base)
        for t in range(self.n):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                ft = self.feat[t, node]
                node = 2 * node + 1 + ((ft >= 0) & (b[rows, np.maximum(ft, 0)] > self.cut[t, node]))
            f += self.value[t, node]
        return f


def decode(nodes: list[Node], margin: np.ndarray) -> None:
    """Set keep on each node: the upward-closed choice of the greatest sum of gains."""
    gain = [0.0] * len(nodes)
    best = [0.0] * len(nodes)
    for v in reversed(nodes):
        # a node's own text weighs by its length; a node without text only leads to others
        g = float(margin[v.index]) * (0.2 + math.log1p(v.own)) if v.index else 0.0
        gain[v.index] = g + sum(best[k.index] for k in v.kids)
        best[v.index] = max(0.0, gain[v.index])
    for v in nodes:
        v.keep = (v.parent.keep if v.parent else True) and (gain[v.index] > 0 or v.index == 0)


def render(nodes: list[Node], stream: list[tuple[int, str | None]]) -> str:
    out, here = [], []
    for i, s in stream:
        if s is None:
            if here:
                out.append(" ".join("".join(here).split()))
                here = []
        elif nodes[i].keep and i:
            here.append(s)
    if here:
        out.append(" ".join("".join(here).split()))
    return "\n\n".join(x for x in out if x)


def extract(pages: list[str | None], model: Boosted) -> list[str]:
    """Main texts of a batch of pages."""
    parsed, mats = [], []
    for h in pages:
        p = parse(h) if h else None
        parsed.append(p)
        if p:
            mats.append(features(p[0], len(p[1])))
    margin = model.margin(np.concatenate(mats)) if mats else None
    out, at = [], 0
    for p in parsed:
        if p is None:
            out.append("")
            continue
        nodes, stream = p
        decode(nodes, margin[at : at + len(nodes)])
        at += len(nodes)
        out.append(render(nodes, stream))
    return out


# ---------------------------------------------------------------- generated pages
class _Maker:
    """Writes pages whose parts are known to be main text (marked data-keep) or not."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, n: int) -> str:
        syl = "the an re in on er ti al or is en es ou la con der sch ion ar ment que ad ver pre ly ing to of und que los".split()
        r = self.r
        out = []
        for i in range(n):
            w = "".join(r.choice(syl) for _ in range(r.randint(1, 4)))
            out.append(w.capitalize() if i == 0 else w + ("," if r.random() < 0.07 else "###" if r.random() < 0.01 else "&amp;" if r.random() < 0.01 else ""))
        return " ".join(out)

    def sentence(self, lo=1, hi=18) -> str:
        return self.words(self.r.randint(lo, hi)) + "."

    def attr(self, *names: str) -> str:
        r = self.r
        if r.random() < 0.25 or not names:
            return r.choice(["", f' class="c{r.randint(1, 99)}"', f' id="x{r.randint(1, 9)}"'])
        n = r.choice(names)
        n = r.choice([n, n, "site-" + n, n + "-wrap", n + "_box", "js-" + n + " block"])
        return f' {r.choice(["class", "class", "id"])}="{n}"'

    def links(self, n: int) -> str:
        r = self.r
        li = [f'<a href="/{self.words(1)}">{self.words(r.randint(1, 4))}</a>' for _ in range(n)]
        k = r.random()
        return "<ul>" + "".join(f"<li>{x}</li>" for x in li) + "</ul>" if k < 0.6 else " | ".join(li) if k < 0.8 else "".join(f"<div>{x}</div>" for x in li)

    def box(self, tag: str, names: tuple[str, ...], inner: str) -> str:
        t = tag if self.r.random() < 0.6 else "div"
        return f"<{t}{self.attr(*names)}>{inner}</{t}>"

    def junk(self, kind: str) -> str:
        r = self.r
        s = self.sentence
        if kind == "nav":
            return self.box("nav", ("nav", "menu", "navbar", "breadcrumbs"), self.links(r.randint(3, 9)))
        if kind == "header":
            return self.box("header", ("header", "masthead", "branding"), f"<div><a href='/'>{self.words(2)}</a></div>" + (f"<p>{s(3, 8)}</p>" if r.random() < 0.5 else "") + (self.links(4) if r.random() < 0.5 else ""))
        if kind == "footer":
            return self.box("footer", ("footer", "copyright", "legal"), r.choice([f"&copy; {self.words(1)}.example.net &middot; {s(3, 12)}", f"<p>&copy; 2024 {self.words(2)}. {s(3, 9)}</p>" + self.links(3), f"<p>{s(4, 14)}</p>"]))
        if kind == "side":
            return self.box("aside", ("sidebar", "widget", "related", "recommended"), f"<h3>{self.words(2)}</h3>" + (self.links(r.randint(3, 7)) if r.random() < 0.6 else f"<p>{s(6, 20)}</p>"))
        if kind == "ad":
            return self.box("div", ("ad", "ads", "advert", "sponsored", "promo"), r.choice([s(4, 14), f"<p>{s(4, 14)}</p>", f"<a href='http://x'>{s(3, 9)}</a>"]))
        if kind == "note":
            return self.box(r.choice(["div", "dialog", "section"]), ("cookie-notice", "consent", "notice", "newsletter", "alert"), f"<p>{s(6, 20)}</p><button>{self.words(1)}</button>" if r.random() < 0.7 else s(5, 16))
        if kind == "form":
            return f"<form{self.attr('search', 'login', 'subscribe')}><label>{self.words(2)}</label><input name='q'><button>{self.words(1)}</button>" + (f"<p>{s(4, 12)}</p>" if r.random() < 0.4 else "") + "</form>"
        if kind == "talk":
            one = lambda: f"<div{self.attr('comment', 'reply')}><b>{self.words(1)}</b><p>{s(4, 25)} {s(2, 15)}</p></div>"
            return self.box("section", ("comments", "discussion", "respond"), f"<h3>{self.words(2)}</h3>" + "".join(one() for _ in range(r.randint(1, 5))))
        return self.box("div", ("share", "social", "follow"), self.links(r.randint(2, 5)))

    def para(self) -> str:
        r = self.r
        n = r.choice([1, 1, 2, 3, 5, 9])
        t = " ".join(self.sentence(1, 18) for _ in range(n))
        if r.random() < 0.15:
            t += f' <a href="/{self.words(1)}">{self.words(2)}</a> ' + self.sentence(1, 9)
        k = r.random()
        return f"<p>{t}</p>" if k < 0.8 else f"<p><b>{t}<br>" if k < 0.9 else f"<p>{t}"

    def body(self) -> str:
        r = self.r
        out = [f"<h1>{self.words(r.randint(1, 9))}</h1>"] if r.random() < 0.85 else []
        if r.random() < 0.15:
            out.append(f"<div{self.attr('byline', 'meta')} data-drop>{self.words(3)}</div>")
        for _ in range(r.choice([1, 2, 4, 7, 12, 20] if r.random() < 0.97 else [60, 90])):
            k = r.random()
            if k < 0.8:
                out.append(self.para())
            elif k < 0.86:
                out.append(f"<h2>{self.words(r.randint(1, 6))}</h2>")
            elif k < 0.9:
                out.append("<ul>" + "".join(f"<li>{self.sentence(2, 12)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif k < 0.93:
                out.append(f"<blockquote><p>{self.sentence(4, 20)}</p></blockquote>")
            elif k < 0.95:
                out.append("<table><tr>" + "".join(f"<td>{self.words(2)}</td>" for _ in range(3)) + "</tr></table>")
            elif k < 0.97:
                out.append(f"<figure><figcaption>{self.sentence(3, 9)}</figcaption></figure>")
            else:
                out.append(re.sub(r"^<(\w+)", r"<\1 data-drop", self.junk(r.choice(["ad", "side", "share", "note", "form"]))))
        return "".join(out)

    def bare(self) -> str:
        """A page whose text stands in the body itself: paragraphs, or lines between breaks and inline elements."""
        r = self.r
        lines = [" ".join(self.sentence(2, 18) for _ in range(r.choice([1, 2, 4]))) for _ in range(r.choice([1, 2, 5, 9]))]
        paras = r.choice([0.0, 0.4, 1.0])
        lines = [f"<{t}>{x}</{t}>" if (t := r.choice(["span", "b", "font", ""])) else x for x in lines]
        text = "".join(self.para() if r.random() < paras else x + "<br>" for x in lines)
        junk = lambda kinds: "".join(re.sub(r"^<(\w+)", r"<\1 data-drop", self.junk(k)) for k in kinds if r.random() < 0.5)
        return f"<html><body data-keep>{junk(('header', 'nav', 'ad'))}{text}{junk(('share', 'talk', 'footer'))}</body></html>"

    def page(self) -> str:
        r = self.r
        if r.random() < 0.05:
            return self.bare()
        main = self.body()
        tag = r.choice(["article", "article", "main", "div", "section"])
        main = f"<{tag}{self.attr('content', 'article', 'post', 'entry-content', 'story', 'main', 'text')} data-keep>{main}</{tag}>"
        if r.random() < 0.4:
            main = f"<{r.choice(['main', 'div'])}{self.attr('main', 'content', 'container')}>{main}" + (self.junk("talk") if r.random() < 0.4 else "") + (self.junk("side") if r.random() < 0.3 else "") + "</div>"
        top = [self.junk(k) for k in ("note", "header", "nav", "ad", "form") if r.random() < 0.5]
        low = [self.junk(k) for k in ("share", "talk", "side", "ad", "form", "nav", "note") if r.random() < 0.35] + ([self.junk("footer")] if r.random() < 0.85 else [])
        wrap = r.random() < 0.3
        return f"<!DOCTYPE html><html><head><title>{self.words(4)}</title><style>p{{}}</style></head><body>{'<div id=page>' if wrap else ''}{''.join(top)}{main}{''.join(low)}{'</div>' if wrap else ''}</body></html>"


def _labelled(page: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    nodes, stream = parse(page)
    x = features(nodes, len(stream))
    state = [0] * len(nodes)
    for v in nodes[1:]:
        s = state[v.parent.index]
        state[v.index] = 0 if s < 0 or " data-drop" in v.attrs else 1 if " data-keep" in v.attrs else s
        if " data-drop" in v.attrs:
            state[v.index] = -1
        elif s < 0:
            state[v.index] = -1
    y = [1 if s > 0 else 0 for s in state]
    for v in reversed(nodes[1:]):
        if y[v.index]:
            y[v.parent.index] = 1  # an ancestor of main text must stay
    w = [1.0 + 0.3 * math.log1p(v.own) for v in nodes]
    return x[1:], np.array(y[1:], float), np.array(w[1:])


@lru_cache(maxsize=2)
def train(pages: int = 900, seed: int = 5) -> Boosted:
    maker = _Maker(seed)
    parts = [_labelled(maker.page()) for _ in range(pages)]
    return Boosted().fit(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]))


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text and n_chars of every row.

    Null, empty and text-free pages give an empty text; rows are independent, so repeated rows and
    null keys repeat; other columns are ignored; an empty table gives no rows. A page of any length
    and depth is read whole, in time that grows with its length.
    """
    shared = pages.sparkSession.sparkContext.broadcast(train())
    kinds = {f.name: f.dataType.simpleString() for f in pages.select(key, url).schema}

    def run(batches):
        model = shared.value
        for b in batches:
            for i in range(0, max(1, b.num_rows), 256):
                c = b.slice(i, 256)
                texts = extract(c.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, url, "text", "n_chars"])

    return pages.select(key, url, html).mapInArrow(run, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars bigint")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
