"""Main text of web pages, by a tree-structured graphical model over their elements.

A page is read into a tree of block elements whose leaves are its runs of text (``Tree``).
Every node has a hidden state: 1 if it holds main text, 0 if not. A node's own potential
comes from what can be seen there: element, words of its class, id and role, length, links,
punctuation, place. Parent and child are tied by a potential for each pair of states, by
kind of child. Sum-product messages go from the leaves to the root and back, one pass each
over all pages of a slice, depth by depth, and give every node's marginal (``marginals``).
Runs of text with a marginal of a half or more are the text.

The model is fitted by conditional likelihood, whose gradient needs the same messages
(``fitted``). Labelled pages are made from a bounded sample of the table: ``TRAINING`` pages
of at most ``LONGEST`` characters, drawn by hash. Each is used as it is, its ``article`` or
``main`` element labelled as text, and ``LAYOUTS`` times more with its paragraphs set into
other layouts, among menus, notices, adverts, forms, side bars and comments made of other
pages' words, with and without telling names. Every page of the table is then read whole.

Defined cases:

- a null or empty page has an empty text; a null id or url is passed on; repeated rows are
  extracted each by itself; other columns are not read; an empty table gives an empty result;
- broken markup: unclosed paragraphs, items and cells end where the next begins, end tags
  without an element are passed over, an unfinished comment, script or tag runs to the end;
- elements nested over ``DEEPEST`` deep count as children of the last one above; none is lost;
- scripts, styles, titles, buttons, selections, embedded objects are no text at all;
- character references are decoded; any Unicode white space in a block becomes one space.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwise.llm import textbytes as tb

TRAINING, LONGEST, LAYOUTS = 160, 1 << 13, 3
STEPS, RATE, RIDGE = 200, 0.12, 2e-4
DEEPEST = 400
SLICE = 1 << 20

# fixed values: HTML's element classes
GROUPS = ["other", "html body", "article", "main", "section", "div center", "p", "h1", "h2 h3 h4 h5 h6", "ul ol menu dir", "li",
          "table thead tbody tfoot tr td th caption", "blockquote pre", "nav", "header", "footer", "aside", "form fieldset",
          "figure figcaption", "dl dt dd", "address details summary dialog"]
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
DROPPED = frozenset("svg math select button template noscript object video audio canvas datalist".split())
UNSEEN = frozenset("script style title template noscript svg math".split())       # not even a gap in a word
# an open element of the first kind ends before a start tag of these, up to an element of the last
CLOSES = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"),
          "th": ("td th", "tr table"), "tbody": ("thead tbody tfoot tr td th", "table"), "thead": ("thead tbody tfoot tr td th", "table"),
          "tfoot": ("thead tbody tfoot tr td th", "table")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# fixed values: words of class, id and role that name a part of a page
CUES = ["article content main post entry story text body prose",
        "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc tabs links",
        "header masthead topbar logo branding tagline",
        "footer copyright legal colophon contentinfo bottom imprint",
        "sidebar side aside rail widget widgets complementary column",
        "notice notices cookie cookies consent gdpr alert popup modal overlay message warning paywall dialog",
        "ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion banner commercial",
        "form newsletter subscribe subscription signup login search contact register",
        "share sharing social follow tweet like",
        "related recommended recommendations trending popular teaser also more latest",
        "comment comments reply replies respond discussion disqus thread feedback reactions responses reader",
        "meta byline author date tags category timestamp credits",
        "hidden invisible sr none"]

_GROUP = {t: i for i, g in enumerate(GROUPS) for t in g.split()}
_CUE = {w: 1 << i for i, c in enumerate(CUES) for w in c.split()}
_SEMANTIC = frozenset("nav header footer aside form fieldset menu address dialog".split())
_FLOW = frozenset("p li ul ol dir blockquote pre table thead tbody tfoot tr td th caption dl dt dd figure figcaption h1 h2 h3 h4 h5 h6".split())
LEAF, FLOW, CONTAINER, SEMANTIC = range(4)

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*'|["'])*+)(?:>|\Z)|<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|(?<=[\s"'/]))(class|id|role|hidden|style|aria-hidden|data-label)(?![\w-])\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
_SENTENCE = re.compile(r"[.!?,;:。！？，]")
_ENDS = (".", "!", "?", "。", "！", "？", ".”", '."', ":", "…")

# columns of a node
PARENT, DEPTH, KIND, OF_GROUP, OF_CUES, CHARS, LINKED, MARKS, DIGITS, END, SIGN, INPUTS, LABEL = range(13)


def seen(name: str, attributes: str) -> tuple[int, int, int]:
    """(element group, named parts as bits, label or -1) of a start tag."""
    cues, label = 0, -1
    for k, a, b, c in _ATTRIBUTE.findall(attributes):
        k, v = k.lower(), a or b or c
        if k == "data-label":
            label = int(v == "1")
        elif k == "style":
            cues |= _CUE["hidden"] if _NOT_SHOWN.search(v) else 0
        elif k in ("hidden", "aria-hidden"):
            cues |= _CUE["hidden"] if v.lower() != "false" else 0
        else:
            for w in _WORD.findall(v):
                cues |= _CUE.get(w.lower(), 0)
    return _GROUP.get(name, 0), cues, label


class Tree:
    """Nodes and texts of the pages of a slice."""

    def __init__(self):
        self.nodes: list[list] = []
        self.texts: list[str] = []      # of the leaves, in the order of ``leaves``
        self.leaves: list[int] = []
        self.roots: list[int] = []
        self.cache: dict[tuple, tuple] = {}

    def add(self, page: str) -> None:
        nodes, cache = self.nodes, self.cache
        root = len(nodes)
        self.roots.append(root)
        nodes.append([-1, 0, CONTAINER, 1, 0, 0, 0, 0, 0, 0, 0, 0, -1])
        names, stack = ["#"], [root]            # open elements
        run: list[str] = []                     # text since the last block boundary
        linked, link_at = 0, 0                  # its characters in links; depth of the open link, 0 if none
        absent: set[str] = set()
        at, n = 0, len(page)

        def flush():
            nonlocal linked
            if run:
                raw = "".join(run)
                run.clear()
                text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
                if text:
                    size = len(text)
                    up = stack[-1]
                    self.leaves.append(len(nodes))
                    self.texts.append(text)
                    nodes.append([up, nodes[up][DEPTH] + 1, LEAF, 0, 0, size, min(linked, size), len(_SENTENCE.findall(text)),
                                  sum(map(text.count, "0123456789")), text.endswith(_ENDS), "\xa9" in text, 0, -1])
            linked = 0

        def pop(to: int):
            nonlocal link_at
            del names[to:], stack[to:]
            if link_at > to:
                link_at = 0

        while at < n:
            m = _TAG.search(page, at)
            end = m.start() if m else n
            if end > at:
                run.append(page[at:end])
                if link_at:
                    linked += end - at
            if not m:
                break
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                if name == "a":
                    link_at = 0
                elif name not in INLINE and name in names:
                    flush()
                    i = len(names) - 1
                    while names[i] != name:
                        i -= 1
                    pop(i)
                elif name == "p":
                    flush()
                elif name == "br":
                    run.append(" ")
                continue
            if name in RAW or name in DROPPED:
                if name not in absent:
                    close = _close(name).search(page, at)
                    if close:
                        at = close.end()
                    elif name in RAW:
                        at = n
                    else:
                        absent.add(name)
                nodes[stack[-1]][INPUTS] += name in ("textarea", "select", "button")
                if name not in UNSEEN:
                    run.append(" ")
                continue
            if name in VOID:
                if name == "input":
                    nodes[stack[-1]][INPUTS] += 1
                if name == "hr":
                    flush()
                elif name == "br":
                    run.append(" ")
                continue
            if name in INLINE:
                if name == "a":
                    link_at = len(names)
                continue
            flush()
            if names[-1] == "p" or name in HEADINGS and names[-1] in HEADINGS:
                pop(len(names) - 1)
            elif name in CLOSES:
                ends, upto = CLOSES[name]
                i, found = len(names) - 1, 0
                while i and names[i] not in upto:
                    if names[i] in ends:
                        found = i
                    i -= 1
                if found:
                    pop(found)
            if len(stack) > DEEPEST:
                continue
            key = (name, m[3])
            got = cache.get(key)
            if got is None:
                if len(cache) > 20_000:
                    cache.clear()
                got = cache[key] = seen(name, m[3])
            up = stack[-1]
            kind = FLOW if name in _FLOW else SEMANTIC if name in _SEMANTIC else CONTAINER
            stack.append(len(nodes))
            names.append(name)
            nodes.append([up, nodes[up][DEPTH] + 1, kind, got[0], got[1], 0, 0, 0, 0, 0, 0, 0, got[2]])
        flush()


_CLOSERS: dict[str, re.Pattern] = {}


def _close(name: str) -> re.Pattern:
    if name not in _CLOSERS:
        _CLOSERS[name] = re.compile(rf"</{name}(?![\w-])[^>]*(?:>|\Z)", re.I)
    return _CLOSERS[name]


NAMED = len(GROUPS) + len(CUES)
FEATURES = NAMED + 8 + 11       # element names and parts, figures of elements, figures of leaves


class Forest:
    """The nodes of many pages, ready for message passing."""

    def __init__(self, tree: Tree):
        self.node = np.array(tree.nodes, np.int64).reshape(-1, LABEL + 1)
        self.parent, self.kind = self.node[:, PARENT], self.node[:, KIND]
        self.roots = np.array(tree.roots, np.int64)
        self.page = np.repeat(np.arange(len(self.roots)), np.diff(np.append(self.roots, len(self.node))))
        depth = self.node[:, DEPTH]
        o = np.argsort(depth, kind="stable")
        cut = np.searchsorted(depth[o], np.arange(1, depth.max(initial=0) + 2))
        self.levels = [o[a:b] for a, b in zip(cut[:-1], cut[1:])]       # below the roots
        x = self._features()
        # from here on nodes are numbered by depth, so that a level is a slice
        place = np.empty(len(o), np.int64)
        place[o] = np.arange(len(o))
        self.leaves = place[np.array(tree.leaves, np.int64)]            # in page order
        self.node, self.x, self.page, self.kind = self.node[o], x[o], self.page[o], self.kind[o]
        self.parent = np.where(self.parent >= 0, place[self.parent], -1)[o]
        self.roots = place[self.roots]
        self.levels = [slice(a, b) for a, b in zip(cut[:-1], cut[1:])]

    def raised(self, values: np.ndarray) -> np.ndarray:
        """Sums of ``values`` over each node's subtree."""
        out = values.astype(np.float64)
        for level in reversed(self.levels):
            self.add_up(out, level, out[level])
        return out

    def add_up(self, out: np.ndarray, level: np.ndarray, values: np.ndarray) -> None:
        """Adds the values of a level's nodes to their parents; siblings lie side by side."""
        up = self.parent[level]
        at = np.flatnonzero(np.append(True, up[1:] != up[:-1]))
        out[up[at]] += np.add.reduceat(values, at, axis=0)

    def _features(self) -> np.ndarray:
        f = self.node
        n = len(f)
        x = np.zeros((n, FEATURES), np.float32)
        leaf = self.kind == LEAF
        inner = np.flatnonzero(~leaf)
        x[inner, f[inner, OF_GROUP]] = 1
        for i in range(len(CUES)):
            x[:, len(GROUPS) + i] = f[:, OF_CUES] >> i & 1
        below = self.raised(np.concatenate([f[:, [CHARS, LINKED, MARKS, INPUTS]], leaf[:, None]], axis=1))
        chars, links, marks, inputs, runs = below.T
        whole = np.maximum(chars[self.roots][self.page], 1)
        some = np.maximum(chars, 1)
        before = np.cumsum(f[:, CHARS]) - f[:, CHARS]
        place = (before - before[self.roots][self.page]) / whole
        rate = np.minimum(25 * marks / some, 1)
        a = NAMED
        for i, v in enumerate([np.ones(n), np.log1p(chars) / 8, chars / whole, links / some, rate, np.minimum(inputs, 3) / 3,
                               np.log1p(chars / np.maximum(runs, 1)) / 6, place]):
            x[inner, a + i] = v[inner]
        a += 8
        for i, v in enumerate([np.ones(n), np.log1p(chars) / 6, chars < 30, links / some, f[:, END], rate, f[:, DIGITS] / some,
                               f[:, SIGN], place, chars / whole, place > 0.9]):
            x[leaf, a + i] = v[leaf]
        return x


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(forest: Forest, weights: np.ndarray, edges: np.ndarray, pairs: bool = False):
    """Probability of state 1 for every node, by sum-product; ``edges`` is the log potential
    by kind of child, state of the parent, state of the child. With ``pairs``, also the joint
    probabilities of parent and child, summed by kind, and the log partition sum."""
    n = len(forest.node)
    own = np.zeros((n, 2))
    own[:, 1] = forest.x @ weights.astype(np.float32)
    up = np.zeros((n, 2))               # message to the parent, by its state
    for level in reversed(forest.levels):
        e = edges[forest.kind[level]]
        up[level] = _both(own[level, None, 0] + e[:, :, 0], own[level, None, 1] + e[:, :, 1])
        forest.add_up(own, level, up[level])
    belief = own.copy()
    joint = np.zeros(edges.shape)
    for level in forest.levels:
        rest = belief[forest.parent[level]] - up[level]
        e = edges[forest.kind[level]]
        belief[level] += _both(rest[:, 0, None] + e[:, 0], rest[:, 1, None] + e[:, 1])
        belief[level] -= belief[level].max(axis=1, keepdims=True)
        if pairs:
            p = rest[:, :, None] + e + own[level][:, None, :]
            p = np.exp(p - p.max(axis=(1, 2), keepdims=True))
            p /= p.sum(axis=(1, 2), keepdims=True)
            for k in range(len(edges)):
                joint[k] += p[forest.kind[level] == k].sum(axis=0)
    p = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
    if not pairs:
        return p
    roots = own[forest.roots]
    return p, joint, float(_both(roots[:, 0], roots[:, 1]).sum())


def labels(forest: Forest) -> np.ndarray:
    """State of every node of labelled pages: a run of text has the label of the nearest
    labelled element above it, an element holds main text if anything in it does."""
    y = np.where(forest.node[:, LABEL] < 0, 0, forest.node[:, LABEL])
    for level in forest.levels:
        y[level] = np.where(forest.node[level, LABEL] < 0, y[forest.parent[level]], y[level])
    y[forest.kind != LEAF] = 0
    return (forest.raised(y) > 0).astype(np.int64)


def likelihood(forest: Forest, y: np.ndarray, weights: np.ndarray, edges: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of the states ``y``, and its gradient by weights and by edges."""
    p, joint, total = marginals(forest, weights, edges, pairs=True)
    seen_pairs = np.zeros(edges.shape)
    child = np.flatnonzero(forest.parent >= 0)
    at = (forest.kind[child], y[forest.parent[child]], y[child])
    np.add.at(seen_pairs, at, 1)
    value = float((forest.x @ weights.astype(np.float32))[y == 1].sum() + edges[at].sum() - total)
    return value, ((y - p).astype(np.float32) @ forest.x).astype(np.float64), seen_pairs - joint


def fitted(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(weights, edges) that make the labels of the pages most likely; Adam steps."""
    if not pages:
        return np.zeros(FEATURES), np.zeros((4, 2, 2))
    tree = Tree()
    for page in pages:
        tree.add(page)
    forest = Forest(tree)
    y = labels(forest)
    v, m, s = np.zeros(FEATURES + 16), 0.0, 0.0
    for step in range(1, STEPS + 1):
        _, gw, ge = likelihood(forest, y, v[:FEATURES], v[FEATURES:].reshape(4, 2, 2))
        g = np.concatenate([gw, ge.ravel()]) / len(pages) - RIDGE * v
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        v = v + RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)
    return v[:FEATURES], v[FEATURES:].reshape(4, 2, 2)


class Layouts:
    """Labelled pages out of paragraphs: ``data-label`` says where the main text begins and ends."""

    def __init__(self, words: list[str], seed: int = 7):
        self.rng, self.spare = np.random.default_rng(seed), words or ["text"]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def pick(self, options: list):
        return options[int(self.rng.integers(len(options)))]

    def some(self, low: int, high: int) -> str:
        """That many words from anywhere in the sample."""
        words = self.pick(self.spare).split()
        n = int(self.rng.integers(low, high + 1))
        a = int(self.rng.integers(max(len(words) - n, 0) + 1))
        return " ".join(words[a:a + n])

    def box(self, tags: str, names: str, inside: str, label: int | None = None) -> str:
        """An element, with a telling name or element two times out of three."""
        tag = self.pick(tags.split()) if self.told else "div"
        name = self.pick(names.split()) if names and self.told and (tag == "div" or self.chance(0.5)) else ""
        where = "" if not name else f' {self.pick(["class", "class", "id"])}="{name}{self.pick(["", "", "-wrap", "Box", "1"])}"'
        return f"<{tag}{where}{'' if label is None else f' data-label={label}'}>{inside}</{tag}>"

    def links(self, low: int, high: int) -> str:
        items = [f'<li><a href="/x">{self.some(1, 4)}</a></li>' for _ in range(int(self.rng.integers(low, high + 1)))]
        return f"<ul>{''.join(items)}</ul>" if self.chance(0.8) else " | ".join(f'<a href="/x">{self.some(1, 3)}</a>' for _ in items)

    def paragraphs(self, low: int, high: int, size: tuple[int, int] = (6, 60)) -> str:
        return "".join(f"<p>{self.some(*size)}</p>" for _ in range(int(self.rng.integers(low, high + 1))))

    def advert(self) -> str:
        return self.box("div div aside section", "ad ads advert promo sponsored banner-ad", self.some(4, 25) if self.chance(0.6) else f'<p>{self.some(4, 25)}</p><a href="/x">{self.some(1, 4)}</a>', 0)

    def form(self) -> str:
        tag = "form" if self.chance(0.8) else "div"
        return f'<{tag} data-label=0><p>{self.some(3, 15)}</p><label>{self.some(1, 2)} <input name="q"></label><input type="submit"><button>{self.some(1, 2)}</button></{tag}>'

    def notice(self) -> str:
        return self.box("div div section p", "notice cookie-consent alert gdpr-message paywall popup", self.some(6, 30) + (f' <a href="/x">{self.some(1, 2)}</a>' if self.chance(0.5) else ""), 0)

    def related(self) -> str:
        return self.box("div aside section", "related recommended more-stories trending share-links social", f"<h3>{self.some(1, 3)}</h3>" + self.links(2, 6), 0)

    def comments(self) -> str:
        each = ["".join([f'<div class="{"comment" if self.told else "c"}">', f"<b>{self.some(1, 2)}</b> <span>{int(self.rng.integers(1, 29))}.{int(self.rng.integers(1, 13))}.2024</span>",
                         self.paragraphs(1, 2, (4, 50)), f'<a href="/x">{self.some(1, 1)}</a></div>']) for _ in range(int(self.rng.integers(1, 6) if self.chance(0.8) else self.rng.integers(10, 40)))]
        told, self.told = self.told, self.told or self.chance(0.7)
        out = self.box("section div div ol", "comments comment-list replies discussion responses reader-comments", f"<h3>{self.some(1, 2)}</h3>" + "".join(each), 0)
        self.told = told
        return out

    def body(self, title: str, paragraphs: list[str]) -> str:
        out = [f"<h1>{title}</h1>"] if self.chance(0.9) else []
        for p in paragraphs:
            if self.chance(0.1):
                out.append(f"<h2>{self.some(1, 6)}</h2>")
            kind = self.rng.random()
            p = html.escape(p, quote=False)
            if self.chance(0.15) and len(p.split()) > 6:
                w = p.split()
                w[2] = f'<a href="/x">{w[2]}</a>'
                p = " ".join(w)
            out.append(f"<p>{p}</p>" if kind < 0.82 else f"<p>{p}" if kind < 0.86 else f"<blockquote><p>{p}</p></blockquote>" if kind < 0.9
                       else f"<ul><li>{p}</li><li>{self.some(3, 20)}</li></ul>" if kind < 0.95 else f"<div>{p}</div>" if kind < 0.98
                       else f"<table><tr><td>{p}</td><td>{self.some(1, 4)}</td></tr></table>")
            if self.chance(0.08):
                out.append(self.pick([self.advert, self.form, self.related, self.notice])())
        return "".join(out)

    def page(self, title: str, paragraphs: list[str]) -> str:
        self.told = self.chance(0.7)
        if self.chance(0.15):           # lists of names, verse, talk: very many short lines
            paragraphs = [self.some(1, 4) for _ in range(int(self.rng.integers(10, 120)))]
        elif self.chance(0.1):
            paragraphs = paragraphs[:1]
        text = self.body(title, paragraphs)
        tail = self.comments() if self.chance(0.4) else ""
        inside = self.chance(0.3)
        content = text + (tail if inside else "")
        kind = self.rng.random()
        content = (f"<article data-label=1>{content}</article>" if kind < 0.35 else f"<main data-label=1>{content}</main>" if kind < 0.5
                   else f"<table><tr><td data-label=1>{content}</td></tr></table>" if kind < 0.53
                   else self.box("div section", "content article-body post entry-content story main text", content, 1))
        tail = "" if inside else tail
        top = [self.box("nav nav div", "nav menu navbar", self.links(3, 9), 0)]
        if self.chance(0.5):
            top.insert(0, self.box("header header div", "header masthead", f"<{self.pick(['h1', 'p', 'div'])}>{self.some(1, 4)}</div>" + (f"<p>{self.some(3, 12)}</p>" if self.chance(0.5) else ""), 0))
        if self.chance(0.3):
            top.append(self.notice())
        if self.chance(0.5):
            top.append(self.advert())
        if self.chance(0.25):
            top.append(self.form())
        side = self.box("aside aside div", "sidebar side-rail widget", f"<h3>{self.some(1, 3)}</h3>{self.links(2, 6)}" + (self.paragraphs(1, 2, (5, 30)) if self.chance(0.6) else ""), 0) if self.chance(0.5) else ""
        foot = self.box("footer footer div", "footer copyright legal", f"{self.pick(['&copy;', '©', ''])} {self.some(1, 3)} 20{int(self.rng.integers(10, 27))} {self.pick(['&middot;', '|', ''])} {self.some(3, 25)}" + (self.links(2, 5) if self.chance(0.4) else ""), 0)
        inner = content + tail + (self.related() if self.chance(0.3) else "")
        if self.chance(0.4):
            inner = f"<div>{side + inner if self.chance(0.4) else inner + side}</div>"
        else:
            inner += side
        if self.chance(0.3):
            inner = f"<div>{inner}</div>"
        return f"<html><head><title>{title}</title></head><body>{''.join(top)}{inner}{foot}" + ("</body></html>" if self.chance(0.8) else "")


_MAIN = re.compile(r"<(article|main)(?=[\s>])", re.I)


def training_pages(pages: list[str]) -> list[str]:
    """Labelled pages made from a sample."""
    out, contents = [], []
    for page in pages:
        marked = _MAIN.sub(r"<\1 data-label=1", page, count=1)
        tree = Tree()
        tree.add(marked)
        forest = Forest(tree)
        y = labels(forest)[forest.leaves]
        if y.any():
            out.append(marked)
        texts = [t for t, own in zip(tree.texts, y) if own] or tree.texts
        if texts:
            contents.append(texts)
    made = Layouts([t for texts in contents for t in texts])
    for _ in range(LAYOUTS):
        out += [made.page(html.escape(texts[0]), texts[1:] or texts) for texts in contents]
    return out


def model(pages: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The model fitted on labelled pages made from a bounded sample of ``pages`` (page_id,
    url, html): a share of the rows by hash, some ``8 * TRAINING``, of which the driver gets
    ``TRAINING`` different pages."""
    share = min(1.0, 8 * TRAINING / max(pages.count(), 1))
    short = pages.where(F.length("html") <= LONGEST)
    drawn = (short.where(F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(1 << 31)) <= int(share * (1 << 31)))
             .groupBy(F.xxhash64("html").alias("h")).agg(F.first("html").alias("html")).orderBy("h").limit(TRAINING).collect())
    # nothing drawn: nearly all rows are copies of a few
    return fitted(training_pages([r.html for r in drawn or short.limit(TRAINING).collect()]))


TEXTS = "page_id long, url string, text string, n_chars long, n_runs long, n_kept long"


def _extract(weights: np.ndarray, edges: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches, "html", SLICE):
            tree = Tree()
            for page in batch.column("html").to_pylist():
                tree.add(page or "")
            forest = Forest(tree)
            keep = marginals(forest, weights, edges)[forest.leaves] >= 0.5
            page = forest.page[forest.leaves]
            n = batch.num_rows
            first = np.searchsorted(page, np.arange(n + 1))
            texts = [" ".join(t for t, k in zip(tree.texts[a:b], keep[a:b]) if k) for a, b in zip(first[:-1], first[1:])]
            kept = np.bincount(page[keep], minlength=n)
            cols = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(np.diff(first), pa.int64()), pa.array(kept, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in TEXTS.split(", ")])
    return run


def main_text(pages: DataFrame) -> DataFrame:
    """Main text of every page (page_id, url, html): page_id, url, text, n_chars (code
    points), n_runs (runs of text in the page) and n_kept (those in the text)."""
    tb.text_session(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(_extract(*model(pages)), TEXTS)


def op11_tree_model(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
