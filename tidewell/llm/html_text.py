"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

A tolerant parser builds the tree of block elements.  Each node gets a vector: its tag's kind, tokens
of its attributes and its ancestors', depth, size, link and mark density of its subtree, place in
the page and its share among its siblings.  Boosted regression trees, trained here on generated
pages of known structure, give the probability that a node belongs to the article.

Decoding picks the likeliest labelling of the whole tree in which nothing below a dropped part of
the article is kept: a node is outside (its children may be), article (its children are, or are
dropped) or dropped (so are its children).  The article's blocks are then written in page order.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements of HTML by what they mean for text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea".split())
#: Left out with their content, too, but without an end tag of their own only the tag is.
EMBEDDED = frozenset("noscript iframe template svg object canvas audio video annotation annotation-xml".split())
MATH = frozenset("math semantics mrow mi mn mo ms mtext mspace mstyle mpadded mphantom mfenced menclose merror maction mfrac msqrt mroot msup msub msubsup mover munder munderover mmultiscripts mprescripts none mtable mtr mlabeledtr mtd".split())
INLINE = MATH | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rt rp s samp small span strike strong sub sup time tt u var img br wbr".split())
#: An opening tag on the left closes an open element on the right.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "body": ("head",)}
#: Elements past which no implied end tag reaches.
WALLS = frozenset("table ul ol dl article section div main body html aside nav footer header form blockquote figure select".split())
CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label|data-component|hidden|style)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_SPLIT = re.compile(r"[^a-z]+")

#: Attribute tokens by group.
GROUPS = {
    "content": "article content main post body entry text story blog paragraph copy maincontent".split(),
    "nav": "nav navigation menu navbar breadcrumb breadcrumbs pagination pager toc tabs links skip".split(),
    "edge": "header footer masthead topbar bottom head foot copyright legal colophon".split(),
    "side": "sidebar side aside widget related recommended more rail secondary complementary".split(),
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo banner promotion".split(),
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay dialog toast warning message".split(),
    "comment": "comment comments reply replies discussion disqus respond reader feedback review reviews".split(),
    "form": "form newsletter subscribe signup login search contact subscription".split(),
    "social": "share sharing social follow tweet facebook author byline meta tags".split(),
}
_GROUP_OF = {t: g for g, ts in enumerate(GROUPS.values()) for t in ts}
#: Kinds of tags.
KINDS = {"article": 0, "main": 0, "nav": 1, "menu": 1, "header": 2, "footer": 2, "aside": 3, "form": 4, "button": 4, "select": 4, "option": 4, "textarea": 4, "label": 4, "fieldset": 4, "input": 4, "p": 5, "blockquote": 5, "pre": 5, "h1": 6, "h2": 6, "h3": 6, "h4": 6, "h5": 6, "h6": 6, "ul": 7, "ol": 7, "dl": 7, "li": 8, "dt": 8, "dd": 8, "table": 9, "tr": 9, "td": 9, "th": 9, "thead": 9, "tbody": 9, "section": 10, "div": 11, "figure": 12, "figcaption": 12, "head": 13, "body": 14, "html": 14, "dialog": 3}
#: Of these, navigation, header or footer, aside and form.
EDGE_KINDS = (1, 2, 3, 4)
N_GROUPS = len(GROUPS)


class Node:
    __slots__ = ("tag", "kind", "parent", "children", "content", "groups", "above", "depth", "chars", "links", "marks", "blocks", "before", "index", "hidden", "edges")

    def __init__(self, tag: str, parent: Node | None, attributes: str):
        self.tag, self.parent, self.kind = tag, parent, KINDS.get(tag, 15)
        self.children: list[Node] = []
        #: Text pieces and child nodes in page order.
        self.content: list = []
        #: Attribute groups of the node, and of its ancestors; ancestors' kinds that are edges of a page.
        self.groups = self.above = self.edges = 0
        self.hidden = False
        if attributes:
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                name = name.lower()
                value = (a or b or c).lower()
                if name == "style":
                    self.hidden |= "display:none" in value.replace(" ", "")
                elif name == "hidden":
                    self.hidden = True
                else:
                    for t in _SPLIT.split(value):
                        g = _GROUP_OF.get(t)
                        if g is not None:
                            self.groups |= 1 << g
        self.depth = parent.depth + 1 if parent else 0
        self.chars = self.links = self.marks = self.blocks = self.before = self.index = 0
        if parent is not None:
            self.above = parent.above | parent.groups
            self.edges = parent.edges | (1 << (parent.kind - 1) if parent.kind in EDGE_KINDS else 0)
            self.index = len(parent.children)
            parent.children.append(self)
            parent.content.append(self)


class _Open:
    """The open elements from the root down, found by tag in constant time."""

    def __init__(self, root: Node):
        self.path = [root]
        self.at: dict[str, list[int]] = {}
        self.walls = [0]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.path))
        if node.tag in WALLS:
            self.walls.append(len(self.path))
        self.path.append(node)

    def close(self, depth: int) -> None:
        """Closes the element at this place of the path and all below it."""
        while len(self.path) > depth:
            tag = self.path.pop().tag
            self.at[tag].pop()
            if tag in WALLS:
                self.walls.pop()

    def last(self, tags: tuple[str, ...]) -> int:
        """The place of the innermost open element of these tags; 0 if there is none."""
        return max((places[-1] for t in tags if (places := self.at.get(t))), default=0)


def parse(source: str | None) -> Node:
    """The tree of block elements; scripts, styles and other raw elements are left out.

    A raw element without end tag takes the rest of the page with it, as HTML prescribes; of an
    embedded one (video, svg, iframe, ...) only the tag is left out then. The text of math stays,
    without its annotations. Text keeps its references; an unfinished tag at the end is dropped, and
    so is an end tag that nothing open has. Linear in the page, but for attributes of unclosed quotes.
    """
    root = Node("#root", None, "")
    now, link, at, source = root, 0, 0, source or ""
    opened, raw = _Open(root), None
    ends_of: dict[str, dict[int, int]] = {}
    for m in _TOKEN.finditer(source):
        if m.start() < at:
            continue
        if m.start() > at:
            _text(now, source[at : m.start()], link)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing = tag.lower(), (m[1] or m[4]) == "/"
        attributes = m[3] or m[6] or ""
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                raw = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = raw.end() if raw else len(source)
            continue
        if tag in EMBEDDED:
            if not closing and not attributes.endswith("/"):
                if tag not in ends_of:
                    ends_of[tag] = _ends(source, tag, m.start())
                at = ends_of[tag].get(m.start(), at)
            continue
        if tag == "a":
            link = 0 if closing else 1
        if tag in INLINE:
            if tag == "br":
                now.content.append(" ")
            continue
        if closing:
            if place := opened.last((tag,)):
                opened.close(place)
                now = opened.path[-1]
            continue
        ends = CLOSES.get(tag, ())
        if tag in CLOSE_P:
            ends = ("p", *ends)
        place = opened.last(ends)
        if place > opened.walls[-1]:
            if tag in ("tr", "tbody"):
                while opened.path[place - 1].tag in ends:
                    place -= 1
            opened.close(place)
            now = opened.path[-1]
        node = Node(tag, now, attributes)
        if tag not in VOID:
            opened.push(node)
            now = node
    if at < len(source):
        _text(now, source[at:], link)
    return root


def _ends(source: str, tag: str, at: int) -> dict[int, int]:
    """Where the elements of this tag begin and end, from `at` on; those without end tag are left out."""
    out: dict[int, int] = {}
    begun: list[int] = []
    name = rf"<(/?){re.escape(tag)}(?![^\s/>])"
    for m in re.compile(rf"{name}((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|{name}([^>]*)>", re.I).finditer(source, at):
        if (m[1] or m[3]) == "/":
            if begun:
                out[begun.pop()] = m.end()
        elif not (m[2] or m[4] or "").endswith("/"):
            begun.append(m.start())
    return out


def _text(node: Node, text: str, link: int) -> None:
    node.content.append(text)
    n = len(text) - text.count(" ") - text.count("\n")
    if n:
        node.chars += n
        node.links += n * link
        node.marks += text.count(".") + text.count(",") + text.count("。") + text.count("?")


def nodes_of(root: Node) -> list[Node]:
    """All nodes in page order, with the sums of their subtrees filled in."""
    out, todo, seen = [], [root], 0
    while todo:
        node = todo.pop()
        node.before = seen
        seen += node.chars
        out.append(node)
        todo.extend(reversed(node.children))
    for node in reversed(out):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.links += node.links
            node.parent.marks += node.marks
            node.parent.blocks += node.blocks + 1
    return out


N_FEATURES = 12 + 3 + 2 * N_GROUPS + 2


def vectors(nodes: list[Node]) -> np.ndarray:
    """A row of features for each node of a page."""
    total = max(1, nodes[0].chars)
    rows = []
    for n in nodes:
        p = n.parent or n
        chars = n.chars
        siblings = len(p.children)
        up = p.parent or p
        row = [
            n.kind,
            n.depth,
            chars,
            n.links / (chars + 1),
            n.marks / (chars + 1) * 100,
            chars / (n.blocks + 1),
            n.blocks,
            chars / total,
            n.before / total,
            siblings,
            n.index,
            chars / (p.chars + 1),
            p.kind,
            up.kind,
            n.hidden,
        ]
        g, a = n.groups, n.above
        row += [g >> i & 1 for i in range(N_GROUPS)]
        row += [a >> i & 1 for i in range(N_GROUPS)]
        row += [n.edges, sum(1 for c in n.children if c.kind == 5)]
        rows.append(row)
    return np.array(rows, np.float32).reshape(-1, N_FEATURES)


@dataclass
class Boosted:
    """Regression trees of equal depth: feature and threshold of each inner node, value of each leaf."""

    bias: float
    features: np.ndarray
    cuts: np.ndarray
    values: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        inner = self.features.shape[1]
        for f, c, v in zip(self.features, self.cuts, self.values, strict=True):
            at = np.zeros(len(x), np.int64)
            while at.size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, penalty: float = 1.0, bins: int = 32) -> Boosted:
    """Newton boosting for log loss with histogram splits."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    share = y.mean()
    bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    score = np.full(n, bias)
    inner = (1 << depth) - 1
    features, cuts, values = np.zeros((trees, inner), np.int64), np.zeros((trees, inner), np.float32), np.zeros((trees, inner + 1))
    width = bins + 1
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first = (1 << level) - 1
            place = at - first
            count = 1 << level
            best = [(-1.0, 0, np.inf)] * count
            for j in range(d):
                key = place * width + binned[:, j]
                g = np.bincount(key, grad, count * width).reshape(count, width).cumsum(1)
                h = np.bincount(key, hess, count * width).reshape(count, width).cumsum(1)
                gt, ht = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + penalty) + (gt - g) ** 2 / (ht - h + penalty) - gt**2 / (ht + penalty)
                gain = gain[:, : len(edges[j])]
                if gain.shape[1]:
                    k = gain.argmax(1)
                    for i in range(count):
                        if gain[i, k[i]] > best[i][0] + 1e-9:
                            best[i] = (gain[i, k[i]], j, edges[j][k[i]])
            for i, (_, j, cut) in enumerate(best):
                features[t, first + i], cuts[t, first + i] = j, cut
            at = 2 * at + 1 + (x[np.arange(n), features[t, at]] > cuts[t, at])
        leaf = at - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        values[t] = rate * g / (h + penalty)
        score = score + values[t, leaf]
    return Boosted(bias, features, cuts, values)


def decode(nodes: list[Node], logits: np.ndarray) -> list[bool]:
    """Which nodes are article in the likeliest consistent labelling."""
    yes = -np.logaddexp(0, -logits)
    no = -np.logaddexp(0, logits)
    place = {id(n): i for i, n in enumerate(nodes)}
    k = len(nodes)
    article, dropped, outside = yes.tolist(), no.tolist(), no.tolist()
    for i in range(k - 1, 0, -1):
        p = place[id(nodes[i].parent)]
        article[p] += max(article[i], dropped[i])
        dropped[p] += dropped[i]
        outside[p] += max(outside[i], article[i])
    label = ["outside"] * k
    for i, n in enumerate(nodes):
        above = label[place[id(n.parent)]] if n.parent is not None else "outside"
        if n.parent is None or above == "outside":
            label[i] = "article" if article[i] > outside[i] and n.parent is not None else "outside"
        elif above == "article":
            label[i] = "article" if article[i] >= dropped[i] else "dropped"
        else:
            label[i] = "dropped"
    return [x == "article" for x in label]


def blocks(nodes: list[Node], kept: list[bool]) -> list[str]:
    """The kept nodes' own text, cut at every block boundary, references decoded, white space folded."""
    keep = {id(n) for n, k in zip(nodes, kept, strict=True) if k}
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        if run:
            text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
            if text:
                out.append(text)
            run.clear()

    todo: list[tuple[Node, int]] = [(nodes[0], 0)]
    while todo:
        node, i = todo.pop()
        if i == 0:
            close()
        own = id(node) in keep
        content = node.content
        while i < len(content):
            piece = content[i]
            i += 1
            if isinstance(piece, Node):
                close()
                todo += [(node, i), (piece, 0)]
                break
            if own:
                run.append(piece)
        else:
            close()
    return out


# Training pages


def _words(rng: random.Random, lo: int, hi: int, stop: str | None = ".") -> str:
    n = rng.randint(lo, hi)
    stop = rng.choice(["", "", ",", ".", "!", "?"]) if stop is None else stop
    w = ["".join(rng.choice(["an", "the", "or", "ing", "re", "é", "st", "lo", "mi", "ä", "ton", "k"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    for i in range(5, n, 9):
        w[i] += rng.choice([",", ".", ".", "***", "&amp;&amp;", "%%%"])
    return (" ".join(w)).capitalize() + stop


def training_page(rng: random.Random) -> tuple[str, str]:
    """A generated page, its article's nodes marked by the attribute data-y, and its main text."""
    y = MARK
    link = lambda: f'<a href="/{_words(rng, 1, 1, "")}">{_words(rng, 1, 4, None)}</a>'
    text: list[str] = []

    def own(tag: str, lo: int, hi: int, stop: str = ".") -> str:
        body = _words(rng, lo, hi, stop)
        text.append(html.unescape(body))
        if rng.random() < 0.2:
            cut = body.find(" ")
            if cut > 0:
                body = f"<{rng.choice(['b', 'em', 'strong', 'span'])}>{body[:cut]}</b>{body[cut:]}" if rng.random() < 0.3 else f'<a href="/x">{body[:cut]}</a>{body[cut:]}'
        end = "" if tag == "p" and rng.random() < 0.15 else f"</{tag}>"
        return f"<{tag}{y}>{body}{rng.choice(['', '', '<br>'])}{end}"

    def menu(tag: str, cls: str) -> str:
        items = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 9)))
        return f"<{tag}{cls}><ul>{items}</ul></{tag}>"

    def mark(*names: str) -> str:
        return f' {rng.choice(["class", "id"])}="{rng.choice(names)}"'

    def para(lo: int = 4, hi: int = 60) -> str:
        return f"<p>{_words(rng, lo, hi)}</p>"

    def boilerplate() -> str:
        return rng.choice([
            lambda: menu("nav", ""),
            lambda: menu("div", mark("menu", "nav", "navbar", "breadcrumb", "main-menu", "top-links")),
            lambda: menu("ul", mark("menu", "nav", "pagination")),
            lambda: f"<header>{rng.choice(['', '<h1>' + _words(rng, 1, 4, None) + '</h1>', para(2, 8)])}{menu('nav', None)}</header>",
            lambda: f"<div{mark('header', 'masthead', 'topbar')}>{_words(rng, 1, 6, None)}</div>",
            lambda: f"<aside>{''.join(para(3, 40) for _ in range(rng.randint(1, 3)))}</aside>",
            lambda: f"<div{mark('sidebar', 'side', 'widget', 'related', 'right-rail')}><h3>{_words(rng, 1, 3, None)}</h3>{rng.choice([para(5, 40), '<ul>' + ''.join('<li>' + link() + '</li>' for _ in range(4)) + '</ul>'])}</div>",
            lambda: f"<div{mark('ad', 'ads', 'advert', 'sponsored', 'banner', 'promo', 'ad-slot')}>{rng.choice([_words(rng, 3, 25), para(3, 25)])}</div>",
            lambda: f"<div{mark('cookie-notice', 'cookie', 'consent', 'gdpr-banner', 'notice', 'alert')}>{rng.choice([para(5, 30), _words(rng, 5, 30)])}<button>{_words(rng, 1, 2, None)}</button></div>",
            lambda: f"<form><label>{_words(rng, 1, 3, None)}</label><input name='q'><button>{_words(rng, 1, 2, None)}</button>{rng.choice(['', para(4, 15)])}</form>",
            lambda: f"<div{mark('newsletter', 'subscribe', 'signup')}>{para(4, 20)}<form><input><button>{_words(rng, 1, 1, None)}</button></form></div>",
            lambda: f"<div{mark('share', 'social', 'follow')}>{link()}{link()}</div>",
        ])()

    def comments() -> str:
        each = lambda: rng.choice([lambda: f"<div{mark('comment', 'reply')}>{para(3, 50)}</div>", lambda: f"<li{mark('comment')}>{para(3, 50)}</li>", lambda: f"<article{mark('comment')}><h4>{_words(rng, 1, 2, '')}</h4>{para(3, 50)}</article>", lambda: para(3, 50)])()
        tag = rng.choice(["div", "section", "ol"])
        return f"<{tag}{mark('comments', 'comment-list', 'discussion', 'replies', 'reader-comments')}><h3>{_words(rng, 1, 3, '')}</h3>{''.join(each() for _ in range(rng.randint(1, 6)))}</{tag}>"

    def article() -> str:
        tag, attr = rng.choice([("article", ""), ("article", ""), ("article", mark("post", "entry", "story")), ("main", ""), ("div", mark("content", "article", "post-body", "entry-content", "main-content", "story")), ("section", mark("article", "content", "post"))])
        parts = [own(rng.choice(["h1", "h1", "h2"]), 2, 14, rng.choice(["", "."]))] if rng.random() < 0.9 else []
        if parts and rng.random() < 0.15:
            parts = [f"<header{y}>{parts[0]}{own('p', 1, 6, '') if rng.random() < 0.4 else ''}</header>"]
        for _ in range(rng.choice([1, 2, 4, 8, 14])):
            r = rng.random()
            if r < 0.75:
                parts.append(own("p", 1, rng.choice([4, 30, 120])))
            elif r < 0.82:
                parts.append(own(rng.choice(["h2", "h3"]), 1, 6, ""))
            elif r < 0.87:
                parts.append(f"<ul{y}>" + "".join(own("li", 1, 15) for _ in range(rng.randint(1, 4))) + "</ul>")
            elif r < 0.9:
                parts.append(f"<blockquote{y}>" + own("p", 3, 30) + "</blockquote>")
            elif r < 0.92:
                parts.append(own("pre", 2, 20, ""))
            elif r < 0.94:
                parts.append(f"<table{y}><tr{y}>" + "".join(own("td", 1, 4, "") for _ in range(3)) + "</tr></table>")
            elif r < 0.96:
                parts.append(f"<figure{y}><img src='x'>" + own("figcaption", 2, 10) + "</figure>")
            else:
                parts.append(boilerplate())
        body = "".join(parts)
        if rng.random() < 0.2:
            body = f"<div{y}{rng.choice(['', mark('body', 'text', 'inner')])}>{body}</div>"
        if rng.random() < 0.2:
            body += comments()
        return f"<{tag}{attr}{y}>{body}</{tag}>"

    top = [boilerplate() for _ in range(rng.randint(0, 4))]
    end = ([comments()] if rng.random() < 0.3 else []) + [boilerplate() for _ in range(rng.randint(0, 3))]
    main = article() if rng.random() < 0.97 else ""
    if rng.random() < 0.35:
        main = f"<{rng.choice(['div', 'section', 'main'])}{rng.choice(['', mark('wrapper', 'page', 'container')])}>{''.join(top[2:])}{main}{''.join(end[:1])}</div>"
        top, end = top[:2], end[1:]
    foot = rng.choice([f"<footer>&copy; {_words(rng, 2, 20)}</footer>", f"<footer>{para(3, 15)}{menu('div', '')}</footer>", f"<div{mark('footer', 'copyright', 'legal')}>{_words(rng, 2, 20)}</div>", ""])
    head = f"<head><title>{_words(rng, 2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
    body = f"{''.join(top)}<!-- x -->{main}{''.join(end)}{foot}"
    shape = rng.random()
    if shape < 0.08:  # a fragment
        page = body
    elif shape < 0.16:  # the article alone
        page = main
    elif shape < 0.28:
        page = f"<body>{body}{rng.choice(['</body>', ''])}"
    else:
        page = f"<!DOCTYPE html><html>{head}<body>{body}{rng.choice(['</body></html>', ''])}"
    return page, "\n".join(_SPACE.sub(" ", t).strip() for t in text)


#: The training mark: an attribute that parses to a group no other token has.
MARK = ' data-y="1"'
_MARK_BIT = N_GROUPS
_GROUP_OF["trainingmark"] = _MARK_BIT


def marks(source: str) -> np.ndarray:
    """1 for each node of a training page, in page order, whose tag carries the mark."""
    order = nodes_of(parse(source.replace(MARK, ' role="trainingmark"')))
    return np.array([n.groups >> _MARK_BIT & 1 for n in order], np.float64)


@lru_cache(maxsize=2)
def trained(pages: int = 1400, seed: int = 17) -> Boosted:
    """The trees, fitted on `pages` generated pages (a bounded set, alike on every run)."""
    rng = random.Random(seed)
    sources = [training_page(rng)[0] for _ in range(pages)]
    x = np.concatenate([vectors(nodes_of(parse(s.replace(MARK, "")))) for s in sources])
    return boost(x, np.concatenate([marks(s) for s in sources]))


def main_text(source: str | None, model: Boosted) -> str:
    """The main text of one page."""
    nodes = nodes_of(parse(source))
    return "\n".join(blocks(nodes, decode(nodes, model.logits(vectors(nodes)))))


def extract_pages(pages: DataFrame, model: Boosted | None = None, source: str = "html") -> DataFrame:
    """pages without `source`, plus text string and n_chars long (code points of text).

    Null and empty html, and pages without an article, have an empty text and 0. Every other column
    passes (one named text or n_chars is replaced), so null keys and repeated rows do. No shuffle;
    whole pages of any size; nothing of a kept block is cut.
    """
    model = trained() if model is None else model
    rest = [c for c in pages.columns if c not in (source, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                trees = [nodes_of(parse(s.as_py())) for s in part.column(source)]
                logits = model.logits(np.concatenate([vectors(t) for t in trees]))
                texts, low = [], 0
                for t in trees:
                    texts.append("\n".join(blocks(t, decode(t, logits[low : low + len(t)]))))
                    low += len(t)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*rest, "text", "n_chars"])

    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in rest]
    return pages.select(*[f"`{c}`" for c in rest], f"`{source}`").mapInArrow(run, ", ".join([*kinds, "text string", "n_chars long"]))
